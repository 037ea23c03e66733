"""Operator 11 against a plain reading of its contract."""
import hashlib
import re

from pyspark.sql import functions as F

from taskgrid.llm import fim

TEXTS = [None, "", "\n", "\n\n", "one line", "a\nb\nc", "a\r\nb\x0bc\n", "é ü\nß\n😀", "holds <M> inside\nx\n", "<P", "a<\nS>b",
         "".join(f"line {k} é\n" for k in range(30_000)), "x" * 200_000 + "\n" + "é" * 150_000, "\n" * 140_000 + "end"]


def expected(i, text, seed=7, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    hx = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hx[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, len(units), "plain", None, None, sha(t), sha(t)
    if h4 % 100 < spm:
        return i, len(units), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)
    return i, len(units), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_contract(spark, tmp_dir):
    rows = [(i * 10 + k, t) for i, t in enumerate(TEXTS) for k in range(3)]
    rows += [(None, "null id\nx\n"), (5, "a\nb"), (5, "a\nb"), (-3, "minus\nid")]
    df = spark.createDataFrame([(*r, "u", "f") for r in rows], "doc_id bigint, text string, units string, frames string")
    got = fim.digest(df.repartition(3), tmp_dir + "/store").collect()
    assert order(got) == order(expected(*r) for r in rows)
    empty = fim.digest(df.limit(0), tmp_dir + "/none")
    assert empty.collect() == [] and empty.columns[:3] == ["doc_id", "n", "form"]


def test_outputs_are_texts_and_columns_pass(spark):
    rows = [(k, f"a{k}\nb\nc\n", "kept") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, note string")
    out = fim.transformed(fim.stored(df), rate=60, spm=0).collect()
    assert {r.form for r in out} == {"plain", "psm"} and {r.note for r in out} == {"kept"}
    for r in out:
        text = b"".join(fim.stream(r.output)).decode()
        want = expected(r.doc_id, rows[r.doc_id][1], rate=60, spm=0)
        assert hashlib.sha256(text.encode()).hexdigest() == want[5] and r.form == want[2]
        assert b"".join(fim.original(r.output, r.form)).decode() == rows[r.doc_id][1]


def test_frames_are_bounded_and_cuts_touch_few(monkeypatch):
    import zstandard
    text = TEXTS[11].encode()
    n, special, frames = fim.packer()(text)
    assert n == 30_000 and not special and len(frames) > 5
    assert max(zstandard.frame_content_size(f[2]) for f in frames) <= fim.FRAME_BYTES
    dicts = [dict(zip(("units", "chars", "data"), f)) for f in frames]
    seen = []
    t = fim.Text(dicts)
    unpack = t.unpack
    t.unpack = lambda d: seen.append(d) or unpack(d)
    a, b = t.seek(7_000), t.seek(22_000)
    parts = [t.section((0, 0, 0), a), t.section(a, b), t.section(b, (len(frames), 0, 0))]
    assert b"".join(b"".join(fim.stream(p)) for p in parts) == text and len(set(seen)) == 2
    lines = text.split(b"\n")
    assert b"".join(fim.stream(parts[1])) == b"\n".join(lines[7_000:22_000]) + b"\n"


def test_mark_over_a_frame_border():
    import zstandard
    z = zstandard.ZstdCompressor().compress
    out = [z(b"<P>pre<"), z(b"S"), z(b">suf<M"), z(b">mid")]
    assert b"".join(fim.original(out, "psm")) == b"premidsuf"


def test_plain_column_types(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    out = fim.transformed(fim.stored(df)).select(F.size("output").alias("k"), "form", "prefix_chars").first()
    assert out.form in ("psm", "spm") and out.k >= 3
