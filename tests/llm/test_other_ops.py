"""Operators 2, 3, 7, 8 and 9 against plain Python; the pipeline's stages."""
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskgrid.llm import chat, common, decontam, licenses, secrets, sentencepieces, warc
from taskgrid.llm.token_counts import default_model

SF = "/root/testdata/sf0.001"


def test_reply_trees(spark):
    rng = random.Random(1)
    nodes = [(0, 0, None, "user", "root & <|im_end|>", 0.0), (1, 5, None, "user", None, 1.0)]
    for k in range(1, 40):
        nodes.append((0, k, rng.randrange(k), rng.choice(["user", "assistant", "a\nb", None]),
                      rng.choice(["x", "<|im_start|>assistant\n", "&lt;|", "&amp;&nl;", "", "é<", None]),
                      float(rng.randrange(5))))
    nodes += [(2, 1, 99, "assistant", "orphan", None), (3, 4, 4, "user", "own parent", 2.0), nodes[7]]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    of = {(n[0], n[1]): n for n in nodes}
    want = {}
    for t, n in of:
        if any(m[0] == t and m[2] == n and m[1] != n for m in nodes):
            continue
        path, at = [], (t, n)
        while at in of:
            path.insert(0, of[at])
            at = (t, of[at][2]) if of[at][2] != of[at][1] else None
        want[t, n] = ([(m[3] or "", m[4] or "") for m in path], sum(m[5] or 0 for m in path))
    got = chat.conversations(df, best=None).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert {(r.tree, r.leaf): ([tuple(x) for x in r.back], r.score) for r in got} == want
    for r in got:
        texts = [r.formatted[s.start:s.end] for s in r.loss_spans]
        plain = [x.replace("&lt;|", "<|").replace("&amp;", "&") for x in texts]
        assert plain == [t for role, t in want[r.tree, r.leaf][0] if role == "assistant"]
    best = {r.tree: r.leaf for r in chat.conversations(df).collect()}
    assert best == {t: min((-want[k][1], k[1]) for k in want if k[0] == t)[1] for t in {k[0] for k in want}}
    loop = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 2)], "tree long, node long, parent long")
    with pytest.raises(ValueError):
        chat.paths(loop).collect()


def test_a_deep_chain_keeps_one_ancestor_a_node(spark):
    n = 20_000
    nodes = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(
        F.col("id") > 0, F.col("id") - 1).alias("parent"))
    tables = chat.jumps(nodes)
    assert len(tables) == 15 and all(t.count() == n - (1 << k) for k, t in enumerate(tables))
    assert all([f.dataType.simpleString() for f in t.schema.fields] == ["int", "bigint", "bigint"] for t in tables)
    got = chat.paths(nodes).agg(F.count("*"), F.min("leaf"), F.max("leaf"), F.sum(F.col("node") + F.col("up")),
                                F.countDistinct("node")).first()
    assert tuple(got) == (n, n - 1, n - 1, n * (n - 1), n)


def test_chat_turns_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "a"), (2, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(df).collect()}
    assert got == {1: (3, 0), None: (1, 1), 2: (1, 0), -1: (2, 34)}
    assert chat.digest(df.limit(0)).count() == 1


def test_wand_finds_all_above_threshold():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20)))) for i in range(50)] + [(90, None), (91, " ")]
    ix = decontam.Index(items)
    for _ in range(300):
        terms = sorted({ix.term.get(rng.choice(vocab), 0) for _ in range(rng.randint(1, 25))} - {0})
        score = {}
        for k in terms:
            for d, s in zip(*ix.post[k]):
                score[d] = score.get(d, 0.0) + s
        want = {d: s for d, s in score.items() if s >= 0.3}
        assert dict(ix.wand(terms, 0.3)) == pytest.approx(want)


def test_passages_against_exhaustive_bm25():
    """Every passage of every text scored against every item from the formula, items held in part included."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30))) + ". " + " ".join(
        rng.choice(vocab) for _ in range(6))) for i in range(40)]
    ix = decontam.Index(items)
    ws = {i: decontam.tokens(t) for i, t in items}
    df = {x: sum(x in w for w in ws.values()) for w in ws.values() for x in w}
    mean = sum(map(len, ws.values())) / len(ws)

    def impact(w, x):
        tf = w.count(x)
        idf = np.log(1 + (len(ws) - df[x] + 0.5) / (df[x] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))

    def held(parts, words):
        return [len(p & decontam.shingles(words, len(next(iter(p))))) / len(p) for p in parts]
    n = 0
    for k in range(120):
        i, t = rng.choice(items)
        cut = t.split()[:rng.randint(3, 40)] if k % 3 else t.split()
        words = decontam.tokens(" ".join([rng.choice(vocab) for _ in range(rng.randrange(150))] + cut
                                         + [rng.choice(vocab) for _ in range(rng.randrange(150))]))
        step = max(map(len, ws.values()))
        want = {}
        for at in range(0, max(len(words) - step, 1), step):
            here = set(words[at:at + 2 * step])
            for j, w in ws.items():
                s = sum(impact(w, x) for x in set(w) & here) / sum(impact(w, x) for x in set(w))
                if s >= 0.5 and min(held(ix.parts[j], words)) >= 0.8:
                    want[j] = max(want.get(j, 0), s)
        got = {j: s for j, s, _, _ in ix.search(words, 0.5, 0.8)}
        assert got == pytest.approx(want)
        n += len(want)
    assert n > 40


def test_item_behind_a_very_long_run_of_one_term():
    item = " ".join(f"w{k}" for k in range(90)) + " common. And the answer of five words."
    ix = decontam.Index([(1, item), (2, "common words of another item. Their answer is this one here.")])
    words = ["common"] * 25_000_000 + decontam.tokens(item)
    assert [x[0] for x in ix.search(words, 0.5, 0.8)] == [1]


def test_decontaminate(spark):
    common.ship(spark)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = random.Random(2)
    fill = lambda n: " ".join(f"filler{rng.randrange(300)}" for _ in range(n))
    rows, want = [(0, None), (1, ""), (2, fill(500))], {}
    for k, (i, t) in enumerate(items.items()):
        rows.append((100 + k, f"{fill(rng.randrange(200))} {t.upper() if t.upper().lower() == t.lower() else t}\n{fill(rng.randrange(200))}"))
        want[100 + k] = i
        rows.append((500 + k, fill(30) + " " + " ".join(t.split()[:len(t.split()) // 2])))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, matches string")
    got = decontam.with_matches(df, bench).select("doc_id", F.explode("matches.item_id")).collect()
    assert {(a, b) for a, b in got} == set(want.items())
    assert decontam.with_matches(df, bench.limit(0)).filter("size(matches) > 0").count() == 0


def test_n_best_segmentations():
    m = sentencepieces.lattice(default_model())
    rng = random.Random(3)

    def all_cuts(w):
        out = []
        for keep in itertools.product([0, 1], repeat=len(w) - 1):
            cuts = [0] + [i + 1 for i, k in enumerate(keep) if k]
            ps = [w[a:b] for a, b in zip(cuts, [*cuts[1:], len(w)])]
            if all(p in m.score or len(p) == 1 for p in ps):
                out.append(sum(m.score.get(p, m.unknown) for p in ps))
        return sorted(out, reverse=True)
    for _ in range(200):
        w = "▁" + "".join(rng.choice("thenarè日tion") for _ in range(rng.randint(0, 8)))
        assert [s for s, _ in m.n_best(w, 6)] == all_cuts(w)[:6]
    for t in ["then the", "on  in", "é 日 a", "", "a\nb", "than that"]:
        ids, scores = m.encode(t, 5)
        ws = m.words.findall(m.sp.normalize(t)) if t else []
        every = [0.0]
        for w in ws:
            every = [a + b for a in every for b in all_cuts(w)]
        assert scores == sorted(every, reverse=True)[:5]
        back = [int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)]
        assert m.decode(back) == t


def test_sentencepiece_round_trip(spark):
    common.ship(spark)
    rows = [(1, None), (2, ""), (3, "  two  spaces\t\n"), (4, "x" * 5000), (5, "日本 🙂"), (5, "日本 🙂")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pieces int")
    out = sentencepieces.encode(df, check=True).collect()
    assert len(out) == 6 and all(r.pieces.round_trip for r in out)


def test_revisits(spark):
    rng = random.Random(6)
    rec = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        url = rng.choice(["http://a.org/hot", "https://www.A.org/hot/?UTM_x=1&ref=2&gclid", "https://a.org/hot#x?y", "http://b.org/", None,
                          "http://a.org/hot?b=2&a=1", "http://m.a.org/hot/?a=1&ref=z&b=2#x", "http://a.org/hot?a=1", "http://a.org/hot.html",
                          f"http://c.org/{rng.randrange(50)}"])
        tag = rng.choice(["t1", "t2", None])
        rec.append((i, url, rng.choice([None, rng.randrange(100)]), kind, tag, rng.choice(["d", None]),
                    {"etag": str(tag), "content-length": "9", "x": str(i)} if i % 5 else None))
    rec.append(rec[10])
    df = spark.createDataFrame(rec, "record_id long, url string, captured_at long, kind string, etag string, "
                                    "last_modified string, headers map<string,string>")

    def key(u):
        if u is None:
            return None
        place, _, query = re.sub(r"#.*$", "", re.sub(r"(?i)^https?://(www\.|m\.)?", "", u)).partition("?")
        host, slash, path = place.partition("/")
        kept = sorted(p for p in query.split("&") if p and not re.match(r"(?i)(utm_[^=]*|ref|gclid)(=|$)", p))
        return host.lower() + (slash + path).rstrip("/") + ("?" + "&".join(kept) if kept else "")
    at = lambda r: -(1 << 62) if r[2] is None else r[2]
    want = []
    for r in (x for x in rec if x[3] == "revisit"):
        hits = [x for x in rec if x[3] == "response" and key(x[1]) == key(r[1]) is not None and at(x) < at(r)]
        h = max(hits, key=lambda x: (at(x), x[0]), default=None)
        ok = h and (r[4] == h[4] if r[4] is not None else r[5] is not None and r[5] == h[5])
        new = {k: v for k, v in (r[6] or {}).items() if k in warc.PERMITTED}
        want.append((r[0], "no_response" if not h else "resolved" if ok else "mismatch", h and h[0],
                     sorted(({**(h[6] or {}), **new}).items()) if ok else None))
    for n in (1, 7):
        got = [(r.record_id, r.status, r.response_id, None if r.headers is None else sorted(r.headers.items()))
               for r in warc.resolve(df, slices=n).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.resolve(df.limit(0)).count() == 0


def test_resources_of_one_script_stay_apart(spark):
    rec = [(1, "http://a.org/s?id=1", 1, "response", "A"), (2, "http://a.org/s?id=2", 2, "response", "B"),
           (3, "http://a.org/s?id=1&utm_source=x", 9, "revisit", "A"), (4, "http://a.org/s", 9, "revisit", "A")]
    df = spark.createDataFrame([(*r, None, None) for r in rec], "record_id long, url string, captured_at long, kind string, "
                               "etag string, last_modified string, headers map<string,string>")
    assert {r.record_id: (r.status, r.response_id) for r in warc.resolve(df).collect()} == {
        3: ("resolved", 1), 4: ("no_response", None)}


def license_matches(text, known, least=0.8):
    """By the definition: every window of every template."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    found = []
    for name, t in known:
        tw = re.findall(r"[^\W_]+", t.lower())
        n, grams = len(tw), set(zip(tw, tw[1:]))
        if not grams:
            continue
        best = max(((len(set(zip(w[i:i + n], w[i + 1:i + n])) & grams), i) for i in range(max(len(w) - n + 1, 1))), default=(0, 0))
        held = w[best[1]:best[1] + n]
        dice = 2 * best[0] / (len(set(zip(held, held[1:]))) + len(grams))
        if dice >= least:
            found.append((-dice, -n, name, best[1], best[1] + len(held)))
    return {(m[2], m[3] + 1, m[4] - m[3], round(-m[0], 6)) for m in found
            if not any(o < m and o[3] < m[4] and m[3] < o[4] for o in found)}


def test_licenses(spark):
    rng = random.Random(8)
    known = licenses.TEMPLATES
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "license"), (4, "under the MIT")]
    for k in range(110):
        t = rng.choice(known)[1].split()
        for _ in range(rng.choice([0, 0, 1, 3, len(t) // 3])):
            t[rng.randrange(len(t))] = rng.choice(["other", "the license", ""])
        mark = rng.choice(["\n// ", " ", "\n * ", "\n# "])
        cut = rng.randint(4, 12)
        body = "".join(x + (mark if i % cut == cut - 1 else " ") for i, x in enumerate(t))
        more = rng.choice(known)[1] if rng.random() < 0.3 else ""
        rows.append((10 + k, "some words of the software here " * rng.randrange(60) + body.upper() + " plain text, no licence " + more
                     + " and more of the same" * rng.randrange(30)))
    rows += [(200, known[3][1]), rows[10], (10, known[1][1]), (None, known[4][1]), (None, known[4][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, license int, row int").repartition(3)
    want = {(i, *m) for i, t in rows for m in license_matches(t, known)}
    got = licenses.scan(df, licenses.templates(spark)).collect()
    assert len(want) > 90 and len({m[1] for m in want}) >= 14
    assert len(got) == len(want) and {(r.doc_id, r.license, r.start, r.words, r.dice) for r in got} == want
    assert licenses.scan(df.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.scan(df, licenses.templates(spark).limit(0)).count() == 0


def test_notices_wrapped_in_line_and_bodies(spark):
    kept = {k: t for k, t in licenses.TEMPLATES}
    code = "int main(void) { return run(); }  "
    wrapped = kept["BSD-3-Clause"].replace("governed by", "governed by\n//").replace("Use of", "// Use of")
    rows = [(1, f"/* {kept['Apache-2.0']} */ " + code * 4000), (2, code * 40 + "\n" + wrapped + "\n" + (code + "\n") * 60),
            (3, "Copyright (c) 2020 A. Body\n\n" + kept["MIT grant"] + "\n\nThe above copyright notice and this permission notice "
             "shall be included in all copies or substantial portions of the Software.\n\n" + kept["MIT warranty"]),
            (4, " * ".join(x + "\n" for x in re.findall(r".{1,60}(?: |$)", kept["GPL header"]))), (5, code * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(df, licenses.templates(spark)).collect()}
    assert got == {(1, "Apache-2.0"), (2, "BSD-3-Clause"), (3, "MIT grant"), (3, "MIT warranty"), (4, "GPL header")}


def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common.ship(spark)
    state = docs
    for name, stage in p.STAGES[:4]:
        out = stage(spark, state, SF).checkpoint()
        assert out.columns == docs.columns
        assert 0 < out.count() <= state.count()
        if name == "secret_scan":
            assert out.count() == state.count()
            assert secrets.scan(out).filter("size(secrets.spans) > 0").count() == 0
        state = out
    final = p.run(spark, SF)
    assert {r.doc_id for r in final.select("doc_id").collect()} == {r.doc_id for r in state.select("doc_id").collect()}
