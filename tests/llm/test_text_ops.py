"""Operators 1, 4, 5, 6 and 10 against plain Python."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from taskgrid.llm import common, quality_rules, secrets, simhash, substring, token_counts

DDL = "doc_id bigint, text string, secrets string, tokens string, stats string, fp string"
EDGE = [None, "", " \n\t", "a", "é ü ß", "x " * 3000, "token=" + "a" * 50,
        'PassWord" :  "abcdefghijkl= tail', "token=passwd : abcdefghijklmn", "token=abc",
        "AKIA" + "B" * 13, "AKIAB" * 5 + "é", "é0123456789abcdef0", "api_key='ABCDEFGHIJKL'",
        "apikey==ABCDEFGHIJKLM", "ghp_" + "a1" * 18, "secret=0123456789abcdef secretoken=ABCDEFGHIJKLMN"]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(EDGE)
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for k in range(60):
        body = " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 120)))
        texts.append(body + ("\n" + passage if k % 3 == 0 else "") + (" " + body if k % 7 == 0 else ""))
    texts += texts[20:30]
    for k in range(6):
        w = texts[40].split()
        w[k % len(w)] += "x"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "x " * 3000), (7, "other text")]
    return rows, spark.createDataFrame([(*r, "s", "t", "u", "v") for r in rows], DDL).repartition(5)


PEM = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nMIIEow0aB--c/+==\n-----END RSA PRIVATE KEY-----"


def test_whole_private_keys(spark):
    body = "k3y" * 400_000
    rows = [(1, f"a\n{PEM}\nb"), (2, f"x {PEM}{PEM}y"), (3, "cut\n" + PEM[:70]), (4, PEM.replace("\n", "\\n") + '",'),
            (5, f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----\ntail"),
            (6, "-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in secrets.redact(df).collect()} == {
        1: "a\n[SECRET]\nb", 2: "x [SECRET][SECRET]y", 3: "cut\n[SECRET]", 4: '[SECRET]",', 5: "[SECRET]\ntail", 6: rows[5][1]}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(docs):
    rows, df = docs
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(df).collect())
    want = Counter()
    for i, t in rows:
        s = base_spans(t or "")
        text = ",".join(f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in s)
        n = Counter(k for _, k, _ in s)
        want[i, n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert secrets.redact(df.filter("doc_id = 13")).first().text == "[SECRET]'"


def test_automaton_random():
    rng = random.Random(1)
    scan = secrets.Scanner()
    for _ in range(3000):
        t = "".join(rng.choice(["token", "pass", "word", "=", ":", " ", '"', "AKIA", "abc0123456789def", "Z9", "é",
                                "api_key", "secret", "\n"]) for _ in range(rng.randint(0, 14)))
        got = [(len(t.encode()[:a].decode()), k, len(t.encode()[:b].decode()))
               for a, k, b in scan.spans(t.encode()) if k < 3]
        assert got == base_spans(t), t


def test_token_counts(docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    rows, df = docs
    got = Counter((r.doc_id, *r.tokens) for r in token_counts.count_tokens(df).collect())
    n = [len(sp.encode(t or "")) for _, t in rows]
    assert got == Counter((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n))
    rng, m = random.Random(2), token_counts.merger(token_counts.default_model())
    for _ in range(3000):
        t = "".join(rng.choice(["  ", " ", "▁", "the", "ing", "é", "\t", "\n", "<s>", "<0x0A>", "日本", "🙂", "a",
                                "    ", "tion", "́", "x"]) for _ in range(rng.randint(0, 20)))
        assert (m.count(t) if t else 0) == len(sp.encode(t)), repr(t)


def stats_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i:i + 3])].append(i)
    marked = {i + k for v in tri.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))


def test_quality(docs, spark):
    rows, df = docs
    df = df.select("doc_id", "text", "stats")
    got = Counter((r.doc_id, *r.stats[:5], r.base_failed) for r in quality_rules.judge(df, []).collect())
    want = Counter()
    for i, t in rows:
        s = stats_of(t or "")
        want[(i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want
    d = "/root/testdata/sf0.1"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.fit(real, labels, sample=1500)
    held = (quality_rules.judge(real, rules).filter("not base_failed").join(labels, "doc_id")
            .filter("doc_id % 2 = 1").groupBy("quality", "kept").count().collect())
    n = {(r.quality, r.kept): r["count"] for r in held}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert quality_rules.fit(real.limit(0), labels) == []


def test_simhash(docs):
    import xxhash
    rows, df = docs

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if not w:
            return 0
        s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [fp(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None)
             for r in set(root)}
    want = Counter((rows[k][0], f"{fps[k]:016x}", least[root[k]]) for k in range(len(rows)))
    assert Counter(map(tuple, simhash.digest(df).collect())) == want


def test_simhash_links_split_postings(spark, monkeypatch):
    import numpy as np
    common.ship(spark)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = {0}
    while len(fps) < 150:
        x = rng.choice(sorted(fps))
        for b in rng.integers(0, 64, 4):
            x = int(x) ^ (1 << int(b))
        fps.add(int(x))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    root = {x: x for x in fps}

    def merge(pairs):
        r = dict(root)
        for a, b in pairs:
            a, b = r[a], r[b]
            r = {k: (a if v == b else v) for k, v in r.items()}
        groups = defaultdict(set)
        for k, v in r.items():
            groups[v].add(k)
        return sorted(map(sorted, groups.values()))
    m = (1 << 64) - 1
    assert merge([(r.a & m, r.b & m) for r in got]) == merge(
        [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def test_substring(docs):
    rows, df = docs
    seen, want = {}, Counter()
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = {}
    for i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k:k + 20]), (i, t, k)) != (i, t, k):
                gone |= set(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, t] = (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    for r in rows:
        want[out[r]] += 1
    assert Counter(map(tuple, substring.digest(df).collect())) == want


def test_long_postings_are_split_by_further_bytes(spark, monkeypatch):
    import numpy as np
    rng = random.Random(13)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    base = 0xABCDEF << 40
    fps = {base | rng.getrandbits(40) for _ in range(1500)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in rng.sample(sorted(fps), 200)}
    fps |= {base | 0x1122334400 | k for k in range(200)}  # a second level that is long as well
    v = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        label[label == label[j]] = label[i]
    df = spark.createDataFrame([(int(x) - (1 << 64) if x >> 63 else int(x),) for x in v.tolist()], "fp bigint")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    at = {int(x): k for k, x in enumerate(v)}
    own = np.arange(len(v))
    for a, b in edges:
        assert near[at[a], at[b]]
        own[own == own[at[b]]] = own[at[a]]
    same = lambda x: sorted(tuple(np.flatnonzero(x == k)) for k in set(x.tolist()))
    assert same(own) == same(label) and len(edges) < len(v) * 12


def test_substring_of_a_hot_id(spark):
    from pyspark.sql import functions as F
    rng = random.Random(10)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(rng.choice([None, None, 5, 5, 9, k]), " ".join(f"r{k}w{j}" for j in range(25)) + " " + passage)
            for k in range(90)] + [(None, passage)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    first = min(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = Counter()
    for r in rows:
        w = r[1].split()
        kept = w if r == first else w[:-30]
        want[r[0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring.digest(df).collect())) == want
    n = 64
    chunks = df.select(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(n)).alias("c")).distinct().count()
    assert chunks > 25  # null ids alone are a third of the rows


def test_pairs_that_share_64_bits():
    import numpy as np
    h = np.array([5, 3, 5, 5, 9, 3, 5], np.uint64)
    g = np.array([1, 7, 2, 1, 0, 7, 3], np.uint32)
    first, number = substring.distinct(h, g)
    assert first.tolist() == [1, 0, 2, 6, 4] and number.tolist() == [1, 0, 2, 1, 4, 0, 3]
    assert substring.among(h, g, h[[2, 4, 6]], np.array([2, 1, 3], np.uint32)).tolist() == [
        False, False, True, False, False, False, True]
    none = np.zeros(0, np.uint64)
    assert substring.distinct(none, none)[0].tolist() == [] and not substring.among(h, g, none, none).any()


def test_empty(spark):
    common.ship(spark)
    e = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.digest(e).count() == token_counts.count_tokens(e).count() == 0
    assert simhash.digest(e).count() == substring.digest(e).count() == 0
    assert quality_rules.judge(e, []).count() == 0
