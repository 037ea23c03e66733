"""Operator 13 against plain counting."""
import random
import re
from collections import Counter

from taskgrid.llm import setm

DDL = "doc_id bigint, text string, lang string, words string, block string"


def expected(rows, least, longest=5, cover=100, best=2000):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    hold = {}
    for (lang, p), a in cands.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    hold[lang, p[i:j]] = max(hold.get((lang, p[i:j]), 0), a)
    out = []
    for (lang, p), a in cands.items():
        if 100 * hold.get((lang, p), 0) >= cover * a:
            continue
        score, k, x, y = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, x, y, n[lang], score))
    result = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        result += [(lang, k, *r[1:]) for k, r in enumerate(mine[:best], 1)]
    return sorted(result)


def corpus():
    rng = random.Random(11)
    words = ["The", "of", "stone", "Wall", "é", "É", "x-y", " b", "river", "bed", "old", "mill", "a", "b"]
    rows = [(None, "en"), ("", "en"), (" .,;\t!", "en"), ("one two", None), ("One,two one\ttwo", None), ("one two", "und")]
    for k in range(150):
        text = "".join(rng.choice(words[:4 + k % 11]) + rng.choice([" "] * 8 + ["\t", ". ", ", ", "\n", "\r\n", "\x0b", "  "])
                       for _ in range(rng.randint(1, 90)))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return rows + rows[20:40] + [("run run run run run run run", "de")] * 3


def frame(spark, rows):
    return spark.createDataFrame([(k % 9, *r, "w", "b") for k, r in enumerate(rows)], DDL).repartition(4)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_equals_counting(spark, monkeypatch):
    rows = corpus()
    want = expected(rows, 8)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "de", "und"}
    assert found(setm.collocations(frame(spark, rows), least=8)) == want
    monkeypatch.setattr(setm, "BLOCK_WORDS", 300)  # many blocks
    monkeypatch.setattr(setm, "SLICE_BYTES", 50)
    monkeypatch.setattr(setm, "HELD_WORDS", 500)
    assert found(setm.collocations(frame(spark, rows), least=8)) == want


def test_other_limits_and_cover(spark):
    rows = corpus()
    got = found(setm.collocations(frame(spark, rows), longest=3, least=5, cover=60, best=7))
    assert got == expected(rows, 5, 3, 60, 7) and max(r[1] for r in got) == 7


def test_empty_and_nothing_frequent(spark):
    df = frame(spark, corpus())
    assert setm.collocations(df.limit(0)).collect() == []
    assert setm.collocations(df, least=10**9).collect() == []
    assert setm.collocations(frame(spark, [(None, None), ("", "x")])).columns == [
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    # 1000 * a * n passes 2**63 from about 1e8 * 1e8 on: the same expression on given counts
    from pyspark.sql import functions as F
    df = spark.range(1).select(F.lit(3 * 10**12).alias("f"), F.lit(7 * 10**13 + 1).alias("n"),
                               F.lit(4 * 10**12 + 3).alias("x"), F.lit(5 * 10**12 + 7).alias("y"))
    got = df.select(F.expr(setm.SCORE.format(l="x", r="y")).alias("s")).first().s
    assert got == 1000 * 3 * 10**12 * (7 * 10**13 + 1) // ((4 * 10**12 + 3) * (5 * 10**12 + 7))
