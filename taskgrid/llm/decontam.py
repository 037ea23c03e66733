"""Benchmark decontamination by BM25 with block-max WAND (operator 3).

The benchmark's items form an inverted index; an item's term weights are its
BM25 impacts divided by their sum, so an item held whole by a passage scores 1.
Every training document is cut into overlapping passages (twice the longest
item, half overlapping, so each stretch as long as an item lies within one),
and every passage queries the index for all items that score ``threshold`` or
more. A vectorised pass adds the block maxima of a passage's terms; only blocks
that can reach the threshold are searched, by WAND: cursors in item order, a
pivot where the terms' maxima reach the threshold, the block maxima checked
before an item is scored, else all cursors skip. Hits are verified on the whole
text: five-word shingles of the item's question (all but its last sentence) and
of its answer (the last one) must each be found to 0.8 or more.

A benchmark over ``ITEMS`` items or ``ITEM_BYTES`` of text is used in blocks dealt
by hash, each of about that size. The number of items, document
frequencies, mean and greatest length are of the whole benchmark, so scores do not
depend on the blocks. The blocks are used in turn: one is fetched, all texts are
read against its index, and what it finds is written before the next. Items without
words, and null texts, match nothing. Repeated item rows count once; repeated
documents are matched each, an empty table on either side gives no matches. Bounds
are summed in 64-bit floats, so a text of any length loses no item. A column named
like the result is replaced (with several blocks, one named ``__row`` as well).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text
from taskgrid.session import scratch_path

ITEMS = 5000
ITEM_BYTES = 4 << 20
PER_BLOCK = 4
WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    cut = [m.end() for m in re.finditer(r"[.!?\n](?=\s+\S)", text.strip())]
    at = cut[-1] if cut else len(text)
    return tokens(text.strip()[:at]), tokens(text.strip()[at:])


def shingles(words: list[str], k: int = 5) -> set:
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Index:
    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, int, int, dict[str, int]] | None = None):
        """``whole``: items with words, their words, the longest one's words and the document frequencies (of the
        terms of ``items`` at least) of the benchmark that ``items`` are a block of."""
        items = [(i, t) for i, t in items if tokens(t or "")]
        self.ids = [i for i, _ in items]
        self.words = [tokens(t) for _, t in items]
        self.parts = [[shingles(p) for p in question_answer(t) if p] for _, t in items]
        n, total_words, longest, df = whole or (
            len(items), sum(map(len, self.words)), max(map(len, self.words), default=1), {})
        mean = total_words / max(n, 1)
        if not whole:
            for w in self.words:
                for x in set(w):
                    df[x] = df.get(x, 0) + 1
        self.term = {x: k + 1 for k, x in enumerate(df)}  # 0: not in the index
        idf = {x: np.log(1 + (n - c + 0.5) / (c + 0.5)) for x, c in df.items()}
        # posting lists: items in order, their weights, and the greatest weight of each block that the list touches
        self.post: list[tuple[list[int], list[float]]] = [([], []) for _ in range(len(df) + 1)]
        self.n_blocks = max(1, -(-len(items) // PER_BLOCK))
        for d, w in enumerate(self.words):
            score = {}
            for x, tf in Counter(w).items():
                score[x] = idf[x] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            total = sum(score.values())
            for x, s in score.items():
                at, weights = self.post[self.term[x]]
                at.append(d)
                weights.append(s / total)
        self.block_max: list[dict[int, float]] = []
        for at, weights in self.post:
            top: dict[int, float] = {}
            for d, s in zip(at, weights):
                top[d // PER_BLOCK] = max(top.get(d // PER_BLOCK, 0.0), s)
            self.block_max.append(top)
        self.upper = np.array([max(t.values(), default=0.0) for t in self.block_max])
        # the same maxima as arrays, one stretch per term
        self.first = np.concatenate(([0], np.cumsum([len(t) for t in self.block_max])))
        self.blocks = np.array([b for t in self.block_max for b in t], np.int64)
        self.maxima = np.array([m for t in self.block_max for m in t.values()])
        self.span = 2 * longest

    def best_block(self, terms: np.ndarray) -> float:
        """The greatest sum of the terms' maxima over a block."""
        n = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return float(np.bincount(self.blocks[at], self.maxima[at]).max(initial=0.0))

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items scoring ``threshold`` or more for the query ``terms``, by block-max WAND."""
        out, need = [], threshold - 1e-6
        cursors = sorted((self.post[k][0][0], k, 0) for k in terms if self.post[k][0])
        while cursors:
            bound, pivot = 0.0, -1
            for i, (_, k, _) in enumerate(cursors):
                bound += float(self.upper[k])
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // PER_BLOCK
            if sum(self.block_max[k].get(block, 0.0) for _, k, _ in cursors[:pivot + 1]) >= need:
                target = item + 1 if cursors[0][0] == item else item
                if cursors[0][0] == item:
                    score = sum(self.post[k][1][p] for d, k, p in cursors if d == item)
                    if score >= need:
                        out.append((item, score))
            else:  # nothing up to the block's end or the next cursor can reach it
                target = (block + 1) * PER_BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            moved = []
            for d, k, p in cursors[:pivot + 1]:
                p = bisect_left(self.post[k][0], target, p)
                if p < len(self.post[k][0]):
                    moved.append((self.post[k][0][p], k, p))
            cursors = sorted(moved + cursors[pivot + 1:])
        return out

    def search(self, words: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, best score, question overlap, answer overlap) of the verified items."""
        get = self.term.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        where = np.flatnonzero(ids)
        if not len(where):
            return []
        step = self.span // 2
        best: dict[int, float] = {}
        known = ids[where]
        starts = np.arange(0, max(len(words) - step, 1), step)
        lo, hi = np.searchsorted(where, starts), np.searchsorted(where, starts + self.span)
        # quick bound with repeats counted: the sum of the terms' maxima
        total = np.concatenate(([0.0], np.cumsum(self.upper[known])))
        for a, b in zip(lo[total[hi] - total[lo] >= threshold - 1e-6], hi[total[hi] - total[lo] >= threshold - 1e-6]):
            terms = np.unique(known[a:b])
            if self.best_block(terms) >= threshold - 1e-6:
                for d, s in self.wand(terms.tolist(), threshold):
                    best[d] = max(best.get(d, 0.0), s)
        if not best:
            return []
        # an item's shingle is at most five words; a shorter part is looked up by its own length
        have = {k: {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
                for k in {len(next(iter(p))) for d in best for p in self.parts[d]}}
        out = []
        for d, s in sorted(best.items()):
            found = [len(p & have[len(next(iter(p)))]) / len(p) for p in self.parts[d]]
            if min(found) >= overlap:
                out.append((self.ids[d], s, found[0], found[-1]))
        return out


_INDEXES: dict[str, Index] = {}  # of this Python worker, by content


def index_of(key: str, items: list, whole: tuple | None) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()  # one index at a time
        _INDEXES[key] = Index(items, whole)
    return _INDEXES[key]


MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def matches_column(text, items: list, threshold: float, overlap: float, whole: tuple | None = None):
    items = sorted(items, key=repr)
    key = hashlib.sha256(repr((items, whole and (*whole[:3], sorted(whole[3].items())))).encode()).hexdigest()

    def make():
        index = index_of(key, items, whole)

        def one(data: bytes):
            found = index.search(tokens(data.decode("utf-8", "replace")), threshold, overlap)
            return ([{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a}
                     for i, s, q, a in found],)
        return one
    return per_text(text, f"m {MATCHES}", make)["m"]


def with_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches",
                 threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """``df`` plus ``out``: the benchmark items that each text holds."""
    items = benchmark.select("item_id", "text").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    res = df.select(*[c for c in df.columns if c != out])
    if not n:
        return res.withColumn(out, F.expr(f"cast(array() as {MATCHES})"))
    if blocks == 1:
        rows = items.collect()
        return res.withColumn(out, matches_column(F.col(text), [(r[0], r[1]) for r in rows], threshold, overlap))
    return in_blocks(res, items, blocks, text, out, threshold, overlap)


def in_blocks(df: DataFrame, items: DataFrame, blocks: int, text: str, out: str, threshold: float,
              overlap: float) -> DataFrame:
    """``with_matches`` for a benchmark of several blocks."""
    spark = df.sparkSession

    def written(table: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"decontaminate-{name}")
        table.write.parquet(path)
        return spark.read.parquet(path)

    def make():
        def one(data: bytes):
            w = tokens(data.decode("utf-8", "replace"))
            return len(w), list(dict.fromkeys(w))
        return one
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block")
    cut = written(items.select("item_id", "text", dealt, per_text(F.col("text"), "n bigint, terms array<string>", make)
                               .alias("t")).filter("t.n > 0"), "items")
    n, total, longest = cut.agg(F.count(F.lit(1)), F.sum("t.n"), F.max("t.n")).first()
    if not n:
        return df.withColumn(out, F.expr(f"cast(array() as {MATCHES})"))
    terms = cut.select("block", F.explode("t.terms").alias("term")).groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("c"))
    often = terms.groupBy("term").agg(F.sum("c").alias("df"))
    often = written(terms.select("term", "block").join(often, "term"), "terms")
    # a number per row, kept by writing it: rows may be alike
    docs = written(df.withColumn("__row", F.monotonically_increasing_id()), "documents")
    found = None
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in cut.filter(F.col("block") == k).select("item_id", "text").collect()]
        if not rows:
            continue
        whole = (n, total, longest, {r[0]: r[1] for r in often.filter(F.col("block") == k).select("term", "df").collect()})
        hit = matches_column(F.col(text), rows, threshold, overlap, whole)
        part = written(docs.select("__row", F.lit(k).alias("block"), F.posexplode(hit).alias("at", "m")), f"block-{k}")
        found = part if found is None else found.unionByName(part)
    by_row = found.groupBy("__row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "at", "m"))), lambda x: x["m"]).alias(out))
    none = F.expr(f"cast(array() as {MATCHES})")
    return docs.join(by_row, "__row", "left").withColumn(out, F.coalesce(out, none)).drop("__row")
