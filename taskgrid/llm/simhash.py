"""SimHash near-duplicates by a byte-position inverted index (operator 6).

A fingerprint is eight positional bytes. Fingerprints within ``3`` bits share at
least 8 - 3 = 5 bytes at the same places, so of the bytes of one half (four
places) they share three: the postings are keyed by three places of one half
and their bytes, eight keys a fingerprint. The equal positional bytes of a
candidate pair are then tallied, pairs with fewer than five are dropped and the
rest verified by bit distance. Equal fingerprints are one entry of the index.

A linked pair of a posting shares two more of the five other places, so a posting
longer than ``BLOCK`` is split by a second index level, keyed by two of those places
and their bytes (ten keys a fingerprint): its work falls by the bytes' spread, not
only over more tasks. What is still longer is cut into blocks by a hash of the
fingerprint and every pair of blocks is one task's work: a posting never meets in one
task, and a task returns a spanning forest of its links, not its pairs.

An empty table gives an empty result; texts are read whole, one at a time; extra
columns are not read. Null or wordless texts have fingerprint zero and link like any other.
Components come from the links by rounds of minimum labels over the distinct
fingerprints, each round written to the checkpoint folder. Rows with a null id
take part; ``component_id`` is the smallest id that is not null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KEYS = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
REST = [list(combinations([p for p in range(8) if p not in c], 2)) for c in KEYS]
BLOCK = 1024


def text_fingerprint(data: bytes, shingle: int = 3) -> int:
    import xxhash
    words = data.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(flat[a:b - 1], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())),
                    np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k:k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint as a signed long."""
    def make():
        def one(data):
            v = text_fingerprint(data, shingle)
            return (v - (1 << 64) if v >> 63 else v,)
        return one
    return per_text(text, "fp bigint", make)["fp"]


def forest(fps: np.ndarray, other: np.ndarray | None, distance: int):
    """Links of a spanning forest over ``fps`` (and ``other``), exact: every linked pair is joined by links."""
    nodes = fps if other is None else np.concatenate([fps, other])
    label = np.arange(len(nodes))
    places = nodes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(len(fps)):
        rest = slice(i + 1, len(nodes)) if other is None else slice(len(fps), len(nodes))
        same = (places[rest] == places[i]).sum(1)  # tally of shared positional bytes
        cand = np.flatnonzero(same >= 8 - distance) + rest.start
        cand = cand[np.bitwise_count(nodes[cand] ^ nodes[i]) <= distance]
        for j in cand[label[cand] != label[i]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield int(nodes[i]), int(nodes[j])


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the three-byte postings guarantee links up to 3 bits")
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    post = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (byte(c[0]) * 65536 + byte(c[1]) * 256 + byte(c[2])).alias("v"))
        for k, c in enumerate(KEYS)])).alias("p")).select("fp", "p.k", "p.v")
    size = post.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = post.join(size, ["k", "v"])
    short = keyed.filter(F.col("n") <= BLOCK).select("fp", "k", "v", F.lit(-1).alias("s"), F.lit(0).cast("bigint").alias("w"), "n")
    # the second level of the index, for long postings alone
    pairs = F.element_at(F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in r]) for r in REST]),
                         F.col("k") + 1)
    places = F.array(*[byte(p) for p in range(8)])
    split = keyed.filter(F.col("n") > BLOCK).select("fp", "k", "v", F.explode(F.transform(pairs, lambda x: F.struct(
        (x["p"] * 8 + x["q"]).alias("s"),
        (F.element_at(places, x["p"] + 1) * 256 + F.element_at(places, x["q"] + 1)).alias("w")))).alias("x")).select(
        "fp", "k", "v", "x.s", "x.w")
    deeper = split.groupBy("k", "v", "s", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = short.unionByName(split.join(deeper, ["k", "v", "s", "w"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # a fingerprint of block i goes to the pairs (i, j) and (j, i) of its posting
    work = keyed.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "fp", "k", "v", "s", "w", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
        (F.col("i") <= F.col("j")).alias("first"))

    def run(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_numpy().view(np.uint64)
        first, lo, hi = t["first"].to_numpy(zero_copy_only=False), t["lo"][0].as_py(), t["hi"][0].as_py()
        a = np.sort(fp[first]) if lo != hi else np.sort(fp)
        out = list(forest(a, None if lo == hi else np.sort(fp[~first]), distance))
        col = lambda k: pa.array(np.array([x[k] for x in out], np.uint64).view(np.int64))
        return pa.table({"a": col(0), "b": col(1)})
    return work.groupBy("k", "v", "s", "w", "lo", "hi").applyInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: rounds of smallest neighbouring label with pointer jumping."""
    both = (edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))).checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")).checkpoint()
    while True:
        near = (both.join(label, both.a == label.node).groupBy("b").agg(F.min("root").alias("r")))
        step = label.join(near, label.node == near.b, "left").select(
            "node", "root", F.least("root", F.coalesce("r", "root")).alias("r"))
        jump = label.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = step.join(jump, step.r == jump.n2, "left").select(
            "node", F.col("root").alias("old"), F.least("r", F.coalesce("r2", "r")).alias("root")).checkpoint()
        if new.filter("old <> root").limit(1).count() == 0:
            return new.select("node", "root")
        label = new.select("node", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``df``."""
    from taskgrid.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    f = df.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")).checkpoint()
    comp = components(links(f.select("fp").distinct(), distance))
    by_fp = f.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = by_fp.join(comp, by_fp.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return f.join(named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def digest(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
