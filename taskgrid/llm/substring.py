"""Substring deduplication with difference-cover anchors (operator 10).

{0, 1, 3, 9} is a difference cover modulo 13: for two places i and j there is a
shift d < 13 with both i + d and j + d in the cover. So two equal windows of 20
words share an aligned anchor of 8 words, and only the 4 in 13 windows of 8 words
at cover positions are hashed and exchanged. Windows of 20 words around anchors
that occur again are then extended to: their own 96-bit hashes are exchanged with
the smallest document id, and a window is removed where an earlier one exists.

Documents are dealt by a hash of id and text into chunks, so an id of any number of
rows is spread. A chunk sends each distinct hash once, so a passage that a third of
all documents share is one entry per chunk; identical rows (same id and text) count
as one document, kept once with their number. Every chunk, bucket of hashes and
reply is bounded by the chunk size, but for a single text longer than that.
Questions and replies hold all 96 bits.

Null texts have no words. Null ids come before all others; rows of equal id are
ordered by their text's hash. An empty table gives an empty one; extra columns are
not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 16 << 20
_rng = np.random.default_rng(20)
COEF = _rng.integers(1, 1 << 63, (3, WINDOW), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
NULL_ID = -(1 << 63)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Chunk:
    """The documents of one chunk in (id, text hash, text) order, their words as one array."""

    def __init__(self, t: pa.Table):
        import xxhash
        rows = zip(t["id"].to_pylist(), t["tie"].to_pylist(), t["text"].to_pylist())
        self.copies = Counter((NULL_ID if i is None else i, k, x or b"") for i, k, x in rows)
        self.rows = sorted(self.copies)
        self.words = [x.split() for _, _, x in self.rows]
        n = [len(w) for w in self.words]
        self.ends = np.cumsum(n, dtype=np.int64)
        self.w = np.fromiter((xxhash.xxh64_intdigest(w, 7) for ws in self.words for w in ws), np.uint64, sum(n))
        lens = np.array(n, np.int64)
        self.doc = np.repeat(np.arange(len(n)), lens)
        self.at = np.arange(len(self.w)) - np.repeat(self.ends - lens, lens)  # place in the document
        self.left = np.repeat(self.ends, lens) - np.arange(len(self.w))  # words from here to its end

    def hashes(self, size: int, coef: int) -> np.ndarray:
        n = max(len(self.w) - size + 1, 0)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += self.w[k:k + n] * COEF[coef, k]
        return mixed(h)

    def anchors(self):
        """Places and hashes of the anchors."""
        h = self.hashes(ANCHOR, 0)
        at = np.flatnonzero(np.isin(self.at[:len(h)] % PERIOD, COVER) & (self.left[:len(h)] >= ANCHOR))
        return at, h[at]

    def windows(self, repeated: np.ndarray):
        """Places and 96-bit hashes (64 and 32 bits) of the windows that hold a repeated anchor."""
        at, h = self.anchors()
        at = at[np.isin(h, repeated)]
        n = max(len(self.w) - WINDOW + 1, 0)
        edge = np.zeros(len(self.w) + 1, np.int64)
        np.add.at(edge, np.maximum(at - PERIOD + 1, at - self.at[at]), 1)
        np.add.at(edge, at + 1, -1)
        take = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (self.left[:n] >= WINDOW))
        return take, self.hashes(WINDOW, 1)[take], (self.hashes(WINDOW, 2)[take] >> np.uint64(32)).astype(np.uint32)


def parts(h: np.ndarray, n: int):
    b = (h >> np.uint64(16)) % np.uint64(n)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(n + 1, dtype=np.uint64))
    for k in range(n):
        if cut[k] < cut[k + 1]:
            yield k, order[cut[k]:cut[k + 1]]


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct pair, in order of the pairs; each place's pair number)."""
    order = np.argsort(h, kind="stable")
    again = h[order][1:] == h[order][:-1]
    if (again & (g[order][1:] != g[order][:-1])).any():  # one 64-bit hash, two windows
        order = np.lexsort((g, h))
        again = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~again
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def among(h: np.ndarray, g: np.ndarray, known_h: np.ndarray, known_g: np.ndarray) -> np.ndarray:
    """Whether each pair is among the known ones."""
    order = np.lexsort((known_g, known_h))
    known_h, known_g = known_h[order], known_g[order]
    found, live = np.zeros(len(h), bool), np.arange(len(h))
    at = np.searchsorted(known_h, h)
    while len(live):  # one round for each pair that shares a 64-bit hash
        live = live[at[live] < len(known_h)]
        live = live[known_h[at[live]] == h[live]]
        found[live] |= known_g[at[live]] == g[live]
        at[live] += 1
    return found


def packed(rows, names) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(names)
    kinds = [pa.int32() if x in ("bucket", "chunk") else pa.binary() for x in names]
    return pa.table({x: pa.array(list(c), k) for x, c, k in zip(names, cols, kinds)})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: ``kept`` is the remaining words joined by one space."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CHUNK_BYTES + 1)
    key = F.col(id_col).cast("bigint")
    docs = df.select(F.pmod(F.xxhash64(key, F.col(text)), F.lit(n)).cast("int").alias("chunk"), key.alias("id"),
                     F.xxhash64(F.col(text)).alias("tie"), F.col(text).cast("binary").alias("text"))

    def send_anchors(t: pa.Table) -> pa.Table:
        c = Chunk(t)
        h, count = np.unique(c.anchors()[1], return_counts=True)
        chunk = t["chunk"][0].as_py()
        return packed([(k, chunk, h[i].tobytes(), (count[i] > 1).tobytes()) for k, i in parts(h, n)],
                      ["bucket", "chunk", "h", "more"])

    def repeated_anchors(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, np.uint64) for x in t["h"].to_pylist()]
        more = np.concatenate([np.frombuffer(x, bool) for x in t["more"].to_pylist()])
        u, inv, cnt = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        again = cnt > 1
        again[inv[more]] = True
        return packed([(c, x[again[np.searchsorted(u, x)]].tobytes())
                       for c, x in zip(t["chunk"].to_pylist(), h)], ["chunk", "h"])

    def joined(t: pa.Table) -> np.ndarray:
        return np.sort(np.frombuffer(b"".join(t["h"].to_pylist()), np.uint64))

    def send_windows(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t):
            return packed([], ["bucket", "chunk", "h", "g", "id", "tie"])
        c = Chunk(t)
        take, h, g = c.windows(joined(r))
        first, _ = distinct(h, g)  # documents are in order: the first place is the smallest
        h, g = h[first], g[first]
        of = c.doc[take[first]]
        ids, ties = (np.array([r[k] for r in c.rows], np.int64)[of] for k in (0, 1))
        chunk = t["chunk"][0].as_py()
        return packed([(k, chunk, h[i].tobytes(), g[i].tobytes(), ids[i].tobytes(), ties[i].tobytes())
                       for k, i in parts(h, n)], ["bucket", "chunk", "h", "g", "id", "tie"])

    def later_windows(t: pa.Table) -> pa.Table:
        part = lambda k, d: [np.frombuffer(x, d) for x in t[k].to_pylist()]
        h, g = part("h", np.uint64), part("g", np.uint32)
        ids, ties = np.concatenate(part("id", np.int64)), np.concatenate(part("tie", np.int64))
        inv = distinct(np.concatenate(h), np.concatenate(g))[1]
        order = np.lexsort((ties, ids, inv))
        least = order[np.flatnonzero(np.diff(inv[order], prepend=-1))]  # the first document of each window
        late = (ids > ids[least[inv]]) | (ids == ids[least[inv]]) & (ties > ties[least[inv]])
        out, at = [], 0
        for c, x, y in zip(t["chunk"].to_pylist(), h, g):
            own = late[at:at + len(x)]
            out.append((c, x[own].tobytes(), y[own].tobytes()))
            at += len(x)
        return packed(out, ["chunk", "h", "g"])

    def cut(t: pa.Table, r1: pa.Table, late_h: np.ndarray, late_g: np.ndarray) -> pa.Table:
        c = Chunk(t)
        take, h, g = c.windows(joined(r1))
        late = np.ones(len(take), bool)
        late[distinct(h, g)[0]] = False
        late |= among(h, g, late_h, late_g)
        edge = np.zeros(len(c.w) + WINDOW + 1, np.int64)
        edge[take[late]] += 1
        edge[take[late] + WINDOW] -= 1
        keep = np.cumsum(edge)[:len(c.w)] == 0
        out, at = [], 0
        for row, ws in zip(c.rows, c.words):
            k = keep[at:at + len(ws)]
            at += len(ws)
            kept = b" ".join(ws if k.all() else [w for w, y in zip(ws, k) if y]).decode("utf-8", "replace")
            i = None if row[0] == NULL_ID else row[0]
            out += [(i, len(ws), int(len(ws) - k.sum()), kept)] * c.copies[row]
        cols = list(zip(*out))
        return pa.table({"id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()),
                         "n_removed": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.string())})

    def finish(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        import pyarrow.compute as pc
        late = r.filter(pc.field("step") == 2)
        flat = lambda k, d: np.frombuffer(b"".join(late[k].to_pylist()), d)
        return cut(t, r.filter(pc.field("step") == 1), flat("h", np.uint64), flat("g", np.uint32))

    sent = docs.groupBy("chunk").applyInArrow(send_anchors, "bucket int, chunk int, h binary, more binary")
    again = sent.groupBy("bucket").applyInArrow(repeated_anchors, "chunk int, h binary")
    wide = docs.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(
        send_windows, "bucket int, chunk int, h binary, g binary, id binary, tie binary")
    late = wide.groupBy("bucket").applyInArrow(later_windows, "chunk int, h binary, g binary")
    reply = again.withColumns({"g": F.lit(None).cast("binary"), "step": F.lit(1)}).unionByName(late.withColumn("step", F.lit(2)))
    out = docs.groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(
        finish, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    return remove_repeats(df).select("doc_id", "n_words", "n_removed",
                                     F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
