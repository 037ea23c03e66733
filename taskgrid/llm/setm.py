"""Phrase collocations by SETM relational mining (operator 13).

The occurrence relation R1 (block, place, word) is written once, sorted by place:
a place numbers the words of a block in reading order, with one empty place
between pieces, so places p and p + 1 hold adjacent words of one piece. A block is
a bounded run of texts of one language; its relation is one row, a packed array over
places of codes into the block's own list of phrases (0: no frequent phrase).

Each length is one round. The relation is merge-joined with itself at adjacent
places: two frequent phrases of k words at p and p + 1 share k - 1 words and make
one of k + 1, named by their pair. Every block counts its pairs, Spark sums the
counts by pair (group-count), phrases below the threshold go, and the blocks'
pairs are semi-joined with the frequent ones before the next relation is written.
All parts of a frequent phrase are frequent, so no phrase is lost.

The table of a length keeps, beside the words and the count, the counts of all
leading and all trailing parts, taken from the two halves. Scores use exact
decimals of 38 digits.

Null texts have no words, a null language is ``und``. Repeated rows and ids each
count. Ties end with the phrase's UTF-8 bytes. An empty table, or one without
frequent phrases, gives an empty result. Extra columns are not read. Long texts
are read in slices cut between pieces; a language that holds most rows has many
blocks, and a frequent phrase is one row per block before the sums.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taskgrid.llm.common import ship
from taskgrid.session import scratch_path

BLOCK_WORDS, HELD_WORDS, SLICE_BYTES = 1 << 20, 1 << 22, 1 << 18
BLOCKS_PER_FILE = 16
SCORE = ("cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0)) "
         "div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")
GAP = b"\xff"  # never part of UTF-8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + GAP * 10)


class Block:
    """Texts of one language on their way into the relation."""

    def __init__(self):
        self.vocabulary = defaultdict(count(1).__next__)
        self.vocabulary[GAP] = 0
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        text, at = text.translate(LOWER), 0
        while at < len(text):
            end = text.find(GAP, at + SLICE_BYTES) + 1 or len(text)
            words = (text[at:end] + GAP).replace(GAP, b" \xff ").split()
            self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            at = end


@lru_cache(1)
def codec():
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def packed(x: np.ndarray) -> bytes:
    """An integer array as one small binary value: byte planes, compressed (a relation holds millions of places a row)."""
    x = np.ascontiguousarray(x)
    return codec()[0](x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(codec()[1](data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed_words(words: list[bytes]) -> bytes:
    return codec()[0](b"\n".join(words))  # no word holds a line break


def unpacked_words(data: bytes) -> list[bytes]:
    joint = codec()[1](data)
    return joint.split(b"\n") if joint else []


def all_of(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([unpacked(x) for x in t[name].to_pylist()])


def occurrences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """R1 as rows (block, lang, n, words, counts, codes); word k of the list has code k + 1. Arrays are ``packed``."""
    read = docs.select(F.spark_partition_id().cast("bigint").alias("part"),
                       F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        blocks: dict[str, Block] = {}
        made = count()

        def rows(part: int, name: str):
            b = blocks.pop(name)
            codes, words = np.concatenate(b.codes), list(b.vocabulary)[1:]
            counts = np.bincount(codes, minlength=len(words) + 1)[1:]
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + next(made), "lang": name, "n": int(counts.sum()),
                "words": packed_words(words), "counts": packed(counts), "codes": packed(codes)}],
                schema=kind)
        part = 0
        for batch in batches:
            for p, name, text in zip(*batch.columns):
                part, name, text = p.as_py(), name.as_py(), text.as_py()
                if text:
                    own = blocks.setdefault(name, Block())
                    own.add(text)
                    if own.size >= BLOCK_WORDS:
                        yield rows(part, name)
                    while sum(b.size for b in blocks.values()) >= HELD_WORDS:  # many languages
                        yield rows(part, max(blocks, key=lambda k: blocks[k].size))
        for name in list(blocks):
            yield rows(part, name)
    kind = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()),
                      ("counts", pa.binary()), ("codes", pa.binary())])
    return read.mapInArrow(run, "block bigint, lang string, n bigint, words binary, counts binary, codes binary")


def joined(codes: np.ndarray, n: int) -> np.ndarray:
    """The merge join at adjacent places: the pair of codes at each place as one number, 0 where either is missing."""
    a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), a * (n + 1) + b, 0)


def dealt(batch_rows, buckets: int):
    """Record batches (bucket, a block's own values, packed arrays) of the parts for each bucket, from (own values, bucket
    of each element, columns)."""
    for own, to, columns in batch_rows:
        order = np.argsort(to, kind="stable")
        at, cut = np.unique(to[order], return_index=True)
        if len(at):
            parts = np.split(order, cut[1:])
            out = {"bucket": pa.array(at.astype(np.int64))} | {k: pa.array([v] * len(at)) for k, v in own.items()}
            for name, x in columns.items():
                out[name] = pa.array([packed(x[i]) if isinstance(x, np.ndarray) else packed_words([x[k] for k in i.tolist()])
                                      for i in parts], pa.binary())
            yield pa.record_batch(out)


def word_counts(relation: DataFrame, buckets: int) -> DataFrame:
    """Each block's words, their codes and occurrences, as arrays dealt to buckets by a hash of language and word."""
    def parts(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = unpacked_words(batch["words"][row].as_py())
                salt = zlib.crc32(batch["lang"][row].as_py().encode() + b" ")
                to = np.fromiter((zlib.crc32(w, salt) % buckets for w in words), np.int64, len(words))
                yield {"block": batch["block"][row].as_py(), "lang": batch["lang"][row].as_py()}, to, {
                    "word": words, "code": np.arange(1, len(words) + 1, dtype=np.int64),
                    "n": unpacked(batch["counts"][row].as_py())}
    return relation.select("block", "lang", "words", "counts").mapInArrow(
        lambda b: dealt(parts(b), buckets),
        "bucket bigint, block bigint, lang string, word binary, code binary, n binary")


def pair_counts(relation: DataFrame, buckets: int) -> DataFrame:
    """Each block's pairs (ids a and b) and their occurrences n, as arrays dealt to buckets by a hash of the pair."""
    def parts(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpacked(batch["ids"][row].as_py())
                key, n = np.unique(joined(unpacked(batch["codes"][row].as_py(), np.int32), len(ids)), return_counts=True)
                a, b = np.divmod(key[key > 0], len(ids) + 1)
                a, b, n = ids[a - 1], ids[b - 1], n[key > 0].astype(np.int64)
                mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(
                    0xD6E8FEB86659FD93)
                yield {"block": batch["block"][row].as_py()}, (mixed >> np.uint64(32)) % np.uint64(buckets), {"a": a, "b": b, "n": n}
    return relation.mapInArrow(lambda b: dealt(parts(b), buckets),
                               "bucket bigint, block bigint, a binary, b binary, n binary")


def per_block(block: np.ndarray, **columns):
    """Rows (block, arrays) of parallel arrays."""
    order = np.argsort(block, kind="stable")
    of, cut = np.unique(block[order], return_index=True)
    for name, at in zip(of.tolist(), np.split(order, cut[1:])):
        yield {"block": name} | {k: x[at] for k, x in columns.items()}


def grouped_words(sent: DataFrame, least: int) -> DataFrame:
    """As ``grouped`` for words: rows with block null (lang; word, f, id) and, for each block, one (code, id)."""
    def run(t: pa.Table) -> pa.Table:
        out, base = [], t["bucket"][0].as_py() << 32
        for lang in sorted(set(t["lang"].to_pylist())):
            own = t.filter(pc.equal(t["lang"], lang))
            lists = [unpacked_words(x) for x in own["word"].to_pylist()]
            words = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            code, n, at = all_of(own, "code"), all_of(own, "n"), words.indices.to_numpy()
            f = np.bincount(at, n, len(words.dictionary)).astype(np.int64)
            often = np.flatnonzero(f >= least)
            often = often[np.argsort(np.array(words.dictionary.take(pa.array(often)).to_pylist(), object), kind="stable")]
            ids = np.zeros(len(f), np.int64) - 1
            ids[often] = base + np.arange(len(often))
            base += len(often)
            if len(often):
                out.append({"lang": lang, "word": words.dictionary.take(pa.array(often)).to_pylist(), "f": f[often],
                            "id": ids[often]})
            hit = ids[at] >= 0
            block = np.repeat(own["block"].to_numpy(), [len(ws) for ws in lists])
            out += per_block(block[hit], code=code[hit], id=ids[at[hit]])
        return pa.Table.from_pylist(out, schema=kind)
    longs = pa.list_(pa.int64())
    kind = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.list_(pa.binary())), ("code", longs),
                      ("f", longs), ("id", longs)])
    return sent.groupBy("bucket").applyInArrow(
        run, "block bigint, lang string, word array<binary>, code array<bigint>, f array<bigint>, id array<bigint>")


def grouped(sent: DataFrame, least: int) -> DataFrame:
    """Group-count of a bucket: one row with its frequent pairs (block null: a, b, f, id) and, for each block that has
    some of them, one with those (a, b, id). Ids number a bucket's frequent pairs in order, so a lost task gives the same."""
    def run(t: pa.Table) -> pa.Table:
        n_lists = [unpacked(x) for x in t["n"].to_pylist()]
        a, b, n = all_of(t, "a"), all_of(t, "b"), np.concatenate(n_lists)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        f = np.add.reduceat(n[order], first)
        often = f >= least
        own = (t["bucket"][0].as_py() << 32) + np.cumsum(often) - 1
        out = [{"block": None, "a": a[first][often], "b": b[first][often], "f": f[often], "id": own[often]}]
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        keep = often[group]
        block = np.repeat(t["block"].to_numpy(), list(map(len, n_lists)))[order][keep]
        out += per_block(block, a=a[keep], b=b[keep], id=own[group[keep]])
        return pa.Table.from_pylist([r for r in out if len(r["a"])], schema=kind)
    longs = pa.list_(pa.int64())
    kind = pa.schema([("block", pa.int64()), ("a", longs), ("b", longs), ("f", longs), ("id", longs)])
    return sent.groupBy("bucket").applyInArrow(
        run, "block bigint, a array<bigint>, b array<bigint>, f array<bigint>, id array<bigint>")


def renamed(codes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, codes into them): the places whose number is among ``keys``, all others empty."""
    by_key, rank = np.argsort(keys), np.argsort(np.argsort(ids))
    k = np.minimum(np.searchsorted(keys, codes, sorter=by_key), len(keys) - 1)
    hit = by_key[k]
    return np.sort(ids), np.where(keys[hit] == codes, rank[hit] + 1, 0).astype(np.int32)


def semi_joined(relation: DataFrame, frequent: DataFrame, of_pairs: bool) -> DataFrame:
    """The relation of the frequent groups only. ``frequent``: (block, arrays id and code of words, or id, a and b)."""
    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        out = []
        for row in range(len(rows) if len(hits) else 0):
            codes = unpacked(rows["codes"][row].as_py(), np.int32)
            if of_pairs:
                known = unpacked(rows["ids"][row].as_py())
                codes = joined(codes, len(known))
                a, b, ids = (hits[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "id"))
                keys = (np.searchsorted(known, a) + 1) * (len(known) + 1) + np.searchsorted(known, b) + 1
            else:
                keys, ids = (hits[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("code", "id"))
            ids, codes = renamed(codes.astype(np.int64), keys, ids)
            out.append({"block": rows["block"][row].as_py(), "ids": packed(ids), "codes": packed(codes)})
        return pa.Table.from_pylist(out, schema=kind)
    kind = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("codes", pa.binary())])
    hits = frequent.select(*(F.col(c).alias(c) for c in frequent.columns))  # columns apart from the relation's
    return relation.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(
        run, "block bigint, ids binary, codes binary")


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, f"setm-{name}")
    df = df.coalesce(files) if files else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text",
                     lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """The tables of frequent phrases of 1 to ``longest`` words, and (lang, n), the words of each language.

    Tables: id, lang, words, f, heads and tails (counts of the first and last 1, 2, ... words), a, b (halves)."""
    ship(docs.sparkSession)
    r = saved(occurrences(docs, text, lang), "words")
    total, blocks = r.groupBy("lang").agg(F.sum("n").alias("n")), r.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    # written tables get files of some tens of MB, however finely the shuffles are cut
    files = max(docs.sparkSession.sparkContext.defaultParallelism, blocks // BLOCKS_PER_FILE)
    round_ = saved(grouped_words(word_counts(r, buckets), least), "round-1", files)
    own = F.array("f")
    tables = [saved(round_.filter("block is null").select("lang", F.inline(F.arrays_zip("word", "f", "id"))).select(
        "id", "lang", F.array("word").alias("words"), "f", own.alias("heads"), own.alias("tails"),
        F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")), "phrases-1", files)]
    hits = round_.filter("block is not null").select("block", "code", "id")
    r = saved(semi_joined(r.select("block", "codes"), hits, False), "relation-1", files)
    for k in range(2, longest + 1):
        round_ = saved(grouped(pair_counts(r, buckets), least), f"round-{k}", files)
        counted = round_.filter("block is null").select(F.inline(F.arrays_zip("a", "b", "f", "id")))
        left = tables[-1].select(F.col("id").alias("a"), "lang", F.col("words").alias("start"), F.col("heads").alias("h"))
        right = tables[-1].select(F.col("id").alias("b"), F.element_at("words", -1).alias("last"), F.col("tails").alias("t"))
        tables.append(saved(counted.join(left, "a").join(right, "b").select(
            "id", "lang", F.concat("start", F.array("last")).alias("words"), "f",
            F.concat("h", own).alias("heads"), F.concat("t", own).alias("tails"), "a", "b"), f"phrases-{k}", files))
        if k < longest:
            r = saved(semi_joined(r, round_.filter("block is not null").select("block", "a", "b", "id"), True),
                      f"relation-{k}", files)
    return tables, total


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, cover: int = 100, best: int = 2000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` collocations of 2 to ``longest`` words.

    A phrase goes if a longer frequent one holds it in at least ``cover`` of 100 of its occurrences."""
    tables, total = frequent_phrases(docs, longest, least, text, lang)
    parts = []
    for k, t in enumerate(tables[1:], 2):
        if k < longest:
            # a phrase inside a longer one lies in one of one word more, which occurs as often at least
            nxt = tables[k]
            above = nxt.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            t = t.join(above, "id", "left").filter(f"longer is null or 100 * longer < {cover} * f")
        parts.append(t.select("lang", "words", "f", "heads", "tails"))
    kept = reduce(DataFrame.unionByName, parts).join(total, "lang")
    score = SCORE.format(l="heads[k - 1]", r="tails[size(words) - k - 1]")
    cut = F.expr(f"""array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', {score}, 'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))""")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    scored = kept.withColumn("cut", cut).select(
        "lang", F.concat_ws(" ", F.col("words").cast("array<string>")).alias("phrase"), F.col("f").alias("a"), "cut.l",
        "cut.r", "n", "cut.score")
    return scored.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= best).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND NOT EXISTS (
      SELECT 1 FROM f x WHERE x.lang = f.lang AND x.k > f.k AND 100 * x.f >= 100 * f.f
      AND contains(' ' || x.phrase || ' ', ' ' || f.phrase || ' '))),
s AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, n,
             CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN total USING (lang)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
             phrase, a, l, r, n, score FROM b)
SELECT * FROM o WHERE rank <= 2000"""
