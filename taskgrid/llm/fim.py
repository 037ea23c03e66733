"""Fill-in-middle transformation over seekable compressed frames (operator 11).

``stored`` keeps each text as independent zstandard frames of at most
``FRAME_BYTES`` raw bytes, each with the lines and code points counted up to its
end. ``transformed`` picks two line ends by the seeded hash of the id and builds
the output from frames: only the one or two frames that hold a cut are
decompressed and split, all others are carried over as they are. ``digests``
streams the output's frames in order, one in memory at a time, and rebuilds the
text from output and form alone: it finds the three marks in the stream, then
seeks to prefix, middle and suffix. Frames are bounded whatever the length of a
text or of one line; a line may run over many frames.

Lines are ``[^\\n]*\\n|[^\\n]+``. Null texts count as empty. Empty texts, texts that
hold a mark, and the share of texts over ``rate`` stay plain. A null id hashes as
an empty string. Every row gives one row, so repeated rows and ids are alike and
an empty table gives an empty one. Columns named like a result column
(``units``, ``special``, ``frames``, ``form``, ``prefix_chars``, ``middle_chars``,
``output``) are replaced; all other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text, ship

FRAME_BYTES = 1 << 16
P, S, M = MARKS = (b"<P>", b"<S>", b"<M>")
FRAMES = "units bigint, special boolean, frames array<struct<units:bigint,chars:bigint,data:binary>>"


def code_points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "surrogateescape")) if not raw.isascii() else len(raw)


def packer():
    import zstandard
    z = zstandard.ZstdCompressor(level=3)

    def pack(text: bytes):
        out, units, chars, at = [], 0, 0, 0
        while at < len(text):
            end = min(at + FRAME_BYTES, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80 and end - at > FRAME_BYTES - 4:
                end -= 1  # whole code points
            raw = text[at:end]
            units += raw.count(b"\n") + (end == len(text) and raw[-1:] != b"\n")
            chars += code_points(raw)
            out.append((units, chars, z.compress(raw)))
            at = end
        return units, any(m in text for m in MARKS), out
    return pack


def stored(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``units``, ``special`` and ``frames`` in place of the text."""
    ship(df.sparkSession)
    s = df.withColumn("__store", per_text(F.col(text), FRAMES, packer)).drop(text)
    return s.withColumns({c: F.col(f"__store.{c}") for c in ("units", "special", "frames")}).drop("__store")


class Text:
    """One stored text: seeks line ends, hands out sections as frames."""

    def __init__(self, frames: list[dict]):
        import zstandard
        self.frames = frames
        self.ends = [f["units"] for f in frames]
        self.unpack, self.pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress

    def seek(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the end of the first ``unit`` lines."""
        if unit == 0:
            return 0, 0, 0
        k = bisect_left(self.ends, unit)
        raw = self.unpack(self.frames[k]["data"])
        at = -1
        for _ in range(unit - (self.ends[k - 1] if k else 0)):
            at = raw.find(b"\n", at + 1)
            if at < 0:  # the last line has no line break
                at = len(raw) - 1
        before = self.frames[k - 1]["chars"] if k else 0
        return k, at + 1, before + code_points(raw[:at + 1])

    def section(self, a: tuple, b: tuple) -> list[bytes]:
        """Frames of the text from place ``a`` to place ``b``; uncut frames are not decompressed."""
        out = []
        for k in range(a[0], min(b[0], len(self.frames) - 1) + 1):
            lo, hi = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
            data = self.frames[k]["data"]
            if lo or hi is not None:
                raw = self.unpack(data)
                if raw[lo:hi] == raw:
                    out.append(data)
                elif raw[lo:hi]:
                    out.append(self.pack(raw[lo:hi]))
            else:
                out.append(data)
        return out


def rearranged(frames: list[dict], form: str, first: int, second: int):
    """(output frames, prefix code points, middle code points)."""
    t = Text(frames)
    if form == "plain":
        return [f["data"] for f in frames], None, None
    end = (len(frames), 0, frames[-1]["chars"])
    a, b = t.seek(first), t.seek(second)
    prefix, middle, suffix = t.section((0, 0, 0), a), t.section(a, b), t.section(b, end)
    p, s, m = map(t.pack, MARKS)
    out = [p, *prefix, s, *suffix, m, *middle] if form == "psm" else [s, *suffix, p, *prefix, m, *middle]
    return out, a[2], b[2] - a[2]


def arrow_rows(fn, ddl: str, *cols: Column) -> Column:
    """A struct column of ``fn`` over the values of ``cols``, Arrow batches to the task's Python."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(ddl)
    kind = to_arrow_type(schema)

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([dict(zip(schema.names, fn(*(v.as_py() for v in r)))) for r in zip(*rows.flatten())], kind)
    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)(F.struct(*cols))


def plan(store: DataFrame, id_col: str, seed: int, rate: int, spm: int) -> DataFrame:
    """``store`` with the form and the two cuts of every row (columns __form, __a, __b)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    plain = (F.col("units") == 0) | F.col("special") | (h[2] % 100 >= rate)
    n = F.col("units") + 1
    return store.withColumn("__h", digest).withColumns({
        "__form": F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"),
        "__a": F.least(h[0] % n, h[1] % n), "__b": F.greatest(h[0] % n, h[1] % n)}).drop("__h")


def transformed(store: DataFrame, id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``store`` with ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` (frames); its own frames are dropped.

    Of 100 texts ``rate`` are transformed, of these ``spm`` of 100 in the order suffix, prefix, middle."""
    ship(store.sparkSession)
    t = plan(store, id_col, seed, rate, spm).withColumn("__t", arrow_rows(
        rearranged, "output array<binary>, prefix_chars bigint, middle_chars bigint",
        F.col("frames"), F.col("__form"), F.col("__a"), F.col("__b")))
    return t.withColumn("form", F.col("__form")).withColumns(
        {c: F.col(f"__t.{c}") for c in ("prefix_chars", "middle_chars", "output")}).drop(
        "frames", "__form", "__a", "__b", "__t")


def marks(frames: list[bytes]) -> dict[bytes, int]:
    """Byte offsets of the marks in the stream of ``frames``."""
    import zstandard
    d = zstandard.ZstdDecompressor()
    found, at, tail = {}, 0, b""
    for f in frames:
        raw = tail + d.decompress(f)
        for m in MARKS:
            if m not in found and (i := raw.find(m)) >= 0:
                found[m] = at - len(tail) + i
        at += len(raw) - len(tail)
        tail = raw[-2:]
    return found | {b"": at}


def stream(frames: list[bytes], start: int = 0, end: int | None = None):
    """The bytes from ``start`` to ``end`` of the frames' stream, one frame at a time; others are not decompressed."""
    import zstandard
    d, at = zstandard.ZstdDecompressor(), 0
    for f in frames:
        size = zstandard.frame_content_size(f)
        if at + size > start and (end is None or at < end):
            yield d.decompress(f)[max(start - at, 0):None if end is None else end - at]
        at += size


def original(frames: list[bytes], form: str):
    """The bytes of the text that an output was made of, streamed."""
    if form == "plain":
        yield from stream(frames)
        return
    m = marks(frames)
    prefix_end, suffix_end = (m[S], m[M]) if form == "psm" else (m[M], m[P])
    yield from stream(frames, m[P] + 3, prefix_end)
    yield from stream(frames, m[M] + 3, m[b""])
    yield from stream(frames, m[S] + 3, suffix_end)


def digests(output: Column, form: Column) -> Column:
    """Struct (output_sha256, restored_sha256) of an output and of the text rebuilt from it."""
    def both(frames, form):
        import hashlib
        a, b = hashlib.sha256(), hashlib.sha256()
        for raw in stream(frames):
            a.update(raw)
        for raw in original(frames, form):
            b.update(raw)
        return a.hexdigest(), b.hexdigest()
    return arrow_rows(both, "output_sha256 string, restored_sha256 string", output, form)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The query's columns over ``docs`` (doc_id, text); the store is written to ``path``."""
    stored(docs.select("doc_id", "text")).write.parquet(path)
    out = transformed(docs.sparkSession.read.parquet(path))
    return out.withColumn("d", digests(F.col("output"), F.col("form"))).select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", "d.output_sha256", "d.restored_sha256")


SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
v AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS c1,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS p,
             coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
             coalesce(array_to_string(units[greatest(c1, c2) + 1:], ''), '') AS s FROM v)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM w"""
