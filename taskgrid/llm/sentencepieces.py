"""SentencePiece encoding and decoding with N-best segmentations (operator 8).

A text's piece lattice has an edge for every piece of the vocabulary that
matches at a place. Forward Viterbi gives each place its best score from the
start; these are exact heuristics for an A-star search from the end, which
yields segmentations in order of total score. No piece joins a space mark to
what stands before it, nor a Latin letter to another character (checked on
loading), so the lattice of a text is a chain of word lattices: each word is
searched by itself (its best segmentation and the loss of its second best
remembered in a bounded table), and the text's N best are the N best choices of one
segmentation per word, found by N-best searches of the N - 1 words whose second best
loses least. All N come back as ids.

Scores are those of the model file. A character that no piece covers becomes its
byte pieces at the lowest score less 10. Ties rank by pieces' ids from the end.
Null and empty texts have one empty segmentation. Decoding gives the text back.
Repeated rows are encoded each, an empty table gives an empty one, texts are taken
whole in groups of about ``GROUP_CHARS`` characters (a longer text is a group of its
own). A column named like the result is replaced; others pass through.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse, tee
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text
from taskgrid.llm.token_counts import SPACE, default_model, word_pattern

CACHE_WORDS = 300_000
ALTERNATIVES = 20_000
GROUP_CHARS = 2 << 20
IDS_AT_ONCE = 1 << 18
MISS = object()
NONE = -1e300  # no path
_LOADED: dict = {}
_DECODERS: dict = {}


class WordTable:
    """Per word its best score, the ids of that segmentation and the loss of the second best, in flat arrays.

    ``turn`` (between groups of texts) starts a new table when this one holds ``CACHE_WORDS`` words; words of the one
    before are kept only if they are met again."""

    def __init__(self, make):
        self.make, self.old = make, None
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.score, self.loss, self.ends, self.flat = array("d"), array("d"), array("q"), array("i")

    def turn(self):
        if len(self.number) >= CACHE_WORDS:
            self.old = (self.number, self.score, self.loss, self.ends, self.flat)
            self.clear()

    def add(self, w: str) -> None:
        k = self.old[0].get(w) if self.old else None
        if k is None:
            score, ids, loss = self.make(w)
        else:
            _, scores, losses, ends, flat = self.old
            score, ids, loss = scores[k], flat[ends[k - 1] if k else 0:ends[k]], losses[k]
        self.number[w] = len(self.score)
        self.score.append(score)
        self.loss.append(loss)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))


class Decoder:
    def __init__(self, path: str):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
                    for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]
        # all pieces' bytes in one array, and where each starts
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids) -> str:
        """Text of the ids: pieces and bytes joined, space marks read as spaces, the dummy first one dropped."""
        ids, out = np.asarray(ids, np.int64), []
        for k in range(0, len(ids), IDS_AT_ONCE):
            part = ids[k:k + IDS_AT_ONCE]
            long = self.size[part]
            ends = np.cumsum(long)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.start[part] - ends + long, long)].tobytes())
        text = b"".join(out).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Lattice(Decoder):
    def __init__(self, path: str):
        super().__init__(path)
        sp = self.sp
        self.ids, self.score, self.bytes = {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p], self.score[p] = i, sp.get_score(i)
        self.unknown = min(s for s in self.score.values() if s > -1e8) - 10
        # every end of a piece with the piece's score, None where it is no piece itself: a miss ends a search
        self.known = {p[k:]: None for p in self.ids for k in range(1, len(p))} | self.score
        self.last, self.into, self.best, self.tick = "", [[]], [0.0], 0
        self.words = word_pattern(self.ids)
        self.table = WordTable(self.word)
        self.alternatives = lru_cache(ALTERNATIVES)(self.n_best_ids)

    def forward(self, word: str) -> None:
        """Per end: (start, score) of the pieces that end there (``into``); each place's best score (Viterbi).

        All depend only on what stands before a place, so the part that ``word`` shares with the last word stays."""
        known, score, into, best = self.known.get, self.score, self.into, self.best
        same = 0
        for x, y in zip(word, self.last):
            if x != y:
                break
            same += 1
        del into[same + 1:], best[same + 1:]
        self.last = word
        for b in range(same + 1, len(word) + 1):
            ends, top = [], NONE
            if word[b - 1] not in score:
                ends.append((b - 1, self.unknown))
                top = best[b - 1] + self.unknown
            for a in range(b - 1, -1, -1):
                s = known(word[a:b], MISS)
                if s is None:
                    continue
                if s is MISS:  # at the latest past the longest piece
                    break
                ends.append((a, s))
                x = best[a] + s
                if x > top:
                    top = x
            ends.reverse()
            into.append(ends)
            best.append(top)

    def search(self, word: str, n: int) -> Iterator[tuple[float, tuple, float]]:
        """The segmentations of ``word`` in order of score, up to ``n``: (score, cuts, the next one's score or NONE).

        Cuts are nested pairs, the first piece's start outermost. As the heuristics are exact, the head of the frontier
        has the score of the next segmentation, and each entry stands for a path of its own with that score, so no
        more entries than paths still wanted can matter."""
        if word != self.last:
            self.forward(word)
        into, best = self.into, self.best
        size = len(word)
        # sorted, best last; of equals the newest is taken first: towards the start
        ahead, room = [(best[size], 0, size, 0.0, ())], n
        while ahead and room:
            f, tick, at, done, cuts = ahead.pop()
            if at == 0:
                room -= 1
                yield f, cuts, ahead[-1][0] if ahead else NONE
                continue
            for a, s in into[at]:
                f = done + s + best[a]
                if len(ahead) < room:
                    tick = self.tick = self.tick + 1
                    insort(ahead, (f, tick, a, done + s, (cuts, a)))
                elif f >= ahead[0][0]:
                    del ahead[0]
                    tick = self.tick = self.tick + 1
                    insort(ahead, (f, tick, a, done + s, (cuts, a)))

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple]]:
        return [(f, cuts) for f, cuts, _ in self.search(word, n)]

    def pieces(self, word: str, cuts: tuple) -> list[int]:
        out, b = [], 0
        while cuts:
            cuts, a = cuts
            b = cuts[1] if cuts else len(word)
            i = self.ids.get(word[a:b])
            out += [i] if i is not None else [self.bytes[x] for x in word[a:b].encode()]
        return out

    def n_best_ids(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        return [(s, np.array(self.pieces(word, cuts), np.int32)) for s, cuts in self.n_best(word, n)]

    def word(self, w: str) -> tuple:
        """(best score, its ids, loss of the second best), from a search for two."""
        score, cuts, second = next(self.search(w, 2))
        return score, array("i", self.pieces(w, cuts)), score - second if second > NONE else float("inf")

    def encode(self, text: str, n: int) -> tuple[bytes, list[float]]:
        """Ids (int32 bytes) of the best segmentation and the ``n`` best scores."""
        return next(self.encode_all([text], n))[:2]

    def encode_all(self, texts: Iterable[str], n: int) -> Iterator[tuple[bytes, list[float], list[tuple]]]:
        """``encode`` of each text, and where its second to ``n``-th best segmentations differ from the best: (rank from 1,
        place in the ids, how many go, the ids put there). Texts are taken in groups whose new words are searched in sorted order, so that
        neighbours share the front of their lattices."""
        group, size = [], 0
        for t in texts:
            group.append(self.words.findall(self.sp.normalize(t)) if t else [])
            size += len(t)
            if size >= GROUP_CHARS:
                yield from self.encode_group(group, n)
                group, size = [], 0
        yield from self.encode_group(group, n)

    def encode_group(self, group: list[list[str]], n: int) -> Iterator[tuple[bytes, list[float], list[tuple]]]:
        table = self.table
        table.turn()
        for w in sorted(filterfalse(table.number.__contains__, set().union(*group))):
            table.add(w)
        number, score, loss = table.number, np.array(table.score), np.array(table.loss)
        flat, ends_of = np.array(table.flat), np.array(table.ends)
        size = np.diff(ends_of, prepend=0)
        start = ends_of - size
        for ws in group:
            if not ws:
                yield b"", [0.0], []
                continue
            at = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            long = size[at]
            ends = np.cumsum(long)
            of_text = flat[np.arange(ends[-1]) + np.repeat(start[at] - ends + long, long)]
            best = self.best_choices(ws, float(score[at].sum()), loss[at], n)
            changes = [(r, int(ends[k] - long[k]), int(long[k]), x) for r, (_, c) in enumerate(best)
                       for k, x in sorted(c, key=itemgetter(0))]
            yield of_text.tobytes(), [x for x, _ in best], changes

    def best_choices(self, ws: list[str], top: float, loss: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """The ``n`` best (score, choice) of the words ``ws`` together, from the best score and each word's smallest
        loss; a choice is the (word's place, its ids) that differ from the best."""
        best = [(top, ())]
        # the n best differ from the best in at most n - 1 words, those of smallest loss
        few = np.argpartition(loss, n - 2)[:n - 1].tolist() if 1 < n <= len(ws) else range(len(ws) if n > 1 else 0)
        for k in few:
            if loss[k] < np.inf:
                alt = self.alternatives(ws[k], n)
                first = alt[0][0]
                best = heapq.nlargest(n, [(t + s - first, (*c, (k, x)) if j else c)
                                          for t, c in best for j, (s, x) in enumerate(alt)], key=itemgetter(0))
        return best


def lattice(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def decoder(path: str) -> Decoder:
    if path not in _LOADED and path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _LOADED.get(path) or _DECODERS[path]


def encode(df: DataFrame, text: str = "text", out: str = "pieces", n_best: int = 4, model: str | None = None,
           check: bool = False) -> DataFrame:
    """``df`` plus ``out``: ids of the best segmentation, the ``n_best`` scores, the ids of the second to ``n_best``-th
    segmentation (``others``), and with ``check`` whether decoding gives the text back (a space mark in the text
    itself reads as a space)."""
    def make():
        m = lattice(model or default_model())

        def every(texts):
            texts, later = tee(t.decode("utf-8", "replace") for t in texts)
            for t, (ids, scores, changes) in zip(later, m.encode_all(texts, n_best)):
                ids = np.frombuffer(ids, np.int32)
                same = not check or m.decode(ids) == t.replace(SPACE, " ")
                yield ids, scores, changes, same
        return every
    found = per_text(F.col(text), "ids array<int>, scores array<double>, changes array<struct<rank:int,at:int,gone:int,"
                                  "ids:array<int>>>, round_trip boolean", make, every=True)
    # only the changed words leave Python; the ids of the other segmentations are put together here
    p = F.col(out)
    ranks = F.slice(F.array(*[F.lit(r) for r in range(1, max(n_best, 2))]), 1, F.size(p["scores"]) - 1)
    return df.withColumn(out, found).withColumn(out, F.struct(
        p["ids"].alias("ids"), p["scores"].alias("scores"),
        F.transform(ranks, lambda r: changed(p["ids"], F.filter(p["changes"], lambda c: c["rank"] == r))).alias("others"),
        p["round_trip"].alias("round_trip")))


def changed(ids: Column, changes: Column) -> Column:
    """``ids`` with ``changes`` (in the order of their places) made."""
    start = F.struct(F.slice(ids, 1, 0).alias("done"), F.lit(0).alias("at"))
    return F.aggregate(changes, start, lambda x, c: F.struct(
        F.concat(x["done"], F.slice(ids, x["at"] + 1, c["at"] - x["at"]), c["ids"]).alias("done"),
        (c["at"] + c["gone"]).alias("at")),
        lambda x: F.concat(x["done"], F.slice(ids, x["at"] + 1, F.size(ids))))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` plus ``out``: the text of the column ``ids`` (an array of piece ids; null gives an empty text)."""
    def run(rows: pa.Array) -> pa.Array:
        text = decoder(model or default_model()).decode
        return pa.array([text(r or []) for r in rows.to_pylist()], pa.string())
    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))
