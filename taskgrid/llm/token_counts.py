"""Token counts by heap-and-linked-list byte-pair merging (operator 4).

A text's symbols form a linked list; a heap holds the adjacent pairs that the
vocabulary knows. The pair of lowest rank (highest score, leftmost on ties) is
popped and merged until none is left; the count is initial symbols minus merges
(an unknown character counts its bytes), and no identifier is made. No piece of
the vocabulary joins a space mark to what stands before it, nor a Latin letter
to another character (checked when it is loaded), so a text splits there without
changing the merges; counts of such words are remembered in a table of bounded
size.

Null counts as empty (no token). Repeated rows are counted each, an empty table
gives an empty one; texts are counted whole, word by word (a text that never splits
is one heap). A clashing column is replaced.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text

SPACE = "▁"
CACHE_WORDS = 200_000
LATIN = "A-Za-z\u00c0-\u024f"
_LOADED: dict = {}


def word_pattern(pieces) -> re.Pattern:
    """Splits a normalised text, nothing left out, only where no piece has both neighbouring characters."""
    def joined(pair: str) -> bool:
        return any(re.search(pair, p) for p in pieces)
    if joined(f"[^{SPACE}]{SPACE}"):
        return re.compile("(?s).+")
    if joined(f"[{LATIN}][^{LATIN}{SPACE}]|[^{LATIN}{SPACE}][{LATIN}]"):
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    return re.compile(f"{SPACE}*+[{LATIN}]+|{SPACE}*+[^{LATIN}{SPACE}]+|{SPACE}+")


class Merger:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        self.rank, self.known = {}, set()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.rank[p] = -sp.get_score(i)
                self.known.add(p)
        self.words = word_pattern(self.rank)
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        piece, rank = list(word), self.rank
        n = len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(piece[i] + piece[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, len(piece[i]) + len(piece[i + 1])))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not piece[a] or not piece[b] or nxt[a] != b or len(piece[a]) + len(piece[b]) != size:
                continue
            piece[a] += piece[b]
            piece[b] = ""
            merges += 1
            nxt[a] = c = nxt[b]
            if c < n:
                prv[c] = a
                if (r := rank.get(piece[a] + piece[c])) is not None:
                    heapq.heappush(heap, (r, a, c, len(piece[a]) + len(piece[c])))
            if (p := prv[a]) >= 0 and (r := rank.get(piece[p] + piece[a])) is not None:
                heapq.heappush(heap, (r, p, a, len(piece[p]) + len(piece[a])))
        unknown = sum(len(x.encode()) - 1 for x in word if x not in self.known)
        return n - merges + unknown

    def count(self, text: str) -> int:
        cache, total = self.cache, 0
        for w in self.words.findall(self.normalize(text)):
            n = cache.get(w)
            if n is None:
                if len(cache) >= CACHE_WORDS:  # words not met since the last change of tables go
                    self.old, self.cache = cache, {}
                    cache = self.cache
                n = self.old.get(w)
                cache[w] = n = self.count_word(w) if n is None else n
            total += n
        return total


def merger(path: str) -> Merger:
    if path not in _LOADED:
        _LOADED[path] = Merger(path)
    return _LOADED[path]


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def counts_column(text: Column, model: str | None = None, limit: int = 4096) -> Column:
    def make():
        m = merger(model or default_model())

        def one(data: bytes):
            n = m.count(data.decode("utf-8", "replace")) if data else 0
            return len(data), n, n > limit
        return one
    return per_text(text, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", model: str | None = None,
                 limit: int = 4096) -> DataFrame:
    """``df`` plus the struct ``out`` (n_bytes, n_tokens, over_limit)."""
    return df.withColumn(out, counts_column(F.col(text), model, limit))
