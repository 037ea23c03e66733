"""Secret scan with one combined deterministic automaton (operator 1).

Every rule is a regular expression over bytes. The rules are compiled together
by Thompson's construction, determinised by subset construction and minimised
by partition refinement. The automaton accepts the *reversed* rules, so one
right-to-left pass over a text's bytes marks, for all rules at once, every
position where some match starts. From the leftmost start each rule's own
forward automaton finds the longest match; the next match starts after it.

A private key is covered from its BEGIN line to its END line (without one, up to
the next dashed line or the text's end).

Null texts count as empty and have no spans. Repeated rows are scanned each, an
empty table gives an empty one; a text of any length is one pass, each match one
more over its own bytes. An input column named like the result column is replaced. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; one is kept if it has ``min_chars`` bytes
    after the longest match of ``head`` at its start."""
    kind: str
    pattern: str
    min_chars: int = 0
    head: str = ""


KEY = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
       r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
HEAD = KEY + r"""["']?\x20*[:=]\x20*["']?"""
BASE_KINDS = ("assign", "access", "hex")
# all up to the next five dashes, which begin the END line, or up to the text's end
KEY_BODY = r"([^\-]|-[^\-]|--[^\-]|---[^\-]|----[^\-])*"
# The base rules, then further public token formats.
RULES = (
    Rule("assign", HEAD + r"[A-Za-z0-9+/_.=\-]+", 12, HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY(\x20BLOCK)?-----" + KEY_BODY
         + r"(-----END\x20[A-Z\x20]*PRIVATE\x20KEY(\x20BLOCK)?-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30),
)


def parse(pattern: str):
    """Syntax tree of a pattern: literals, escapes, classes, groups, ``|``, ``? * + {n}``."""
    pos = 0

    def escaped() -> int:
        nonlocal pos
        pos += 1
        if pattern[pos] == "x":
            pos += 3
            return int(pattern[pos - 2:pos], 16)
        pos += 1
        return ord(pattern[pos - 1])

    def char_class():
        nonlocal pos
        pos += 1
        negate = pattern[pos] == "^"
        pos += negate
        out = set()
        while pattern[pos] != "]":
            low = one()
            if pattern[pos] == "-" and pattern[pos + 1] != "]":
                pos += 1
                out |= set(range(low, one() + 1))
            else:
                out.add(low)
        pos += 1
        return ("set", frozenset(set(range(256)) - out if negate else out))

    def one() -> int:
        nonlocal pos
        if pattern[pos] == "\\":
            return escaped()
        pos += 1
        return ord(pattern[pos - 1])

    def atom():
        nonlocal pos
        if pattern[pos] == "(":
            pos += 1
            node = either()
            pos += 1
            return node
        return char_class() if pattern[pos] == "[" else ("set", frozenset([one()]))

    def item():
        nonlocal pos
        node = atom()
        while pos < len(pattern) and pattern[pos] in "?*+{":
            sign = pattern[pos]
            pos += 1
            if sign == "{":
                end = pattern.index("}", pos)
                node = ("seq", [node] * int(pattern[pos:end]))
                pos = end + 1
            else:
                node = ({"?": "opt", "*": "star", "+": "plus"}[sign], node)
        return node

    def sequence():
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            parts.append(item())
        return ("seq", parts)

    def either():
        nonlocal pos
        parts = [sequence()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            parts.append(sequence())
        return ("alt", parts)

    return either()


def mirrored(node):
    kind, arg = node
    if kind == "set":
        return node
    if kind in ("seq", "alt"):
        parts = [mirrored(x) for x in arg]
        return (kind, parts[::-1] if kind == "seq" else parts)
    return (kind, mirrored(arg))


class Automaton:
    """Minimal deterministic automaton of several syntax trees.

    ``rows[state][byte]`` is the next state, ``accepts[state]`` the bit mask of
    the trees that match there. ``anywhere`` lets a match begin at any byte;
    otherwise state ``dead`` is final loss."""

    def __init__(self, trees, anywhere: bool):
        empty, steps, final = [[]], [[]], {}

        def new() -> int:
            empty.append([])
            steps.append([])
            return len(empty) - 1

        def build(node, at: int) -> int:
            kind, arg = node
            if kind == "set":
                end = new()
                steps[at].append((arg, end))
                return end
            if kind == "seq":
                for x in arg:
                    at = build(x, at)
                return at
            end = new()
            if kind == "alt":
                for x in arg:
                    first = new()
                    empty[at].append(first)
                    empty[build(x, first)].append(end)
                return end
            first = new()
            empty[at].append(first)
            last = build(arg, first)
            empty[last].append(end)
            if kind in ("opt", "star"):
                empty[at].append(end)
            if kind in ("plus", "star"):
                empty[last].append(first)
            return end

        for k, tree in enumerate(trees):
            first = new()
            empty[0].append(first)
            final[build(tree, first)] = 1 << k

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for x in empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        # bytes that no step tells apart share a class
        sign = [tuple(b in s for out in steps for s, _ in out) for b in range(256)]
        names = {s: i for i, s in enumerate(dict.fromkeys(sign))}
        of_byte = [names[s] for s in sign]
        sample = [of_byte.index(i) for i in range(len(names))]
        start = closed([0])
        ids, todo, table = {start: 0}, [start], []
        for now in todo:
            row = []
            for b in sample:
                nxt = closed({end for x in now for s, end in steps[x] if b in s} | ({0} if anywhere else set()))
                if nxt not in ids:
                    ids[nxt] = len(todo)
                    todo.append(nxt)
                row.append(ids[nxt])
            table.append(row)
        accepts = [sum(final.get(x, 0) for x in now) for now in todo]
        block = list(accepts)  # minimise: split blocks until their rows agree
        while True:
            keys = {}
            new_block = [keys.setdefault((block[i], tuple(block[j] for j in row)), len(keys))
                         for i, row in enumerate(table)]
            if len(keys) == len(set(block)):
                break
            block = new_block
        block = new_block
        n = len(set(block))
        self.accepts, rows = [0] * n, [None] * n
        for i, row in enumerate(table):
            self.accepts[block[i]] = accepts[i]
            rows[block[i]] = [block[row[c]] for c in of_byte]
        self.rows, self.start = rows, block[0]
        self.dead = {i for i in range(n) if not self.accepts[i] and set(rows[i]) == {i}}

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        state, end = self.start, at if self.accepts[self.start] else -1
        for i in range(at, len(data)):
            state = self.rows[state][data[i]]
            if state in self.dead:
                break
            if self.accepts[state]:
                end = i + 1
        return end


class Scanner:
    def __init__(self, rules=RULES):
        trees = [parse(r.pattern) for r in rules]
        self.rules = rules
        self.forward = [Automaton([t], False) for t in trees]
        self.heads = [Automaton([parse(r.head)], False) if r.head else None for r in rules]
        back = Automaton([mirrored(t) for t in trees], True)
        # nested rows: a row holds its successors' rows; entry 256 is the accept mask
        self.rows = [[None] * 256 + [m] for m in back.accepts]
        for row, nexts in zip(self.rows, back.rows):
            row[:256] = [self.rows[x] for x in nexts]
        self.start = self.rows[back.start]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted."""
        row, starts, i = self.start, [], len(data)
        for b in reversed(data):
            row = row[b]
            i -= 1
            if row[256]:
                starts.append((i, row[256]))
        if not starts:
            return []
        starts.reverse()
        out = []
        for k, rule in enumerate(self.rules):
            free = 0
            for at, mask in starts:
                if at < free or not mask >> k & 1:
                    continue
                free = end = self.forward[k].longest(data, at)
                body = self.heads[k].longest(data, at) if self.heads[k] else at
                if end - body >= rule.min_chars:
                    out.append((at, k, end))
        return sorted(out)


_SCANNERS: dict = {}


def scanner(rules) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def spans_column(text: Column, rules=RULES) -> Column:
    """``spans``: array of (kind, start, end); ``redacted``: the text with each
    covered stretch replaced by ``[SECRET]``."""
    def make():
        scan = scanner(rules)

        def one(data: bytes):
            found = scan.spans(data)
            if not found:
                return [], None
            spans, at, chars, cp = [], 0, 0, {}
            for p in sorted({x for s, _, e in found for x in (s, e)}):
                chars += len(data[at:p].decode("utf-8", "replace"))
                cp[p], at = chars, p
            for s, k, e in found:
                spans.append({"kind": rules[k].kind, "start": cp[s], "end": cp[e]})
            parts, at = [], 0
            for s, _, e in found:
                if s >= at:
                    parts += [data[at:s], b"[SECRET]"]
                at = max(at, e)
            return spans, b"".join([*parts, data[at:]]).decode("utf-8", "replace")
        return one
    return per_text(text, "spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string", make)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", rules=RULES) -> DataFrame:
    """``df`` plus the struct ``out`` (spans, redacted; redacted is null without a span)."""
    return df.withColumn(out, spans_column(F.col(text), rules))


def redact(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced."""
    cols = df.columns
    hit = scan(df, text, "__secrets", rules)
    return (hit.withColumn(text, F.coalesce(F.col("__secrets.redacted"), F.col(text))).select(*cols))


def digest(df: DataFrame) -> DataFrame:
    s = F.col("secrets.spans")
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    n = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    return scan(df.select("doc_id", "text")).select(
        "doc_id", *[n(k) for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, show)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(s, show)).alias("spans"))
