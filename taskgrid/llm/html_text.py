"""Main text of web pages by line-block distribution (operator 12).

``lines`` strips the markup: every block element starts a new line, white space
inside a line becomes one space, character references are decoded. Elements that
hold no article text (scripts, styles, menus, headers, footers, sidebars, forms,
notices, adverts, comments: by tag name, role, or class and id words) leave
``WINDOW`` blank lines instead, and so do the edges of ``article`` and ``main``.
``spans`` sums the text lengths over windows of ``WINDOW`` lines: a surge point is
where the sum leaves zero, a dive point where it falls back to zero. Outside
``article`` and ``main`` letters in links do not count, nor do lines that are mostly
links. Of the spans between surge and dive, those of the ``article`` (or else
``main``) with the most text are kept, whatever their length. On a page without
such an element, the span with the most text is kept and every other one whose
window sums reach ``SURGE``. The text between the points is returned whole.

Null or empty html, or a page without text, gives an empty text. Broken markup is
read to its end: an unclosed element ends with its parent, ``article`` and ``main``
end an unclosed wrapper. Rows are taken one by one, so repeated rows and ids are
alike, an empty table gives an empty one, and the cost is linear in the length of
a page. The result replaces a column of the given name; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskgrid.llm.common import per_text, ship

WINDOW, SURGE = 3, 86
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|$|/)""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select", "object", "canvas",
           "audio", "video", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "input", "ins", "kbd", "label", "mark", "meta", "link", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "source", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr", "picture",
          "param", "embed", "track", "area", "base", "col"}
SPACED = {"br", "td", "th"}
VOID = {"br", "img", "input", "meta", "link", "hr", "wbr", "source", "param", "embed", "track", "area", "base", "col"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"},
          "dd": {"dt", "dd"}, "option": {"option"}}
HINT = (r"ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adbox|adslot|sponsor|sponsored|promo|promotion|banner|cookie|cookies|"
        r"consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
        r"login|share|sharing|social|related|recommended|recommendations|sidebar|sidebars|side|menu|menus|nav|navbar|"
        r"navigation|breadcrumb|breadcrumbs|pagination|pager|toolbar|masthead|header|footer|copyright|widget|widgets|form")
DISCUSSION = r"comment|comments|commentlist|disqus|respond|replies|discussion"
HINTS = re.compile(rf"(?!(?:has|with|no|is|not)[-_])(?:(?:site|page|top|bottom|left|right|main|global|user|reader)[-_])?"
                   rf"(?:(?:{HINT})[-_])*(?:({HINT})|({DISCUSSION}))(?:[-_](?:box|bar|block|area|section|wrapper|wrap|container|list|unit|slot|"
                   rf"top|bottom|left|right|links?|item|thread|\d+))?$", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu",
         "menubar", "form", "toolbar"}


def boilerplate(tag: str, attributes: str) -> str:
    """``drop``, ``header`` (by its tag alone) or ``discussion`` where an element holds no article text, else empty."""
    kind = "header" if tag == "header" else "drop" if tag in DROPPED else ""
    if tag in ("html", "body", "article", "main") or not attributes:
        if tag != "article":
            return kind
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                m = HINTS.match(word)
                if m and m[2]:
                    return "discussion"
                if m and tag not in HEADINGS and tag != "article":
                    kind = "drop"
        elif tag == "article":
            continue
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            kind = "drop"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            kind = "drop"
    return kind


class Page:
    """Reads a page's markup into lines of (text, weight, scope); blank lines separate what belongs apart.

    ``scope`` numbers the outermost ``article`` or ``main`` around a line (0: none)."""

    def __init__(self, html: str):
        self.out: list[tuple[str, int, int]] = []
        self.kinds = [""]  # of each scope: "", article or main
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, str, int]] = []  # tag, what it drops, scope outside it
        self.opened: Counter[str] = Counter()
        self.dropped, self.scope = Counter(), 0  # open elements that drop their text, by reason
        self.read(html)

    def gap(self) -> None:
        self.out += [("", 0, self.scope)] * WINDOW

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            letters = len(text) - text.count(" ")
            weight = len(text) if self.scope else 0 if 2 * self.linked > letters else letters - self.linked
            self.out.append((text, weight, self.scope))
        self.parts, self.linked = [], 0

    def silent(self) -> bool:
        """Inside an element without article text (in an article's own header, headings do speak)."""
        n = self.dropped.total()
        return n > 0 and (n > self.dropped["header"] or not any(self.opened[h] for h in HEADINGS))

    def text(self, raw: str) -> None:
        if raw and not self.silent():
            said = unescape(raw) if "&" in raw else raw
            self.parts.append(said)
            if self.opened["a"]:
                self.linked += len("".join(said.split()))

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES:
            while self.stack and self.stack[-1][0] in CLOSES[tag] | INLINE - {"td", "th"} and any(
                    self.opened[t] for t in CLOSES[tag]):
                self.pop()
        elif tag not in INLINE and self.stack and self.stack[-1][0] == "p":
            self.pop()
        if tag not in INLINE:
            self.end_line()
            while self.stack and self.stack[-1][0] in INLINE and self.stack[-1][0] not in ("td", "th", "a", "span"):
                self.pop()
        elif tag in SPACED:
            self.parts.append(" ")
        if tag in VOID:
            return
        drop = boilerplate(tag, attributes)
        if tag in ("article", "main") and not drop and self.dropped.total() and not (
                self.dropped["discussion"] or self.opened["aside"] or self.opened["nav"] or self.opened["footer"]):
            while self.dropped.total():  # an unclosed or page-wide wrapper
                self.pop()
        if drop == "header" and not self.scope:
            drop = "drop"  # only an article's own header holds headings of the article
        if drop and not self.dropped.total():
            self.end_line()
            self.gap()
        self.stack.append((tag, drop, self.scope))
        self.opened[tag] += 1
        if drop:
            self.dropped[drop] += 1
        if tag in ("article", "main") and not self.dropped.total() and self.kinds[self.scope] != "article" and (
                tag == "article" or not self.scope):
            self.gap()
            self.kinds.append(tag)
            self.scope = len(self.kinds) - 1
            self.gap()

    def pop(self) -> None:
        tag, drop, outside = self.stack.pop()
        if tag not in INLINE or drop:
            self.end_line()
        self.opened[tag] -= 1
        if drop:
            self.dropped[drop] -= 1
            if not self.dropped.total():
                self.gap()
        if outside != self.scope:
            self.gap()
            self.scope = outside
            self.gap()

    def close(self, tag: str) -> None:
        for k in () if not self.opened[tag] else range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag in INLINE and self.stack[k][0] not in INLINE or self.stack[k][0] in ("article", "main") and tag not in (
                    "article", "main", "body", "html"):
                break
        if tag in SPACED:
            self.parts.append(" ")
        elif tag not in INLINE:
            self.end_line()

    def read(self, html: str) -> None:
        at = 0
        while (m := TOKEN.search(html, at)):
            self.text(html[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else len(html)
            elif m[3].endswith("/") and tag in VOID | INLINE:
                if tag in SPACED:
                    self.parts.append(" ")
            else:
                self.open(tag, m[3])
        self.text(html[at:])
        self.end_line()


def spans(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, end, largest window sum) of the text of each span between a surge and its dive point."""
    sums = [sum(weights[k:k + WINDOW]) for k in range(len(weights))]
    out, start = [], None
    for k, n in enumerate([*sums, 0]):
        if n and start is None:
            start = k
        elif not n and start is not None:
            filled = [j for j in range(start, k) if weights[j]]
            out.append((filled[0], filled[-1] + 1, max(sums[start:k])))
            start = None
    return out


def main_text(html: str) -> str:
    page = Page(html)
    texts, weights, scopes = (list(c) for c in zip(*page.out)) if page.out else ([], [], [])
    found = spans(weights)
    mass: Counter[int] = Counter()
    for a, b, _ in found:
        mass[scopes[a]] += sum(weights[a:b])
    for kind in ("article", "main"):
        best = max((s for s in mass if page.kinds[s] == kind), key=lambda s: (mass[s], -s), default=None)
        if best is not None:
            kept = [x for x in found if scopes[x[0]] == best]
            break
    else:
        top = max(found, key=lambda x: sum(weights[x[0]:x[1]]), default=None)
        kept = [x for x in found if x == top or x[2] >= SURGE]
    return "\n\n".join(t for a, b, _ in kept for t in texts[a:b] if t)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in column ``into``."""
    ship(pages.sparkSession)

    def make():
        return lambda raw: (main_text(raw.decode("utf-8", "replace")),)
    return pages.withColumn(into, per_text(F.col(html), "text string", make)["text"])


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
