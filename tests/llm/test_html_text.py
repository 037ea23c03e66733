"""Operator 12: known articles in built pages, the given pages against a plain reading of their fixed layout."""
import html
import random
import re

from taskgrid.llm import html_text
from tests.conftest import SF001

CLUTTER = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All the news of the day, every day, in long words</a></li></ul></nav>',
    '<header class="site-header"><h2>Site name</h2><p>Slogan of the site.</p></header>',
    '<div class="ad">Buy now, only today, the best price that you have ever seen in your whole life!</div>',
    '<aside><h3>More</h3><p>Another story that is long enough to look like a part of the article itself.</p></aside>',
    '<div class="cookie-notice"><p>We use cookies to give you the best experience on our site, as everyone does.</p></div>',
    '<form action="/s"><label>Search the whole site</label><input name="q"><select><option>one<option>two</select></form>',
    '<script>var a = "<p>not text</p>"; if (a < 3) { b("</div>"); }</script><style>p > a { color: red }</style>',
    '<!-- <p>a comment with markup</p> -->',
    '<div id="sidebar"><p>Popular articles of the last week and the week before that one, for readers.</p></div>',
    '<div hidden><p>Never shown to anyone who reads the page in a usual browser of today.</p></div>',
    '<noscript><p>Switch on scripts to see this page with all its features, please.</p></noscript>',
]
COMMENTS = ('<section id="comments"><h3>Comments</h3><article class="comment"><p>I do not agree with a single word of this '
            'text, and I have read all of it twice, which took me more than a whole hour of my life.</p></article></section>')
FOOTER = '<footer>&copy; 2024 example.org &middot; All rights reserved, everywhere, forever and a day.</footer>'


def article(rng):
    """(markup, blocks) of an article whose blocks are known."""
    out, blocks = [], []
    for _ in range(rng.randint(1, 7)):
        words = [rng.choice(["the", "stone", "wall", "naïve", "3 < 4", "R&D", "Übung", "\"so\"", "x"]) for _ in range(rng.choice([1, 2, 30, 90]))]
        text = " ".join(words)
        marked = html.escape(text).replace(" ", rng.choice([" ", "\n  ", " <b>", "&nbsp;", "</b> "]), 1)
        tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "pre", "div"])
        out.append(f"<{tag} class=x{rng.randint(0, 9)}>{marked}" + (f"</{tag}>" if tag != "p" or rng.random() < .5 else ""))
        blocks.append(" ".join(text.split()))
        if rng.random() < .3:
            out.append(rng.choice(CLUTTER))
    return "".join(out), blocks


def test_known_articles_among_clutter():
    rng = random.Random(5)
    for k in range(300):
        marked, blocks = article(rng)
        around = [rng.choice(CLUTTER) for _ in range(rng.randint(0, 4))]
        tag = rng.choice(["article", "main", "article"])
        page = (f"<!DOCTYPE html><html><head><title>Title text</title></head><body class='has-sidebar'>{''.join(around)}"
                f"<{tag}>{marked}</{tag}>{rng.choice(CLUTTER)}{COMMENTS}{FOOTER}" + rng.choice(["</body></html>", ""]))
        assert html_text.main_text(page) == "\n\n".join(blocks), (k, page)


def test_distribution_decides_without_article_element():
    text = ["The first paragraph of the story is long enough to make the sums surge at once, as it should.",
            "Short.", "The last paragraph tells how the whole matter ended, with a good deal of text as well."]
    links = "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(9))
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div><p>v 1.2</p></body>"
    assert html_text.main_text(page) == "\n\n".join(text)


def test_broken_and_odd_markup():
    m = html_text.main_text
    assert m("") == m("<!-- open") == m("<script>x") == ""
    assert m("<article>a < b &amp;amp; c&nbsp;&nbsp;d <3 &eacute;&#233;&#xe9;</article>") == "a < b &amp; c d <3 ééé"
    assert m("<ARTICLE><P>One<BR>two<P>three<TABLE><TR><TD>a<TD>b<TR><TD>c</TABLE>") == "One two\n\nthree\n\na b\n\nc"
    assert m("<div class=ad>unclosed <article><p>story</p></article>") == "story"
    assert m("<form><nav>menu</nav><article><header><h1>Head</h1><p>by me</p></header><p>story</article></form>") == "Head\n\nstory"
    assert m("<article><a href=\"x>y\" title='it''s'>all</a> linked</article>") == "all linked"
    assert m("<article>" + "<div><b>" * 20_000 + "deep" + "</section></div>" * 20_000 + "</article>") == "deep"
    long = "word " * 400_000
    assert m(f"<nav>n</nav><article><p>{long}</p></article>") == long.strip()


def test_query_on_given_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r for r in html_text.digest(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(x.replace("<b>", "").replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, "old"), (None, "u", "<article>x", "old"), (1, "u", "", "old"), (1, "u", "", "old")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert sorted(r.text for r in out) == ["", "", "", "x"]
    assert [r.n_chars for r in html_text.digest(df).collect()] == [0, 1, 0, 0]
    assert html_text.digest(df.limit(0)).collect() == []
