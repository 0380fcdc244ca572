"""Main text against the generator's plain structure, and the style tree on planted sites."""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict
from math import log

import pytest

from funnelworks.llm import html
from tests.conftest import SF_MEDIUM


def plain_article(page):
    """The pages' article, by the shape that the test tables have."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", inner))
    return "\n".join(t for t in (" ".join(references.unescape(x).split()) for x in parts) if t)


def test_query_on_the_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_MEDIUM}/pages.parquet").collect()}
    rows = html.op5_style_tree(spark, SF_MEDIUM).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain_article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar">
<header><h2>Site</h2></header><div class="page has-sidebar"><div id="cookie-notice">We use cookies</div>
<article class="post"><header><h1>The &lt;title&gt;</h1></header><p>One &amp; two&nbsp;<b>three</b><p>Four<br>five <i>six</i>.
<ul><li>item <a href='x>y'>a</a><li>item b</ul><div class="ad-slot">Buy!</div><script>var a = "</p>";</script><form><input>Send</form>
<!-- hidden <p>no</p> --><table><tr><td>c1<td>c2</table><blockquote>said</blockquote>tail</article>
<section class="comments"><article class="comment">Nice post</article></section><aside>More</aside></div>
<footer>&copy; x</footer></body></html>"""


def test_structure():
    want = "The <title>\nOne & two three\nFour five six.\nitem a\nitem b\nc1\nc2\nsaid\ntail"
    assert html.main_text(ARTICLE) == want
    assert html.main_text(ARTICLE[: ARTICLE.index("said") + 4]) == want.rsplit("\n", 1)[0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<div><p>a</p></b></div></div>x < y<p", "a\nx < y"),
        ("<p>" + "<b>" * 5000 + "deep" + "</b>" * 5000, "deep"),
        ("<body><div class=content><p>in</p></div><div role=navigation>menu</div></body>", "in"),
        ("<main><p>m</p><nav>n</nav></main><p>out</p>", "m"),
        ("<article><p>a\n\t b&#8203;&eacute;&am;</p></article><article>c</article>", "a b​é&am;\nc"),
        ("<p>cut <a href=\"http", "cut"),
        ("<script>unclosed <p>no</p>", ""),
        ("<!-- open <p>no</p>", ""),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 id="related-work">R</h2><p class=notice>n</p><p>a</p></article>', "R\nn\na"),
        ('<article><section id="search"><h2 id="social-history">S</h2>b</section><div class="share-box">x</div></article>', "S\nb"),
        ('<main><h2 id="alert">A</h2><p>c <span class=widget>d</span></p><div id=comments>x</div></main>', "A\nc d"),
        ("<main><h1>T</h1><p>the text</p><article><p>teaser</p></article></main>", "T\nthe text\nteaser"),
        ("<main><h1>T</h1><p>the text</p></main><article><p>teaser</p></article>", "T\nthe text"),
        ("<main><article><p>a</p></article><nav>x</nav></main>", "a"),
        ("<main><p>Skip</p></main><article><p>the long text</p></article>", "the long text"),
        ('<h2 id="related-work">out</h2><p>in</p>', "in"),
    ],
)
def test_names_in_articles_and_main(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "branch",
    [
        '<ol class="comment-list"><li class="comment">x</li></ol>', '<div id="comments">x</div>', '<section id="comments">x</section>',
        '<p class="advert">x</p>', '<ul class="menu"><li>x</ul>', "<template><p>x</p></template>", '<div class="siteNav">x</div>',
        '<div class="ad-300x250">x</div>', '<div class="share-links">x</div>', '<div class="skip-link">x</div>',
    ],
)
def test_furniture_inside_an_article(branch):
    assert html.main_text(f"<article><h1>T</h1><p>a</p>{branch}<p>b</p></article>") == "T\na\nb"
    assert html.main_text(f"<p>a</p>{branch}<p>b</p>") == "a\nb"


@pytest.mark.parametrize("name", ["social-science", "skip-list", "research-search", "related-work", "menu-history", "no-comment"])
def test_names_of_article_text(name):
    for page in (f'<article><div class="{name}">x</div></article>', f'<div class="{name}" id="{name}"><p>x</p></div>'):
        assert html.main_text(page) == "x"


def brute_low(pages):
    """The topmost low branches of a host's pages, from their features one by one."""
    looks = list({tuple(html.page_features(p)) for p in pages})
    m, at, parent = len(looks), defaultdict(Counter), {}
    for found in looks:
        for path, above, kind, value in found:
            at[path, kind][value] += 1
            parent[path] = above

    def entropy(counts):
        n = sum(counts.values())
        return -sum(k / n * log(k / n) for k in counts.values()) / log(n) if n > 1 else 1.0

    def worth(path):
        parts = [worth(c) for c in parent if parent[c] == path and c != path and (c, "s") in at]
        if at[path, "t"]:
            spread = [1 - log(k) / log(m) for k in at[path, "t"].values() for _ in range(k)]
            chars = [(v >> 32, v & (2**32 - 1)) for v, k in at[path, "a"].items() for _ in range(k)]
            text = 1.0 if "article" in path else 1 - sum(a for a, _ in chars) / sum(b for _, b in chars)
            own = (sum(spread) / len(spread) * text, len(spread))
        if not parts:
            return own if at[path, "t"] else (1.0, 0)
        parts += [own] if at[path, "t"] else []
        size = sum(w for _, w in parts)
        inner = sum(c * w for c, w in parts) / size if size else 1.0
        fade = 0.9 ** len(at[path, "s"])
        return (1 - fade) * entropy(at[path, "s"]) + fade * inner, size

    low = set()
    for path in parent:
        tag = path.rpartition(">")[2].split(".")[0]
        inside = "article" in path
        if tag in ("html", "body", "article") or (inside and tag in html.PLAIN) or not path:
            continue
        w, size = worth(path)
        if size and w < 0.3 * (1 - 2 / m if inside else 1):
            low.add(path)
    return sorted(p for p in low if not any(p.startswith(f"{q}>") for q in low))


def unnamed_site(n):
    """Pages whose furniture has no telling names: a greeting, a strip of links that differ, a note in the article."""
    return [
        f"<body><div class=a1><p>Welcome to us</p></div><div class=b2><ul><li><a href=/{i}>topic {i}</a></li><li><a href=/x{i}>field {i}</a></ul></div>"
        f"<div class=c3><h2><a href=/{i}>Title {i}</a></h2><p>Own text {i} with <a href=/>a link</a> in it.</p></div>"
        f"<div class=d-{i}f3a7c{i}><span>Imprint and terms</span></div></body>"
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_tree_equals_brute_force_and_needs_no_names(spark, n):
    sites = {
        "plain.example.com": unnamed_site(n),
        "art.example.com": [f"<article><div class=q1><p>long own text {i} of this page</p></div><div class=z9>Read on</div></article>" for i in range(n)],
        "links.example.com": [f"<article><p>text {i}</p><div class=refs><a href=/{i}>source {i}</a></div></article>" for i in range(n)],
    }
    rows = [(i, f"http://{h}/{i}", page) for h, pages in sites.items() for i, page in enumerate(pages)]
    docs = spark.createDataFrame(rows * 2, "page_id long, url string, html string")
    got = {r["host"]: sorted(r["noise"]) for r in html.noise_paths(html.style_tree(docs)).collect()}
    want = {h: brute_low(pages) for h, pages in sites.items() if n > 1}
    assert got == {h: low for h, low in want.items() if low}
    texts = {(r["url"].split("/")[2], r["page_id"]): r["text"] for r in html.extract(docs).collect()}
    if n > 1:
        assert texts["plain.example.com", 1] == "Title 1\nOwn text 1 with a link in it."
    assert texts["art.example.com", 0] == "long own text 0 of this page" + ("" if n > 2 else "\nRead on")
    assert texts["links.example.com", 0] == "text 0\nsource 0"


def site(spark):
    """A host whose pages share a block with a telling name nowhere, and small hosts."""
    rows = []
    for i in range(12):
        body = f"<div class=c><p>unique text number {i} of the page</p><p>Licence line.</p></div>"
        rows.append((i, f"https://user@Big.example.com:80/a/{i}?q=//x", f"<body><div class=x1><p>Welcome to the site</p><span>all pages</span></div>{body}</body>", "e"))
        rows.append((100 + i, "http://art.example.com/", f"<article><p>first {i}</p><p>Same end.</p><div class=z9>Read on elsewhere</div></article>", "e"))
        rows.append((200 + i, "http://copies.example.com/", "<div><p>the very same page</p></div>", "e"))
    rows += [(300, "http://one.example.com/", rows[0][2], "e"), (301, None, "<p>no url", "e"), (302, "not a url", None, "e"), (None, "http://one.example.com/", "<p>x", "e")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, noise string")


def test_style_tree_removes_low_branches(spark):
    rows = html.extract(site(spark)).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[3] == "unique text number 3 of the page\nLicence line."
    assert got[104] == "first 4\nSame end."
    assert got[205] == "the very same page"  # the tree would leave nothing
    assert got[300].startswith("Welcome to the site\nall pages\n")  # too few pages to judge
    assert (got[301], got[302], got[None]) == ("no url", "", "x")
    assert len(rows) == 40


def test_copies_of_an_article_keep_their_text(spark):
    """Copies of a page, and pages that differ in little, hold no noise for what they repeat."""
    page = "<body><div class=wrap><article><h1>Title</h1><div class=body><p>The whole text of it.</p></div></article></div></body>"
    rows = [(i, f"http://copies.example.com/?utm={i}", page) for i in range(12)]
    rows += [(100 + i, "http://mirror.example.com/", page.replace("</body>", f"<p>page {i}</p></body>")) for i in range(12)]
    # one page in many copies beside others: a block of every other page is no site block
    rows += [(200 + i, "http://mixed.example.com/", f"<div class=a><p>Shared {min(i, 9)}</p></div><p>text {min(i, 9)}</p>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert {got[i] for i in (*range(12), *range(100, 112))} == {"Title\nThe whole text of it."}
    assert got[203] == "Shared 3\ntext 3" and got[399] == "Shared 9\ntext 9"


def test_shuffled_noise_gives_the_same(spark, monkeypatch):
    want = sorted(map(tuple, html.extract(site(spark)).collect()), key=str)
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html.extract(site(spark)).collect()), key=str) == want


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
