"""Main-text extraction with a site style tree.

The pages of one host are merged into a style tree: nodes with the same path
(tags and class names from the body down) are one element node, with the
distribution of its instances' child sequences (presentation styles) and of the
text blocks directly in it (content).  Following the entropy measures of the
site style tree:

* presentation importance of a node: the entropy of its styles, to the base of
  its instances, so a layout that never varies has none;
* content importance: 1 - ln k / ln m, averaged over its blocks, where k of the
  host's m pages have the block: what every page says has none; times the part
  of the node's text on the host that is not in links, so outside an article a
  list of links has none either, whatever it says (headings may be links);
* composite importance: (1 - g**l) * presentation + g**l * the children's mean
  (``DAMPING`` g, l styles); a node without element children has its content
  importance.  A node whose tag, class, id or role names page furniture (menu,
  header, footer, sidebar, notice, advert, form, reader comments ...) has none.

Branches below ``LEAST_IMPORTANCE`` go, from two different pages of a host on;
inside an article below that times 1 - 2/m, as few articles repeat a passage by
chance.  Furniture by name goes on every host: a class or id names furniture when
all its words do, apart from those for a place (``site-nav``) or a box
(``comment-list``), so ``related-work`` is none.  Plain text elements (paragraphs,
headings, lists ...) inside an article are never judged on their own, so a line
that many articles repeat stays.  Pages of a host with the same paths, styles
and blocks count once, however often they occur.  Where a page marks its article
(``article``, ``main``) the text is taken from there alone: from the main element
where that has text of its own beside articles (and no less than the articles
outside it), else from the articles.  Inside an article ids are mostly anchors and
plain elements mostly text: there ids and classes of plain elements tell furniture
by fewer names, and headings never do.  Low branches that hold most of an article's
text, or all but its headings, stay.  If the tree leaves a page nothing, or nothing
but headings, its branches come back.

White space inside a block becomes one space, blocks are joined by one line
feed, character references are decoded; nothing else is changed.

Defined results: a null or empty html gives an empty text; a null or odd url
belongs to the host ``''``; broken markup is read as browsers do in the usual
cases (unclosed paragraphs and items, stray end tags, cut off pages); repeated
rows are returned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from math import log
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import stored, table

LEAST_IMPORTANCE = 0.3
#: An article of which the low branches are more than this part keeps them.
MOST = 0.6
DAMPING = 0.9
#: Elements nested deeper become siblings, as in browsers.
DEPTH = 512
#: Noise paths of up to this many hosts and characters are broadcast; more are
#: joined by shuffle.  The texts are the same.
BROADCAST_HOSTS = 50_000
BROADCAST_CHARS = 8 << 20

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section "
    "select summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption".split())
#: An open element of the key is closed by the start of one of these.
CLOSED_BY = {
    "p": BLOCKS - frozenset("li dd dt td th tr tbody thead tfoot caption option optgroup legend summary html body".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
}
#: An implied end does not reach past these.
SCOPES = frozenset("table ul ol dl select article section div body main aside nav header footer form".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button select input dialog menu svg canvas object template".split()) | RAW
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay comment comments respond disqus share sharing social related recommended newsletter subscribe subscription "
    "login signup search pagination pager toolbar widget skip skiplink".split()
)
#: Words beside a furniture name: for a place on the page, or for a box, list or link.
PLACES = frozenset("site main top bottom left right primary secondary page global header post article user reader mobile sticky wp".split())
BOXES = frozenset(
    "list box links link bar block section area container wrapper wrap slot item items unit panel form button buttons "
    "group inner thread posts articles stories".split()
)
#: What names furniture inside an article, too: classes of plain elements, ids.
TEXT_CLASSES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising sponsor "
    "sponsored comment comments respond disqus share sharing newsletter pagination".split()
)
TEXT_IDS = frozenset("breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement comment comments respond disqus".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Furniture outside an article only: an article's own header holds its title.
OUTER_NAMES = frozenset(["header", "topbar", "hero"])
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HASH = re.compile(r"(?<![^_-])(?=[^_-]*\d)[^_-]{5,}(?![^_-])")


def names(given: str, places: frozenset[str] = PLACES) -> Iterator[frozenset[str]]:
    """Of each class or id that is there, what it names, without words for places
    and boxes; ``skip`` needs a link or menu beside it."""
    for token in given.split():
        found = [w.lower() for w in _WORDS.findall(token) if len(w) > 1]
        left = frozenset(found) - places - BOXES
        if left == {"skip"} and len(found) > 1 and not {"link", "links", "main"} & set(found):
            continue
        if left:
            yield left


def label(tag: str, classes: str) -> str:
    """Tag and class names; numbers and hashes in them are folded."""
    return ".".join([tag, *sorted({_DIGITS.sub("0", _HASH.sub("0", c)) for c in classes.split()})])


class Node:
    """An element with its children in order (nodes, and text as str)."""

    __slots__ = ("children", "furniture", "label", "outer", "tag", "within")

    def __init__(self, tag: str, rest: str = "", within: str = "") -> None:
        """``within``: the innermost kind of article around it, '' outside."""
        self.tag, self.children, self.outer, self.within = tag, [], tag == "header", within
        self.furniture, self.label = tag in FURNITURE_TAGS, tag
        if rest.strip(" \t\r\n/"):
            given = {k.lower(): references.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)}
            roles = set(given.get("role", "").lower().split())
            hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
            found = list(self._names(given))
            if tag not in ARTICLE | {"body", "html"} or roles & FURNITURE_ROLES or any("comment" in f for f in found):
                self.furniture |= bool(any(f <= FURNITURE_NAMES for f in found) or roles & FURNITURE_ROLES or hidden)
            self.outer |= any(f <= OUTER_NAMES for f in names(f"{given.get('class', '')} {given.get('id', '')}", PLACES - OUTER_NAMES))
            if classes := given.get("class"):
                self.label = label(tag, classes)

    def _names(self, given: dict[str, str]) -> Iterator[frozenset[str]]:
        """What its class and id name, as far as that counts where it stands."""
        classes, own = given.get("class", ""), given.get("id", "")
        if not self.within and self.tag in HEADINGS & PLAIN:  # outside, any such word in a heading's name tells a box's heading
            yield from (frozenset([w.lower()]) for w in _WORDS.findall(f"{classes} {own}"))
        elif not self.within or self.tag in ARTICLE:
            yield from names(f"{classes} {own}")
        elif self.tag in HEADINGS & PLAIN or self.tag not in BLOCKS:
            return
        elif self.tag in PLAIN:
            yield from (f for f in names(classes) if f <= TEXT_CLASSES)
        else:
            yield from names(classes)
            whole = self.within == "main" and self.tag == "div"
            yield from (f for f in names(own) if whole or f <= TEXT_IDS)

    @property
    def is_article(self) -> bool:
        return self.tag in ARTICLE


def parse(page: str) -> Node:
    """The page's element tree."""
    root = Node("html")
    stack, at, met_article = [root], 0, False
    while found := _TOKEN.search(page, at):
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if found["name"] is None:
            continue
        tag = found["name"].lower()
        if found["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES and tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
                    break
            continue
        if tag == "html":
            continue
        if tag == "body" and any(n.tag == "body" for n in stack):
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        holder = stack[-1]
        within = "article" if "article" in (holder.tag, holder.within) else "main" if holder.tag == "main" else holder.within
        node = Node(tag, found["rest"], within)
        if tag in ARTICLE and not node.furniture and not met_article:
            # what holds the article is no furniture, whatever its class says ("with-sidebar")
            met_article = True
            for holder in stack:
                if holder.tag not in FURNITURE_TAGS:
                    holder.furniture = holder.outer = False
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _below(path: str, node: Node) -> str:
    """The path of a node in ``path``; inline elements have their block's."""
    if node.tag not in BLOCKS:
        return path
    return f"{path}>{node.label}" if path else node.label


def clean(text: str) -> str:
    return " ".join(references.unescape(text).split())


def blocks(node: Node, skip, path: str = "", inside: bool = False) -> Iterator[tuple[str, str]]:
    """(path of its block element, cleaned text) of every block, without the
    branches for which ``skip(node, path, inside an article)`` holds.  An
    explicit stack keeps deep pages from exhausting Python's."""
    pieces: list[str] = []
    home = path
    todo: list[tuple] = [("open", node, path, inside)]
    while todo:
        what, node, path, inside = todo.pop()
        if what == "text":
            pieces.append(node)
            continue
        if what == "flush":
            if text := clean("".join(pieces)):
                yield home, text
            pieces, home = [], path
            continue
        if skip(node, path, inside):
            if node.tag in BLOCKS:
                todo.append(("flush", None, home, inside))
            continue
        if node.tag == "br":
            pieces.append(" ")
            continue
        inside = inside or node.is_article
        is_block = node.tag in BLOCKS
        here = _below(path, node)
        if is_block:
            todo.append(("flush", None, path, inside))
        for child in reversed(node.children):
            todo.append(("text", child, here, inside) if isinstance(child, str) else ("open", child, here, inside))
        if is_block:
            todo.append(("flush", None, here, inside))
    if text := clean("".join(pieces)):
        yield home, text


def _by_name(node: Node, path: str, inside: bool) -> bool:
    return node.furniture or (node.outer and not inside)


def nodes(root: Node) -> Iterator[tuple[str, str, Node]]:
    """(parent's path, path, node) of the block elements left by name."""
    todo = [("", root, False)]
    while todo:
        path, node, inside = todo.pop()
        if _by_name(node, path, inside):
            continue
        here = _below(path, node)
        if node.tag in BLOCKS:
            yield path, here, node
        inside = inside or node.is_article
        todo += [(here, c, inside) for c in node.children if not isinstance(c, str)]


def _style(node: Node) -> int:
    """A number for the sequence of child elements, repeats folded."""
    labels = [c.label for c in node.children if not isinstance(c, str) and c.tag in BLOCKS]
    return crc32(",".join(a for a, b in zip(labels, [None, *labels]) if a != b).encode())


def link_shares(root: Node) -> dict[str, tuple[int, int]]:
    """Per path of a block element: characters of text in links, and of all text,
    in that element itself; headings count as without links."""
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    todo: list[tuple] = [(root, "", False, False)]
    while todo:
        node, path, inside, linked = todo.pop()
        if isinstance(node, str):
            size = len(clean(node))
            found[path][0] += size * linked
            found[path][1] += size
        elif not _by_name(node, path, inside):
            linked = (linked or node.tag == "a") and node.tag not in HEADINGS
            here, inside = _below(path, node), inside or node.is_article
            todo += [(c, here, inside, linked and not _is_heading(here)) for c in node.children]
    return {path: (a, b) for path, (a, b) in found.items() if b}


def page_features(page: str | None) -> list[tuple[str, str, str, int]]:
    """(path, parent's path, kind, number) of a page, each once: 's' a style, 't' a
    block, 'a' the characters of its links (times 2**32) and of all its text."""
    root = parse(page or "")
    found = {(path, parent, "s", _style(node)) for parent, path, node in nodes(root)}
    for path, text in blocks(root, _by_name):
        digest = blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
        found.add((path, path.rpartition(">")[0], "t", int.from_bytes(digest, "big", signed=True)))
    for path, (linked, size) in link_shares(root).items():
        found.add((path, path.rpartition(">")[0], "a", min(linked, 2**31 - 1) << 32 | min(size, 2**31 - 1)))
    return sorted(found)


def main_text(page: str | None, noise: frozenset[str] = frozenset()) -> str:
    """The page's text, without furniture by name and the ``noise`` paths."""
    root = parse(page or "")

    def by_tree(node: Node, path: str, inside: bool) -> bool:
        return _by_name(node, path, inside) or _below(path, node) in noise

    for skip in (by_tree, _by_name) if noise else (_by_name,):
        for tag in ("main", "article") if _own_main(root) else ("article", "main"):
            if texts := _article_texts(root, tag, skip):
                break
        else:
            found = list(blocks(root, skip))
            if skip is by_tree and all(_is_heading(path) for path, _ in found):
                continue
            texts = [text for _, text in found]
        if texts:
            return "\n".join(texts)
    return ""


def _own_main(root: Node) -> bool:
    """Whether the main elements have text outside articles, and no less text
    than the articles that are not in them."""

    def size(node: Node, path: str, inside: bool, skip=_by_name) -> int:
        return sum(len(text) for _, text in blocks(node, skip, path, inside))

    def no_article(node: Node, path: str, inside: bool) -> bool:
        return node.tag == "article" or _by_name(node, path, inside)

    mains = _outermost(root, "main", _by_name)
    if not any(size(*m, no_article) for m in mains):
        return False
    held = {id(a) for m, path, inside in mains for a, _, _ in _outermost(m, "article", _by_name, path, inside)}
    outside = sum(size(*a) for a in _outermost(root, "article", _by_name) if id(a[0]) not in held)
    return sum(size(*m) for m in mains) >= outside


def _article_texts(root: Node, tag: str, skip) -> list[str]:
    """The blocks of the page's ``tag`` nodes without the branches to skip,
    unless those hold most of the text."""
    parts = _outermost(root, tag, _by_name)
    named = [list(blocks(node, _by_name, path, inside)) for node, path, inside in parts]
    if skip is _by_name:
        return [text for part in named for _, text in part]
    found = {id(node) for node, _, _ in _outermost(root, tag, skip)}
    if _holds_most(sum(named, []), [b for (node, _, _), part in zip(parts, named) if id(node) in found for b in part]):
        found = {id(node) for node, _, _ in parts}
    texts: list[str] = []
    for (node, path, inside), part in zip(parts, named):
        if id(node) in found:
            left = list(blocks(node, lambda n, p, i, top=node: n is not top and skip(n, p, i), path, inside))
            texts += [text for _, text in (part if _holds_most(part, left) else left)]
    return texts


def _holds_most(blocks: list[tuple[str, str]], left: list[tuple[str, str]]) -> bool:
    """Whether what is not ``left`` of the blocks is most of them, or all but headings."""
    if sum(len(t) for _, t in left) < (1 - MOST) * sum(len(t) for _, t in blocks):
        return True
    return len(left) < len(blocks) and all(_is_heading(path) for path, _ in left)


def _is_heading(path: str) -> bool:
    return path.rpartition(">")[2].split(".")[0] in HEADINGS


def _outermost(root: Node, tag: str, skip, path: str = "", inside: bool = False) -> list[tuple[Node, str, bool]]:
    """The ``tag`` nodes that stand in no other one, in page order."""
    found, todo = [], [(root, path, inside)]
    while todo:
        node, path, inside = todo.pop()
        if skip(node, path, inside):
            continue
        if node.tag == tag:
            found.append((node, path, inside))
            continue
        here = _below(path, node)
        todo += [(c, here, inside or node.is_article) for c in reversed(node.children) if not isinstance(c, str)]
    return found


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged tree: host, path, parent, and per path the sums that its
    importance needs (instances, styles, entropy terms, characters)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for name, page in zip(batch.column(0), batch.column(1)):
                found = page_features(page.as_py())
                digest = blake2b(repr(found).encode("utf-8", "replace"), digest_size=16).digest()
                rows.setdefault((name.as_py(), digest), [*found, ("", "", "m", 0)])
            names, digests = zip(*rows) if rows else ((), ())
            features = [[dict(zip(("path", "parent", "kind", "value"), f)) for f in found] for found in rows.values()]
            kind = pa.list_(pa.struct([("path", pa.string()), ("parent", pa.string()), ("kind", pa.string()), ("value", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(digests, pa.binary()), pa.array(features, kind)], names=["host", "page", "found"]
            )

    read_pages = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(
        read, "host string, page binary, found array<struct<path: string, parent: string, kind: string, value: long>>"
    )
    # copies of a page count once; its features are far smaller than its html
    distinct = read_pages.groupBy("host", "page").agg(F.first("found").alias("found"))
    features = distinct.select("host", F.explode("found").alias("f")).select("host", "f.*")
    # by value first, which spreads a large host over all tasks; a row per node is left of it
    each = features.groupBy("host", "path", "parent", "kind", "value").agg(F.count("*").alias("k"))
    return each.groupBy("host", "path", "parent", "kind").agg(
        F.sum("k").alias("n"), F.count("*").alias("values"), F.sum(F.col("k") * F.log("k")).alias("k_ln_k"),
        F.sum(F.when(F.col("kind") == "a", F.col("k") * F.shiftright("value", 32))).alias("linked"),
        F.sum(F.when(F.col("kind") == "a", F.col("k") * F.col("value").bitwiseAND(2**32 - 1))).alias("size"),
    )


def noise_paths(tree: DataFrame) -> DataFrame:
    """host, noise (array of paths): the topmost low branches of every host
    that has any.  A host's tree has a row per path and kind, not per page."""

    def judge(rows: pa.Table) -> pa.Table:
        name, rows = rows["host"][0].as_py(), rows.to_pylist()
        noise = low_branches(rows)
        return pa.table({"host": pa.array([name] if noise else [], pa.string()), "noise": pa.array([noise] if noise else [], pa.list_(pa.string()))})

    return tree.groupBy("host").applyInArrow(judge, "host string, noise array<string>")


def _in_article(path: str) -> bool:
    return any(step.split(".")[0] in ARTICLE for step in path.split(">"))


def low_branches(rows: list[dict]) -> list[str]:
    """The topmost paths of one host's tree whose importance is too low."""
    m = sum(r["n"] for r in rows if r["kind"] == "m")
    if m < 2:
        return []
    plain = {r["path"]: 1 - r["linked"] / r["size"] for r in rows if r["kind"] == "a"}
    looks = {r["path"]: r for r in rows if r["kind"] == "s"}
    texts = {r["path"]: r for r in rows if r["kind"] == "t"}
    children = defaultdict(list)
    for path, r in looks.items():
        children[r["parent"]].append(path)
    worth: dict[str, tuple[float, int]] = {}
    for path in sorted({*looks, *texts}, key=lambda p: -p.count(">")):
        content = None
        if path in texts:
            t = texts[path]
            content = 1 - t["k_ln_k"] / t["n"] / log(m)
            if not _in_article(path):
                content *= plain.get(path, 1.0)
        below = [worth[c] for c in children[path] if c in worth]
        if not below:
            worth[path] = (1.0 if content is None else content, texts[path]["n"] if path in texts else 0)
            continue
        parts = below + ([(content, texts[path]["n"])] if content is not None else [])
        weight = sum(w for _, w in parts)
        inner = sum(c * w for c, w in parts) / weight if weight else 1.0
        look, n, styles = 1.0, looks[path]["n"], looks[path]["values"]
        if n > 1:
            look = max(0.0, (log(n) - looks[path]["k_ln_k"] / n) / log(n))
        fade = DAMPING ** styles
        worth[path] = ((1 - fade) * look + fade * inner, weight)
    low: list[str] = []
    for path in sorted(worth, key=lambda p: p.count(">")):
        tag, in_article = path.rpartition(">")[2].split(".")[0], _in_article(path)
        judged = tag not in ("html", "body") and tag not in ARTICLE and not (in_article and tag in PLAIN)
        least = LEAST_IMPORTANCE * (1 - 2 / m) if in_article else LEAST_IMPORTANCE
        if judged and worth[path][1] and worth[path][0] < least and not any(path.startswith(f"{p}>") for p in low):
            low.append(path)
    return sorted(low)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    noise = stored(noise_paths(style_tree(pages)), "noise-paths")
    size = noise.agg(F.count("*").alias("hosts"), F.sum(F.length(F.concat_ws(",", "noise"))).alias("chars")).first()
    if size["hosts"] <= BROADCAST_HOSTS and (size["chars"] or 0) <= BROADCAST_CHARS:
        noise = F.broadcast(noise)
    asked = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(noise, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("html"), batch.column("noise"))
            texts = [main_text(page.as_py(), frozenset(noise.as_py() or ())) for page, noise in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return asked.select("page_id", "url", "html", "noise").mapInArrow(read, f"page_id {kind}, url string, text string")


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
