"""Main text of web pages by consensus host paths.

Every page is parsed into blocks of text under a path of containers; each container is
named by its tag and classes, generalised by dropping digits (``div.post-12`` becomes
``div.post-``). A page names the deepest container that holds all text not left out, or
the article around it. Spark counts these votes
per host and path; the path with most votes wins, and each page of the host is
extracted again from the containers on the winning path, if these hold at least half of the
page's text; else from its own best one, which holds all of it. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments and hidden elements are
left out wherever they stand, inside a line of text as well. They are known by their tags,
roles and attributes, and by the word that a class or id ends in (``left-sidebar``,
``ad-slot``, but not ``related-work``). Names alone do not decide: headings go by none, and a
form, header, button or box named like one stays, without the boxes inside it, if it holds
more than half of the page's text and is a mere element of its kind or stands around an
article, since whole pages lie in forms and banners. Sidebars and boxes of comments never do.

Defined results: a null or empty html has an empty text. A null url, or one without a
host, votes under the empty host. Ties between paths go to the shorter path, then to
the first by code point. Repeated rows vote each. Malformed markup (unclosed or
crossing tags, stray quotes) is read like a browser would in simple cases, at any depth, and
never fails; a tag that never ends is text. Columns besides page_id, url and html are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, materialize, pieces, table
from .sieve import bits_for, flagged, sieve
from .url_filter import host_of

#: Names of HTML elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never part of an article, and those that may hold it nevertheless;
#: ``header`` is one only outside of it.
SKIPPED = frozenset("nav footer aside select option datalist dialog menu svg math canvas object audio video head map".split())
DOUBTED = frozenset("form button header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words that mark what is not the article, if they are the last word of a
#: class or id but for words of place and shape; the second only outside of an article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions banner banners nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar cookie cookies consent gdpr notice notices alert "
    "alerts popup popups modal newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond "
    "disqus replies pagination pager toolbar copyright".split()
)
MARKED_OUTSIDE = frozenset("header search form overlay skip discussion reply".split())
SHAPES = frozenset(
    "area article articles author bar block body bottom box button buttons column container content count desktop fixed form global group heading icon icons inline inner "
    "item items left link links list local main message meta mobile outer page panel post posts primary right row secondary section site slot sticky tab tabs text title "
    "tools top unit view wrap wrapper".split()
)
#: Fixed values: ``with-sidebar`` is not a sidebar, ``article-header`` not a page's header.
_BESIDE_ALL = frozenset("with has no without".split())
_BESIDE = _BESIDE_ALL | frozenset("article entry post story content chapter".split())
#: Elements whose end is implied by the start of these.
_ENDS = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
}
#: What an implied end does not reach through.
_WALLS = {"p": frozenset("button table td th caption".split()), "li": frozenset("ul ol menu".split()), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"])}
_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+)>|[!?/][^>]*+>)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_JUDGED = re.compile(r"class|id|role|style", re.I)
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Names of boxes that whole pages may lie in, and of those that never hold the article.
_FRAMES = re.compile(r"banner|header|masthead|topbar|form|overlay|modal|popup", re.I)
_COMMENTS = re.compile(r"comment|respond|disqus|repl(?:y|ies)|discussion", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Of which open elements each element is the nearest that ends them, or hides them.
_NEAREST = {tag: tuple(name for name in _ENDS if tag == name or tag in _WALLS[name]) for tag in set(_ENDS).union(*_WALLS.values())}
_DIGITS = re.compile(r"[0-9]+")


class Container:
    """An open element: its generalised name, whether it is left out or in an article, a
    number that tells its path from others, and the nearest box at or above it that is left
    out unless it turns out to hold the page's text."""

    __slots__ = ("article", "bare", "box", "depth", "holds", "name", "nearest", "number", "parent", "size", "skip", "tag")

    def __init__(self, tag: str, name: str, skip: bool, article: bool, parent: Container | None):
        self.tag, self.name, self.skip, self.article, self.parent = tag, name, skip, article, parent
        self.box: Container | None = parent.box if parent else None
        #: of a box: doubted for its tag alone, holding an article element, characters of text
        self.bare, self.holds, self.size = False, False, 0
        self.depth, self.number = (parent.depth + 1, hash((parent.number, name))) if parent else (0, 0)
        #: the nearest elements by what they end or hide
        self.nearest = parent.nearest if parent else {}
        if tag in _NEAREST:
            self.nearest = self.nearest | dict.fromkeys(_NEAREST[tag], self)

    def path(self) -> str:
        names, node = [], self
        while node.parent:
            names.append(node.name)
            node = node.parent
        return "".join(f"/{name}" for name in reversed(names))


def marks(token: str, article: bool) -> bool:
    """Whether a class or id names something else than an article's text."""
    parts = [x.lower() for x in _PARTS.findall(token.lower() if token.isupper() else token)]
    kept = list(parts)
    while len(kept) > 1 and (kept[-1] in SHAPES or len(kept[-1]) == 1):
        kept.pop()
    if not kept or kept[-1] not in MARKED and (article or kept[-1] not in MARKED_OUTSIDE):
        return False
    beside = _BESIDE if kept[-1] == "header" else _BESIDE_ALL
    return not any(x in beside for x in kept[:-1])


def _judged(tag: str, attributes: str, article: bool) -> tuple[str, bool, bool]:
    """What an element's attributes say: its classes without digits, whether it is marked
    as something else than the article's text, whether it is hidden."""
    given: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        given.setdefault(key.lower(), "".join(values))
    tokens = given.get("class", "").split()
    marked = given.get("role", "").strip().lower() in ROLES or any(marks(t, article) for t in (*tokens, *given.get("id", "").split()))
    hidden = "hidden" in given or bool(_HIDING.search(given.get("style", "")))
    return ".".join(sorted(_DIGITS.sub("", t).lower().replace("/", "|") for t in tokens)), marked, hidden


def _opened(tag: str, attributes: str, parent: Container) -> Container:
    names, marked, hidden = _judged(tag, attributes, parent.article) if attributes else ("", False, False)
    main = tag in ("article", "main")
    marked = marked and not main and tag not in ("body", "html") and tag not in HEADINGS  # a heading is what it says
    node = Container(tag, f"{tag}.{names}" if names else tag, parent.skip or hidden or tag in SKIPPED, parent.article or main, parent)
    doubted = tag in DOUBTED
    if tag == "header":
        doubted = not parent.article and not any(x in _BESIDE for x in names.replace("-", ".").replace("_", ".").split("."))
    if marked or doubted:
        # comments and sidebars hold text, and often articles of their own, and stay out
        node.box, node.bare = node, doubted and not marked
        node.size = 0 if node.bare or _FRAMES.search(attributes) and not _COMMENTS.search(attributes) else -1
    box = node.box
    while main and box:
        box.holds, box = True, box.parent.box
    return node


def _kept(found: list[tuple[Container, str]]) -> list[tuple[Container, str]]:
    """Blocks outside of all boxes, or in those that hold the page's text: more than half of
    all, and for its tag alone or around an article. A page may lie in one form."""
    total = 0
    for node, text in found:
        total += len(text)
        box = node.box
        while box:
            if box.size >= 0:
                box.size += len(text)
            box = box.parent.box
    kept: dict[Container | None, bool] = {None: True}

    def fits(box: Container | None) -> bool:
        above = []
        while box not in kept:
            above.append(box)
            box = box.parent.box
        for x in reversed(above):
            kept[x] = kept[x.parent.box] and (x.bare or x.holds) and 2 * x.size > total
        return kept[above[0] if above else box]

    return [(node, text) for node, text in found if fits(node.box)]


def blocks(html: str) -> list[tuple[Container, str]]:
    """The page's blocks in order: their container and their text, white space and
    character references resolved."""
    root = at = Container("", "", False, False, None)
    found: list[tuple[Container, str]] = []
    held: list[str] = []
    opened: dict[str, int] = {}
    # of a marked or hidden element inside a block: its container, its tag, how many are open
    muted: tuple[Container, str, int] | None = None

    def leave(node: Container) -> None:
        nonlocal at, muted
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent
        if muted and at.depth < muted[0].depth:
            muted = None

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            if text := " ".join((unescape(text) if "&" in text else text).split()):
                found.append((at, text))

    end, look, n = 0, 0, len(html)
    while (look := html.find("<", look)) >= 0:
        m = _TOKEN.match(html, look)
        if m is None:
            look += 1
            if html[look : look + 1].isalpha() or html[look : look + 1] in ("/", "!", "?"):
                break  # a tag that never ends: the rest is text
            continue
        if look > end and not at.skip and not muted:
            held.append(html[end:look])
        end = look = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if muted and muted[1] == tag:
                    muted = (muted[0], tag, muted[2] - 1) if muted[2] > 1 else None
            elif opened.get(tag):
                flush()
                node = at
                while node.tag != tag:
                    node = node.parent
                leave(node)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(html, end)
            end = look = close.end() if close else n
            continue
        if tag == "br":
            if not muted:
                held.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                if muted:
                    muted = (muted[0], muted[1], muted[2] + (muted[1] == tag))
                elif m[3] and (_JUDGED.search(m[3]) or "hidden" in m[3].lower()) and any(_judged(tag, m[3], at.article)[1 + (at.tag in HEADINGS) :]):
                    muted = (at, tag, 1)
            continue
        flush()
        for name, by in _ENDS.items():
            if tag in by:
                node = at.nearest.get(name)
                if node is not None and node.tag == name:
                    leave(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        at = _opened(tag, m[3], at)
        opened[tag] = opened.get(tag, 0) + 1
    if end < n and not at.skip and not muted:
        held.append(html[end:])
    flush()
    return _kept([(node, text) for node, text in found if not node.skip])


def best_path(found: list[tuple[Container, str]]) -> str:
    """The path of the deepest container of all ``found``, or of the article around it."""
    best = last = None
    for node, _ in found:
        if node is last:
            continue
        last = node
        if node.tag == "p":  # a paragraph is part of a container, not one itself
            node = node.parent
        best = best or node
        while best is not node:
            if best.depth >= node.depth:
                best = best.parent
            else:
                node = node.parent
    if best is None:
        return ""
    while best.article and best.tag not in ("article", "main"):
        best = best.parent
    return best.path()


def _under(found: list[tuple[Container, str]], path: str) -> list[str]:
    """Texts of the blocks in containers on ``path``."""
    names, number, known = path.split("/")[1:], 0, {}
    for name in names:
        number = hash((number, name))
    texts = []
    for node, text in found:
        seen = []
        while node.depth > len(names) and node not in known:
            seen.append(node)
            node = node.parent
        inside = known[node] if node in known else (node.depth, node.number) == (len(names), number)
        known |= dict.fromkeys([node, *seen], inside)
        if inside:
            texts.append(text)
    return texts


def main_text(html: str | None, path: str | None) -> str:
    """Text of all blocks under containers on ``path`` if they hold most of the page's, or
    of the page's own best container, which holds all."""
    found = blocks(html) if html else []
    own = [text for _, text in found]
    under = _under(found, path) if path else []
    return " ".join(under if 2 * sum(map(len, under)) >= sum(map(len, own)) else own)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in pieces(b, 2)):
        paths = [best_path(blocks(x.as_py() or "")) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string())], names=["page", "host", "path"])


def page_paths(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) → page (a hash of the row), host, path: the path that
    each page with any text votes for."""
    given = pages.select(_page(), host_of(F.col("url")).alias("host"), "html")
    return in_arrow(given, _votes, "page long, host string, path string").where("path != ''")


def host_paths(votes: DataFrame) -> DataFrame:
    """``votes`` (host, path) → host, path, votes: the winning path of each host."""
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.struct((-F.col("votes")).alias("down"), F.length("path").alias("n"), "path")
    return counted.groupBy("host").agg(F.min(rank).alias("best")).select("host", "best.path", (-F.col("best.down")).alias("votes"))


def _page() -> Column:
    return F.xxhash64("page_id", "url", "html").alias("page")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches for part in pieces(b, 2)):
        texts = [main_text(h.as_py(), p) for h, p in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) → page_id, url, text. Only pages that voted for
    another path than their host's winner are joined with it, behind a sieve; all others
    are extracted where they lie."""
    pages = pages.select("page_id", "url", "html")
    with Scratch(pages.sparkSession) as scratch:
        votes = scratch.table(page_paths(pages), "page-paths")
        winners = scratch.table(host_paths(votes).select("host", F.col("path").alias("winner")), "host-paths")
        others = votes.join(winners, "host").where("path != winner").select("page", "winner").dropDuplicates(["page"])
        others = materialize(others, "pages-off-path")
    bits = bits_for(others.count())
    marked = flagged(pages.withColumn("page", _page()), ["page"], sieve(others, ["page"], bits), bits, "off")
    off = marked.where("off").join(others, "page", "left").select("page_id", "url", "html", "winner")
    own = marked.where("not off").select("page_id", "url", "html", F.lit(None).cast("string").alias("winner"))
    schema = pages.select("page_id", "url").schema.add("text", "string")
    return in_arrow(own, _extracted, schema).unionByName(in_arrow(off, _extracted, schema))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
