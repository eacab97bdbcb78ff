"""HTML extraction with removal of site templates.

Two passes over the pages. The first parses each page and hashes the subtrees of its elements; hashes are counted for
each host in Spark, every distinct page body counting once, so that mirrored copies of a page make no template.
Subtrees that recur on many pages of a host are its template. The second pass parses again and writes the text
without those subtrees and without what is never article text: scripts, styles, forms, navigation, page headers and
footers, asides, notices, adverts and reader comments, by element name, role or class.

The main text is that of the page's <article> elements, else of <main>, else of <body>. A subtree is template on
``LEAST_PAGES`` pages that are ``LEAST_SHARE`` of the host's, or on ``MANY_PAGES`` whatever their share. Single
paragraphs, headings and the like inside <article> or <main> always need ``LEAF_SHARE``, since short sentences
recur there by chance. Text outside them is not part of the result at all, so its subtrees need not be counted.

Defined cases: null or empty html gives an empty text; a page without a host (null or odd url) belongs to the host ""; pages
are told apart by page_id and the hash of their html, so that repeated or null ids do no harm; end tags that are missing
are supplied; end tags without start are ignored; a page cut off in the middle keeps what is there.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import filled, settled, slices, text_hashes

LEAST_PAGES = 8  # distinct pages of a host that a template subtree is on, and
LEAST_SHARE = 0.2  # their share of the host's distinct pages
LEAF_SHARE = 0.3  # that share for paragraphs, headings, list items, .. inside <article> and <main>
MANY_PAGES = 1000  # on as many distinct pages a subtree other than such a leaf is template, whatever the share

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW_TEXT}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote tr".split())
DROPPED = frozenset(
    "script style noscript template head nav footer header aside form button select option textarea input label fieldset iframe object "
    "embed svg canvas audio video map dialog menu xmp noembed noframes title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# words of class and id names of what is not article text: readers' comments, sure ones, and such as articles use themselves
COMMENTS = frozenset("comment comments disqus".split())
SURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer masthead menu modal nav navbar "
    "navigation newsletter overlay popup promo promoted share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar".split())
DOUBTFUL = frozenset("discussion form header notice notices promotion related remarks replies responses skip widget".split())
SMALL_SHARE = 0.3  # of the text around it that a part may hold to be dropped by a name that is not sure
LINK_SHARE = 0.5  # of a part's text in links, from which on it is taken for a list of links
# words of names that tell a state of the page or of an element, not what it is
STATES = frozenset(
    "has have no not non with without is are show shows hide hides open opened close closed on off enabled disabled allowed active inactive hidden visible "
    "collapsed expanded fixed sticky left right free loaded ready".split())
FRAMES = frozenset("html body main".split())  # never dropped by class or id: they hold the text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME_PARTS = re.compile(r"[a-z]+")
CLOSED_BY = {  # an open element (key) ends where one of these starts
    "p": BLOCK - {"option", "legend", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
SCOPES = frozenset("table td th ul ol div section article aside nav body main form blockquote dl".split())


KEEP, SMALL, LINKS, DROP = range(4)  # what a name asks for: nothing, to be small or all links, to be all links, to be dropped


class Element:
    __slots__ = ("name", "parent", "dropped", "asked", "parts", "place")

    def __init__(self, name: str, parent: Element | None, asked: int, place: int):
        self.name, self.parent, self.dropped, self.asked, self.place = name, parent, asked == DROP, asked, place
        self.parts: list = []  # texts and elements in page order


def named(element: str, names: str, is_class: bool) -> int:
    """What a class or id (lower case) asks for. A name says something by itself, or by its first or last word if it does not
    just state something ("has-sidebar", "nav-closed"). Headings and leaves are text, unless a class is sure word for word."""
    asked = KEEP
    for name in names.split():
        words = NAME_PARTS.findall(name)
        ends = set() if not words or {words[0], words[-1]} & STATES else {words[0], words[-1]}
        if element == "article":
            asked = max(asked, DROP if (ends | {name}) & COMMENTS else KEEP)
        elif element in HEADINGS:
            continue
        elif is_class and (name in SURE or name in COMMENTS):
            return DROP
        elif element in LEAF:
            continue
        elif (ends | {name}) & COMMENTS:
            return DROP
        elif (ends | {name}) & SURE or (is_class and name in DOUBTFUL):
            asked = max(asked, SMALL)
        elif (ends | {name}) & DOUBTFUL and asked == KEEP:
            asked = LINKS
    return asked


def unwanted(name: str, attributes: str) -> int:
    if name in DROPPED:
        return DROP
    if not attributes or attributes.isspace():
        return KEEP
    asked = KEEP
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
        if key in ("class", "id"):
            said = KEEP if name in FRAMES else named(name, value, key == "class")
            asked = said if asked == KEEP else max(asked, said) if DROP in (asked, said) else min(asked, said or asked)
        elif key == "role":
            if value.strip() in DROPPED_ROLES:
                return DROP
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return DROP
    return asked


def judge(root: Element, elements: list[Element]) -> None:
    """Drop the elements whose names only ask for it, by how much of the text around them they hold and how much of theirs is links.

    An article inside another one is a reader's comment or a teaser if it holds the smaller part of the outer one's text.
    """
    doubtful = [e for e in elements if e.asked in (SMALL, LINKS) or (e.name == "article" and not e.dropped)]
    if not any(e.asked != KEEP or inside(e, "article") for e in doubtful):
        return
    sizes, links = {root: 0}, {root: 0}
    for e in elements:
        sizes[e] = links[e] = 0
    for e in [*reversed(elements), root]:
        sizes[e] += sum(len(part.strip()) for part in e.parts if isinstance(part, str))
        if e.name == "a":
            links[e] = sizes[e]
        if e.parent is not None and not e.dropped:
            sizes[e.parent] += sizes[e]
            links[e.parent] += links[e]
    for e in doubtful:
        frame = inside(e, "article") or inside(e, "main") or inside(e, "body") or root
        if e.asked == KEEP:
            e.dropped = frame.name == "article" and 2 * sizes[e] < sizes[frame]
        else:
            e.dropped = links[e] >= LINK_SHARE * sizes[e] or (e.asked == SMALL and sizes[e] <= SMALL_SHARE * sizes[frame])


def inside(e: Element, name: str) -> Element | None:
    """The nearest element of a name around this one."""
    up = e.parent
    while up is not None and up.name != name:
        up = up.parent
    return up


def parsed(page: str) -> tuple[Element, list[Element]]:
    """The tree of a page, and its elements in page order."""
    root = Element("#page", None, KEEP, -1)
    elements: list[Element] = []
    at, here, at_end = 0, root, len(page)
    while at < at_end:
        token = TOKEN.search(page, at)
        if token is None:
            here.parts.append(page[at:])
            break
        if token.start() > at:
            here.parts.append(page[at : token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            if token[1]:
                here.parts.append(token[1])
            continue
        name = name.lower()
        if token[2]:  # an end tag closes the nearest open element of its name within its scope
            up = here
            while up is not root and up.name != name and (name in SCOPES or up.name not in SCOPES):
                up = up.parent
            if up is not root and up.name == name:
                here = up.parent
            continue
        closes = here
        while closes is not root and closes.name not in SCOPES:
            if name in CLOSED_BY.get(closes.name, ()):
                here = closes.parent
                break
            closes = closes.parent
        if here.name in ("li", "td", "th") and name in CLOSED_BY[here.name]:
            here = here.parent
        made = Element(name, here, unwanted(name, token[4]), len(elements))
        elements.append(made)
        here.parts.append(made)
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            stop = end.start() if end else at_end
            if name in ("title", "textarea"):
                made.parts.append(page[at:stop])
            at = stop if end is None else page.find(">", end.start()) + 1 or at_end
        elif name not in VOID and not token[4].endswith("/"):
            here = made
    judge(root, elements)
    return root, elements


def main_parts(root: Element, elements: list[Element]) -> list[Element]:
    """The elements whose text is the main text, outermost first."""
    for name in ("article", "main", "body"):
        found = []
        for e in elements:
            if e.name == name:
                up = e
                while up is not None and not (up is not e and up.name == name) and not up.dropped:
                    up = up.parent
                if up is None:
                    found.append(e)
        if found:
            return found
    return [root]


def blocks(tops: list[Element], removed: frozenset | set = frozenset()) -> list[str]:
    """The texts of the blocks in page order, white space collapsed, empty ones left out."""
    lines: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            lines.append(text)

    for top in tops:
        waiting: list = [top]
        while waiting:
            part = waiting.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                run.append(part)
            elif part.dropped or part.place in removed:
                if part.name in BLOCK:
                    end()
            elif part.name == "br":
                run.append(" ")
            elif part.name in BLOCK or part.place < 0:
                end()
                waiting.append(None)
                waiting.extend(reversed(part.parts))
            else:
                waiting.extend(reversed(part.parts))
        end()
    return lines


def candidates(tops: list[Element]) -> list[tuple[int, str, bool]]:
    """Blocks that could be template, what their hash is taken of, and whether they are leaves in <article> or <main>."""
    found: list[tuple[int, str, bool]] = []
    for top in tops:
        inside = top.name in ("article", "main")
        waiting = [p for p in top.parts if isinstance(p, Element)]
        while waiting:
            e = waiting.pop()
            if e.dropped or e.name in VOID:
                continue
            inner = [p for p in e.parts if isinstance(p, Element)]
            if e.name in BLOCK:
                text = "\n".join(blocks([e]))
                if text:
                    found.append((e.place, f"{e.name}\n{text}", inside and e.name in LEAF))
            waiting += inner
    return found


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", url or "")
    return found[1].lower() if found else ""


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """Per candidate subtree: host, its hash, whether a leaf, the page (page_id and the hash of its html), the body's hash and its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = filled(batch.column("html"))
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            rows: list[tuple] = []
            keyed: list[str] = []
            for i, (page, own) in enumerate(zip(texts.to_pylist(), text_hashes(texts).view(np.int64).tolist())):
                root, elements = parsed(page)
                tops = main_parts(root, elements)
                host = host_of(urls[i])
                body = len(keyed)
                rows.append((host, None, ids[i], own, body, -1, None))
                keyed.append("\n".join(blocks(tops)))
                for place, key, leaf in candidates(tops):
                    rows.append((host, len(keyed), ids[i], own, body, place, leaf))
                    keyed.append(key)
            hashes = text_hashes(filled(pa.array(keyed, pa.string()))).view(np.int64) if keyed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "host": [r[0] for r in rows], "subtree": [None if r[1] is None else int(hashes[r[1]]) for r in rows],
                "page_id": [r[2] for r in rows], "html_hash": [r[3] for r in rows], "body": [int(hashes[r[4]]) for r in rows],
                "place": [r[5] for r in rows], "leaf": [r[6] for r in rows],
            }, schema=pa.schema([("host", pa.string()), ("subtree", pa.int64()), ("page_id", pa.int64()), ("html_hash", pa.int64()), ("body", pa.int64()), ("place", pa.int64()), ("leaf", pa.bool_())]))

    return pages.select("page_id", "url", "html").mapInArrow(run, "host string, subtree long, page_id long, html_hash long, body long, place long, leaf boolean")


def template_places(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per page that has any: the places of its template subtrees."""
    marks = settled(subtree_hashes(pages), "page-subtrees")
    # a row without subtree stands for the page itself; distinct bodies are counted before hosts meet
    seen = marks.groupBy("host", "subtree", "leaf", "body").agg(F.count(F.lit(1)).alias("copies")).groupBy("host", "subtree", "leaf").agg(F.count(F.lit(1)).alias("bodies"))
    counts = settled(seen, "page-counts")
    hosts = counts.where("subtree is null").select(F.col("host").alias("_h"), F.col("bodies").alias("of"))
    recurring = counts.where(F.col("subtree").isNotNull() & (F.col("bodies") >= least_pages)).join(hosts, F.col("host") == F.col("_h"))
    share = F.when(F.col("leaf"), F.greatest(F.lit(least_share), F.lit(LEAF_SHARE))).otherwise(F.lit(least_share))
    usual = (F.col("bodies") >= share * F.col("of")) | (~F.col("leaf") & (F.col("bodies") >= MANY_PAGES))
    template = settled(recurring.where(usual).select("host", "subtree", "leaf"), "page-templates")
    return marks.join(template, ["host", "subtree", "leaf"]).groupBy("page_id", "html_hash").agg(F.collect_set("place").alias("places"))


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    places = settled(template_places(pages, least_pages, least_share), "page-places")
    p = places.select(F.col("page_id").alias("_id"), F.col("html_hash").alias("_hash"), "places")
    rows = pages.select("page_id", "url", "html")
    if not places.isEmpty():  # else no page has anything to remove
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "html"):
                own = text_hashes(filled(batch.column("html"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "html_hash"])

        rows = rows.mapInArrow(hashed, "page_id long, url string, html string, html_hash long").join(
            p, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("html_hash") == F.col("_hash")), "left").select("page_id", "url", "html", "places")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, places in zip(filled(batch.column("html")).to_pylist(), batch.column("places").to_pylist()):
                root, elements = parsed(page)
                texts.append("\n".join(blocks(main_parts(root, elements), set(places or ()))))
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), made, pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
