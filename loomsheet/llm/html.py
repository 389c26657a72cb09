"""Main text of web pages by consensus paths of a host.

First pass: each page is read into a stream of tags and texts. Every container gets the length of the
text in the blocks right inside it, half of what its children's blocks have, less its link text, and
more if its name or class speaks of an article. The container's path is generalised: tags and classes from the root down,
numbers replaced by #. The page votes for the path of its best container, with the container's score.
Spark adds the votes of a host, and its best ``PATHS`` paths, most votes first, win. Second pass: the
first winning path that a page has, or else the page's own best one, is extracted again.

Extraction leaves out menus, headers of the page, footers, sidebars, notices, adverts, forms, scripts,
styles, markup, hidden parts and reader comments, by tag, role or the names in classes and ids. A name counts as
a whole, or if its first or last word speaks of something unwanted and its other words only of layout (``ad-slot``,
``site-footer``; not ``ad-hoc`` or ``related-work``). Ids of headings, paragraphs and other blocks of text are made
from their words and don't count, nor do ids of inline elements. Inside an article, a name that an author may use
(share, related, notice) needs a second sign: links make half of the text, or there is a form. Names that tell of a state
(no-sidebar, has-menu, nav-open) don't count, and what only a name, a role, or the tags form and header speak against
stays if it holds most of the page's text; containers named for comments go whatever their length. Extraction decodes
character references; turns white space inside a block into one space; trims; and joins the blocks that aren't empty
by a line feed.

Defined results: a null or empty page gives an empty text; a page without any container is read
whole; a row without a url votes with the others that have none; tags that are never closed end with
their parents; repeated rows repeat their texts; pages are read whole, in time in proportion to their length
however deep they are nested; extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import bytes_under
from .common import Tables, bounded, slices

PATHS = 5
BLOCK = 2_000_000
SHARES = 32
BROADCAST = 32 << 20  # bytes of all hosts' paths

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body div article main section td center".split())
SKIPPED = frozenset("nav footer aside script style noscript template iframe svg button select option textarea object canvas dialog menu head title math audio video input".split())
# Elements that a start tag of the key ends if they are open in the same container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
for _tag in "div article section ul ol h1 h2 h3 h4 h5 h6 table blockquote pre aside nav footer header form main figure dl hr".split():
    ENDS[_tag] = {"p"}

# Words of classes and ids, between white space, -, _ and a change of case: those of parts that no author means, and those that one may.
_SURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies gdpr login masthead modal nav navbar newsletter pager pagination popup sidebar signup"
    " sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_MAYBE = frozenset("alert banner copyright footer menu navigation notice notices notification notifications overlay promo promos promotion promotions recommendations recommended related share sharing skip social".split())
_COMMENTS = frozenset("comment comments commentlist commentary commentarea disqus respond reply replies".split())
# Words that say where or what a part is, not what it tells.
_LAYOUT = frozenset(
    "area articles aside bar block blocks body bottom box btn button buttons col column container content footer form global group header holder home icons inner item items left links list main"
    " media message outer page pages panel popup post posts primary reader row right secondary section site slot small top unit user users wrap wrapper".split()
)
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th figcaption caption".split())
_STATES = frozenset("no not has have with without is hide hides".split()), frozenset("open opened closed enabled disabled active visible on off toggled".split())
_POST = frozenset("post entry article story hentry".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())
_WANTED = re.compile(r"article|content|post|entry|story|body|text|main", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|textarea|svg|iframe|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NUMBER = re.compile(r"[0-9]+")


@lru_cache(10_000)
def _spoken(names: str) -> tuple[int, bool, bool]:
    """How far classes and ids speak of something unwanted (2 for sure, 1 maybe), whether of comments, and of a post."""
    unwanted, comments, post = 0, False, False
    for name in names.split():
        parts = [x for x in re.split("[-_]+", _CAMEL.sub(r"\1-\2", name).lower()) if x and not x.isdigit()]
        if not parts or parts[0] in _STATES[0] or parts[-1] in _STATES[1]:
            continue
        known = lambda words: name.lower() in words or any(parts[k] in words and all(p in _LAYOUT or p in words or p in _SURE or p in _MAYBE for p in parts) for k in (0, -1))  # noqa: E731, B023  sideBar is side and bar, and sidebar
        unwanted = max(unwanted, 2 if known(_SURE) else 1 if known(_MAYBE) else 0)
        comments |= known(_COMMENTS)
        post |= name.lower() in _POST or not _POST.isdisjoint(parts)
    return unwanted, comments, post


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): (m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(text)} if text else {}


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or ("style" in found and bool(_UNSEEN.search(found["style"])))


class Paths:
    """The generalised paths of a page's elements as numbers: each has a parent of a lower number, a name and a tag."""

    def __init__(self):
        self.parents, self.names, self.known = [-1], ["#page"], {}
        self.above = [-1]  # the nearest container that a path lies in

    def at(self, parent: int, name: str) -> int:
        key = parent, name
        if key not in self.known:
            self.known[key] = len(self.names)
            self.above.append(parent if self.tag(parent) in CONTAINERS else self.above[parent])
            self.parents.append(parent)
            self.names.append(name)
        return self.known[key]

    def tag(self, path: int) -> str:
        return self.names[path].partition(".")[0]

    def text(self, path: int) -> str:
        out = []
        while path >= 0:
            out.append(self.names[path])
            path = self.parents[path]
        return ">".join(reversed(out))

    def find(self, text: str) -> int | None:
        """The number of a path, if the page has it."""
        first, *rest = text.split(">")
        path = 0 if first == self.names[0] else None
        for name in rest:
            path = self.known.get((path, name)) if path is not None else None
        return path


class Element:
    """An open element: ``gone`` for certain, or in ``doubt`` (2, or 1 where it needs a second sign) and gone unless it holds most of the page's text."""

    __slots__ = ("base", "bonus", "doubt", "form", "gone", "held", "inside", "linked", "links", "parent", "path", "plain", "skipped", "tag")

    def __init__(self, tag: str, parent: Element | None, attributes: str, paths: Paths):
        found = _attributes(attributes)
        classes = found.get("class", "")
        names = f"{classes} {found.get('id', '')}" if tag not in _TEXTUAL else classes
        unwanted, comments, post = _spoken(names) if names.strip() else (0, False, False)
        self.tag, self.parent = tag, parent
        name = ".".join([tag, *sorted(_NUMBER.sub("#", classes).replace(">", "_").split())])
        self.path = paths.at(parent.path, name) if parent else 0
        whole = tag in ("html", "body", "article", "main")
        within = bool(parent) and parent.inside
        self.inside = tag in ("article", "main") or post or within
        self.gone = (bool(parent) and parent.gone) or tag in SKIPPED or _hidden(found) or (comments and tag not in ("html", "body", "main", "article") and tag not in _TEXTUAL)
        marked = tag == "form" or (tag == "header" and not self.inside) or found.get("role", "") in _ROLES
        self.doubt = 0 if whole else 2 if marked or unwanted == 2 and not (within and tag in _TEXTUAL) else 1 if within and unwanted else 2 if unwanted else 0
        self.form = tag == "form"
        self.skipped = self.gone
        self.bonus = 200.0 if tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody" else 50.0 if names.strip() and _WANTED.search(names) else 0.0
        self.plain = self.base = self.links = 0.0
        self.held = self.linked = 0  # characters inside, and those of links


Stream = tuple[list[tuple[Element, str | None]], Paths]


def read(page: str) -> Stream:
    """What a page shows, in order: (innermost open element that isn't inline, text), or None for the end of a block; and its paths."""
    stack: list[Element] = []
    out: list[tuple[Element, str | None, int]] = []
    paths = Paths()
    root = Element("#page", None, "", paths)
    made, total = [root], 0
    opened: Counter[str] = Counter()  # tags on the stack
    links, unseen = 0, []  # open links, and open inline elements from the first that isn't shown

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1 or m[1]:
                if text.startswith("<![CDATA["):
                    text = text[9:-3]
                else:
                    continue
            top = stack[-1] if stack else root
            if not top.gone and not unseen:
                out.append((top, text, links))
                if not text.isspace():
                    total += len(text)
                    top.held += len(text)
                    top.linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[2] else 1
            if tag in VOID:
                continue
            if m[2]:
                if tag in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
            elif unseen:
                unseen.append(tag)
            elif m[4] and not m[4].isspace():
                found = _attributes(m[4])
                sure = _spoken(found["class"])[0] if found.get("class") else 0
                if _hidden(found) or sure == 2 or (sure == 1 and tag == "a"):
                    unseen.append(tag)
            continue
        unseen.clear()  # a block ends what is open inside the last one
        top = stack[-1] if stack else root
        out.append((top, None, 0))
        if m[2]:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    links = 0
                    break
                if stack[k].tag in ("article", "body", "html", "table") and tag in ("p", "li", "td", "tr"):
                    break
            continue
        if tag in VOID:
            continue
        ended = ENDS.get(tag)
        if ended and any(opened[t] for t in ended):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ended:
                    cut(k)
                elif stack[k].tag in CONTAINERS or stack[k].tag in ("ul", "ol", "table", "dl"):
                    break
        stack.append(Element(tag, stack[-1] if stack else root, m[4], paths))
        opened[tag] += 1
        made.append(stack[-1])
    for e in reversed(made):  # parents come first
        if e.parent:
            e.parent.held += e.held
            e.parent.linked += e.linked
            e.parent.form |= e.form
    for e in made:
        doubted = e.doubt == 2 or (e.doubt == 1 and (e.form or 2 * e.linked >= e.held))
        e.skipped = e.gone or (bool(e.parent) and e.parent.skipped) or (doubted and 2 * e.held <= total)
    shown = []
    for top, text, linked in out:
        if text is None:
            shown.append((top, None))
        elif not top.skipped:
            shown.append((top, text))
            top.plain += len(text)
            top.links += len(text) if linked else 0
    return shown, paths


def scores(stream: Stream) -> dict[int, float]:
    """The score of each generalised container path of a page."""
    rows, paths = stream
    held: dict[int, Element] = {id(e): e for e, _ in rows}
    total: dict[int, float] = {}
    bonus: dict[int, float] = {}
    for e in held.values():
        if e.skipped:
            continue
        own = max(0.0, e.plain - 2 * e.links)
        step, path = 1.0, paths.above[e.path]
        if e.tag in CONTAINERS:
            bonus[e.path] = max(bonus.get(e.path, 0.0), e.bonus)
            total[e.path] = total.get(e.path, 0.0) + own
            step = 0.5
        while path >= 0 and step >= 0.2:
            total[path] = total.get(path, 0.0) + own * step
            step, path = step / 2, paths.above[path]
    return {p: s + bonus.get(p, 0.0) for p, s in total.items()}


def extract(stream: Stream, path: int | None) -> str:
    """The blocks in elements of the path, or of the whole page."""
    rows, paths = stream
    blocks, held = [], []
    within = bytearray(len(paths.names))
    for k, parent in enumerate(paths.parents):  # parents come first
        within[k] = path is None or k == path or (parent >= 0 and within[parent])

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append(text)
            held.clear()

    for element, text in rows:
        if text is None:
            end()
        elif within[element.path]:
            held.append(text)
    end()
    return "\n".join(blocks)


def best(found: dict[int, float]) -> int | None:
    """The path with the highest score, of equal ones the first on the page."""
    return min(found, key=lambda p: (-found[p], p)) if found else None


def whole(path: int | None, paths: Paths) -> int | None:
    """The nearest article or main that a path lies in, or the path itself; its text is what a page is about."""
    at = path if path is not None else -1
    while at >= 0:
        if paths.tag(at) in ("article", "main"):
            return at
        at = paths.parents[at]
    return path


def shown(stream: Stream) -> set[int]:
    """The paths of a page's elements that have text, and of all that they lie in."""
    rows, paths = stream
    known: set[int] = set()
    for e, _ in rows:
        at = -1 if e.skipped else e.path
        while at >= 0 and at not in known:
            known.add(at)
            at = paths.parents[at]
    return known


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): one row for each page with a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", BLOCK):
                hosts, voted, score = part.column("host"), [], []
                for page in part.column("html").to_pylist():
                    stream = read(page)
                    found = scores(stream)
                    path = best(found)
                    voted.append(None if path is None else stream[1].text(whole(path, stream[1])))
                    score.append(found[path] if path is not None else 0.0)
                yield pa.RecordBatch.from_arrays([hosts, pa.array(voted, pa.string()), pa.array(score)], ["host", "path", "score"])

    texts = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return bounded(texts).mapInArrow(run, "host string, path string, score double").where("path IS NOT NULL")


def winners(cast: DataFrame, most: int = PATHS) -> DataFrame:
    """(host, paths): each host's paths with the most votes, the first first."""
    total = cast.groupBy("host", "path").agg(F.sum(F.round("score", 3).cast("decimal(18,3)")).alias("votes"))
    order = [F.desc("votes"), "path"]
    # A host may have very many paths: the best of each share of them first, then of all.
    share = F.pmod(F.xxhash64("path"), F.lit(SHARES))
    some = total.withColumn("place", F.row_number().over(Window.partitionBy("host", share).orderBy(*order))).where(F.col("place") <= most)
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("place") <= most)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda r: r["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, path for every row of ``pages`` (page_id, url, html)."""
    keep = Tables(pages.sparkSession)
    won = keep(winners(votes(pages)), "paths")
    if bytes_under(pages.sparkSession, keep.paths["paths"][0]) < BROADCAST:
        won = F.broadcast(won)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", BLOCK):
                texts, used = [], []
                for page, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True):
                    stream = read(page)
                    have = shown(stream)
                    path = next((p for p in map(stream[1].find, paths or ()) if p is not None and p in have), None)
                    if path is None:
                        path = whole(best(scores(stream)), stream[1])
                    texts.append(extract(stream, path))
                    used.append(None if path is None else stream[1].text(path))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())], ["page_id", "url", "text", "path"])

    # Where the paths aren't broadcast, a hot host's pages are split by the adaptive skew join; the other side has one row for each host.
    return rows.join(won, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, path string")
