"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path, so pages of near addresses are neighbours. A page's text lines, one for
each block of markup, are aligned with those of the nearest page that is not a copy of it by longest common
subsequence. Lines that both share, at the same place in the markup, are the site's frame and are deleted.
Markup that names its part (``nav``, ``footer``, ``class="sidebar"`` and so on) is left out before. Lines
inside ``article`` and long ones may be quoted, so one neighbour is not enough to delete them: all different
pages nearby must share them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different pages on each side among which the nearest is sought; copies in between do not count.
REACH = 3
#: Pages on each side among which these are sought; exact copies do not count.
NEAR = 16
#: A page that shares more than this of what is not frame is a copy and tells nothing about the frame.
COPY_SHARE = 0.8
#: Lines of more words may be prose that pages quote.
PROSE_WORDS = 40

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
}
#: An end tag of an inline element or paragraph does not end these.
_BOX = {"article", "aside", "blockquote", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "ul", "ol", "li"}
_LEFT_OUT = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "dialog", "menu", "label", "fieldset"}
_ROLES_LEFT_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
#: Parts of class names and ids that name what is not the article.
_PARTS_LEFT_OUT = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts",
    "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment",
    "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended",
    "widget", "toolbar", "pagination", "pager", "banner", "masthead", "copyright", "disclaimer", "search", "skip", "paywall",
}
#: Words that class names join to those; a name of other words too ("share-of-market") names something else.
_PARTS_NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "content", "count", "form", "group", "icon",
    "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post",
    "posts", "right", "row", "section", "site", "text", "title", "top", "wrap", "wrapper",
}
#: Elements of running text; inside an article their class names tell nothing about the site.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "td", "th", "dd", "dt", "b", "i", "em", "strong", "a", "span"}
#: A class name with one of these describes a layout ("with-sidebar"), not the part itself.
_LAYOUT = {"with", "has", "no", "layout"}
_ARTICLE_PARTS = {"article", "post", "entry", "story", "content"}

OUT, OTHER, NAMED, MAIN, ARTICLE = range(5)


@dataclass(frozen=True)
class Line:
    """A block's text, the open elements around it, and what part of the page it is in."""

    text: str
    path: int
    part: int


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _part(name: str, attributes: dict[str, str], around: int) -> int:
    """Part of the page that an element opens inside another part."""
    if around == OUT:
        return OUT
    if name in _LEFT_OUT or name == "header" and around < MAIN:
        return OUT
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    if role in _ROLES_LEFT_OUT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return OUT
    parts: set[str] = set()
    for value in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        own = {p.lower() for p in _NAME_PART.findall(value)}
        if not own & _LAYOUT and own <= _PARTS_LEFT_OUT | _PARTS_NEUTRAL | _ARTICLE_PARTS | {"header"}:
            parts |= own
    if around == ARTICLE and name in _PROSE:
        parts = set()
    if name not in ("body", "html", "article", "main") and parts & _PARTS_LEFT_OUT:
        return OUT
    if name == "article":
        return OUT if parts & {"comment", "reply", "ad", "ads", "advert", "related", "promo", "sponsored"} else ARTICLE
    if role == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if name == "main" or role == "main":
        return max(around, MAIN)
    if name in ("div", "section") and parts & _ARTICLE_PARTS:
        return max(around, NAMED)
    if "header" in parts and around < MAIN:
        return OUT
    return around


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments have no name.

    Quotes in attributes may hold ``>``; one that is never closed is a sign like any other. Each search goes on
    from the last one's end, so that time follows the page's length whatever its markup.
    """
    last = {quote: html.rfind(quote) for quote in "\"'"}
    at, size = 0, len(html)
    while (start := html.find("<", at)) >= 0:
        if html.startswith(("<!", "<?"), start):
            ends = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            found = html.find(ends, start + 2)
            at = size if found < 0 else found + len(ends)
            yield start, at, "", False, ""
            continue
        name = _NAME.match(html, start)
        if not name:
            at = start + 1
            continue
        place = name.end()
        while (found := _QUOTE_OR_END.search(html, place)) and found[0] != ">":
            place = found.end()
            if last[found[0]] >= place:
                place = html.find(found[0], place) + 1
        end = found.start() if found else size
        at = min(end + 1, size)
        yield start, at, name[1].lower(), html[start + 1] == "/", html[name.end() : end]


class _Open:
    """The open elements, with the part of the page and the blocks around that each stands for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.count: Counter[str] = Counter()

    @property
    def part(self) -> int:
        return self.stack[-1][1] if self.stack else OTHER

    @property
    def path(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def push(self, name: str, part: int) -> None:
        # Blocks around are told by a number, which costs the same at any depth.
        self.stack.append((name, part, hash((self.path, name)) if name in _BLOCK else self.path))
        self.count[name] += 1

    def close(self, name: str, walls: set[str]) -> None:
        """Close the innermost element of this name, unless one of ``walls`` stands before it."""
        if not self.count[name]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                for other, _, _ in self.stack[i:]:
                    self.count[other] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in walls:
                return


def page_lines(html: str) -> list[Line]:
    """The lines of a page that no markup leaves out, in page order; markup may be broken or cut off."""
    lines: list[Line] = []
    pieces: list[str] = []
    open_ = _Open()
    path, opened, at, raw_until = 0, OTHER, 0, 0

    def text_to(end: int) -> None:
        nonlocal path, opened
        if open_.part != OUT and end > at:
            if not pieces:
                opened, path = open_.part, open_.path
            pieces.append(html[at:end])

    def end_line() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            lines.append(Line(text, path, opened))
        pieces.clear()

    for start, end, name, closes, attributes in tags(html):
        if start < raw_until:
            continue
        text_to(start)
        at = end
        if not name:
            continue
        if name in _BLOCK:
            end_line()
        if closes:
            open_.close(name, set() if name in _BOX else _BOX)
            continue
        if name in _RAW:
            # What is inside is no markup; without an end the rest of the page is inside.
            found = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, end)
            at = raw_until = found.end() if found else len(html)
            continue
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        if name == "p" or name == "li":
            # A paragraph or item that was not closed ends where the next one begins.
            open_.close(name, _BOX - {name})
        open_.push(name, _part(name, _attributes(attributes), open_.part))
    text_to(len(html))
    end_line()
    return lines


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both.

    Equal ends are matched at once. Between them the longest chain of matching places is built place by
    place (Hunt and Szymanski), so time follows the number of matching pairs.
    """
    start, end_a, end_b = 0, len(a), len(b)
    if set(a).isdisjoint(b):
        return set()
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    matched = set(range(start)) | set(range(end_a, len(a)))
    where: dict = {}
    for j in range(end_b - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chains: list[tuple] = []
    for i in range(start, end_a):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chains.append(chain)
            else:
                tails[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        matched.add(chain[0])
        chain = chain[1]
    return matched


@dataclass
class Page:
    page_id: int | None
    url: str | None
    host: str
    path: str
    lines: list[Line]
    #: Of the whole html: equal for exact copies.
    digest: int = 0
    #: Whether its text is asked for; other pages only stand beside those.
    wanted: bool = True


def _nearness(a: Page, b: Page) -> int:
    """Leading characters that two paths share."""
    n = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        n += 1
    return n


def _top(page: Page) -> int:
    """The part that holds the article: the highest one, unless one below has more text than all above it.

    The lines that count are those of this part and of higher ones. A page may have a story in a named block
    and a short ``article`` that only points to another one.
    """
    sizes = [0] * (ARTICLE + 1)
    for line in page.lines:
        sizes[line.part] += len(line.text)
    top = max((line.part for line in page.lines), default=OTHER)
    above = sizes[top]
    for part in range(top - 1, OTHER, -1):
        if sizes[part] > above:
            top = part
        above += sizes[part]
    return top


def _own_lines(page: Page, part: int) -> list[Line]:
    return [line for line in page.lines if line.part >= part]


def _keys(page: Page, part: int) -> list[tuple[int, str]]:
    return [(line.path, line.text) for line in _own_lines(page, part)]


def is_copy(a: Page, b: Page) -> bool:
    """Whether two pages of a host have the same lines, or lines that differ in a few words only.

    Lines that both share do not count, so a large frame around different text makes no copy.
    """
    part = _top(a)
    if part != _top(b):
        return False
    own, theirs = _keys(a, part), _keys(b, part)
    if own == theirs:
        return True
    mine, other = common_lines(own, theirs), common_lines(theirs, own)
    rest_a = " ".join(text for i, (_, text) in enumerate(own) if i not in mine)
    rest_b = " ".join(text for i, (_, text) in enumerate(theirs) if i not in other)
    few, many = sorted((rest_a.count(" ") + bool(rest_a), rest_b.count(" ") + bool(rest_b)))
    return few > COPY_SHARE * many and (Counter(rest_a.split(" ")) & Counter(rest_b.split(" "))).total() > COPY_SHARE * many


def kept_lines(page: Page, neighbours: list[Page]) -> list[Line]:
    """The page's lines without those of its site's frame, which the nearest page that is no copy shares.

    What all neighbours share tells nothing about copies; a neighbour that also shares nearly all other lines
    is a copy. Lines inside ``article`` and long ones are prose that a neighbour may quote: they go only if at
    least two neighbours that are no copies have such a part and every one of these shares the line.
    """
    top = _top(page)
    own = _own_lines(page, top)
    keys = _keys(page, top)
    near = sorted(neighbours, key=lambda p: -_nearness(page, p))
    pairs = [(common_lines(keys, theirs), theirs) for p in near if (theirs := _keys(p, top))]
    # A page without a line of its own beside this one, or the other way round, may be a copy with more text.
    found = [shared for shared, theirs in pairs if len(shared) < min(len(own), len(theirs))]
    always = set.intersection(*found) if found else set()
    found = [shared for shared in found if len(shared - always) <= COPY_SHARE * (len(own) - len(always))]
    if not found:
        return own
    by_all = set.intersection(*found) if len(found) > 1 else set()
    return [
        line for i, line in enumerate(own)
        if i not in found[0] or (line.part == ARTICLE or line.text.count(" ") >= PROSE_WORDS) and i not in by_all
    ]


@dataclass
class _Run:
    """Exact copies that follow one another, the number of their run, and the pages before them, nearest first."""

    number: int
    pages: list[Page]
    before: list[Page]


class Nearest:
    """Settles the pages of one host in their order; what a page keeps follows from the pages around it alone.

    Of the ``NEAR`` nearest pages on each side that are no exact copies of it or of one another, the first
    ``REACH`` different ones count: no copies of the page, nor of each other. Exact copies in a row settle as one
    run, so a page waits until ``NEAR`` others have followed it, however many copies lie between.
    """

    def __init__(self) -> None:
        #: The last pages by digest, newest last.
        self.recent: OrderedDict[int, Page] = OrderedDict()
        self.runs: deque[_Run] = deque()
        #: The waiting runs of each digest.
        self.waiting: dict[int, deque[_Run]] = {}
        self.copies: dict[tuple[int, int], bool] = {}
        self.n = 0

    def lines(self, digest: int) -> list[Line] | None:
        """The lines of a page that is still near."""
        if digest in self.recent:
            return self.recent[digest].lines
        return self.waiting[digest][0].pages[0].lines if digest in self.waiting else None

    def add(self, page: Page) -> Iterator[tuple[Page, str]]:
        if self.runs and self.runs[-1].pages[0].digest == page.digest:
            self.runs[-1].pages.append(page)
        else:
            before = [p for digest, p in reversed(self.recent.items()) if digest != page.digest][:NEAR]
            self.runs.append(_Run(self.n, [page], before))
            self.waiting.setdefault(page.digest, deque()).append(self.runs[-1])
            self.n += 1
        self.recent[page.digest] = page
        self.recent.move_to_end(page.digest)
        if len(self.recent) > NEAR + 1:
            self.recent.popitem(last=False)
        while len(self.waiting) > NEAR:
            yield from self._settle()

    def end(self) -> Iterator[tuple[Page, str]]:
        while self.runs:
            yield from self._settle()

    def _settle(self) -> Iterator[tuple[Page, str]]:
        run = self.runs.popleft()
        digest = run.pages[0].digest
        after = sorted((runs[0] for d, runs in self.waiting.items() if d != digest), key=lambda r: r.number)
        self.waiting[digest].popleft()
        if not self.waiting[digest]:
            del self.waiting[digest]
        wanted = [page for page in run.pages if page.wanted]
        if not wanted:
            return
        sides = (run.before, [r.pages[0] for r in after[:NEAR]])
        others = {p.digest: p for side in sides for p in self._different(run.pages[0], side)}.values()
        texts: dict[tuple[int, ...], str] = {}
        for page in wanted:
            near = sorted(others, key=lambda p: -_nearness(page, p))
            order = tuple(p.digest for p in near)
            if order not in texts:
                texts[order] = " ".join(line.text for line in kept_lines(page, near))
            yield page, texts[order]

    def _different(self, page: Page, side: list[Page]) -> list[Page]:
        chosen: list[Page] = []
        for p in side:
            if len(chosen) < REACH and not any(self._is_copy(p, q) for q in (page, *chosen)):
                chosen.append(p)
        return chosen

    def _is_copy(self, a: Page, b: Page) -> bool:
        pair = (min(a.digest, b.digest), max(a.digest, b.digest))
        if pair not in self.copies:
            if len(self.copies) > 20_000:
                self.copies.clear()
            self.copies[pair] = is_copy(a, b)
        return self.copies[pair]


#: What pages are sorted by; the digest tells equal addresses apart.
ORDER = ["host", "path", "page_key", "digest"]
KEY = "host string, path string, page_key bigint, digest bigint"
#: Ranges hold about so many pages at least, beside which the pages around a range are few.
RANGE_PAGES = 1_024
#: More ranges are not made: the ends of all are on the driver and broadcast, 2 * (NEAR + 1) keys each.
RANGES = 1 << 14


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its first key, whether it is one host, and the keys of the distinct pages at both ends.

    ``heads`` are the first pages of the first host, ``tails`` the last ones of the last host, newest first.
    """
    first = host = None
    heads: dict[int, tuple] = {}
    tails: OrderedDict[int, tuple] = OrderedDict()
    one = True
    for batch in batches:
        for key in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if first is None:
                first = key
            elif key[0] != host:
                one = False
                tails.clear()
            host = key[0]
            if one and len(heads) <= NEAR:
                heads.setdefault(key[3], key)
            tails[key[3]] = key
            tails.move_to_end(key[3])
            if len(tails) > NEAR + 1:
                tails.popitem(last=False)
    if first is not None:
        names = [f.split()[0] for f in KEY.split(", ")]
        keys = lambda rows: [dict(zip(names, row, strict=True)) for row in rows]
        key_type = pa.struct(list(zip(names, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([one]), pa.array(keys([first]), key_type),
                pa.array([keys(heads.values())], pa.list_(key_type)), pa.array([keys(reversed(tails.values()))], pa.list_(key_type)),
            ],
            ["part", "one_host", "first", "heads", "tails"],
        )


def _around(ranges: list) -> dict[tuple, set[int]]:
    """Keys of the pages beside each range that it needs, with the ranges that need them.

    A range takes the nearest ``NEAR + 1`` distinct pages of its host from each side; through ranges with
    fewer of them, the ones beyond are passed on.
    """
    needed: dict[tuple, set[int]] = {}
    for places, ends in ((range(len(ranges)), ("heads", "tails")), (range(len(ranges) - 1, -1, -1), ("tails", "heads"))):
        passed: list = []
        for i in places:
            mine, outer = ranges[i][ends[0]], ranges[i][ends[1]]
            passed = [key for key in passed if key["host"] == mine[0]["host"]]
            for key in passed:
                needed.setdefault(tuple(key), set()).add(i)
            beyond = passed if ranges[i]["one_host"] else []
            distinct: dict[int, tuple] = {}
            for key in (*outer, *beyond):
                distinct.setdefault(key["digest"], key)
            passed = list(distinct.values())[: NEAR + 1]
    return needed


def _with_pages_around(pages: DataFrame) -> DataFrame:
    """Each page in its ``range`` of the order (``own``), and again in those beside which it stands.

    Only keys are sorted to find the ranges; the texts are shuffled once.
    """
    spark = pages.sparkSession
    wide = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(wide, RANGES, pages.count() // RANGE_PAGES))
    keys = pages.select(*ORDER).repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    ends = f"part int, one_host boolean, first struct<{KEY}>, heads array<struct<{KEY}>>, tails array<struct<{KEY}>>"
    ranges = sorted(keys.mapInArrow(_range_ends, ends).collect(), key=lambda r: r["part"])
    if len(ranges) < 2:
        return pages.select("*", F.lit(0).alias("range"), F.lit(True).alias("own")).repartitionById(1, "range")
    # Binary search for the last range that begins at or before a page; a constant array of the ranges' first keys.
    begins = F.from_json(F.lit(json.dumps([r["first"].asDict() for r in ranges[1:]])), f"array<struct<{KEY}>>")
    steps = [1 << bit for bit in reversed(range(len(ranges).bit_length()))]
    own = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step < len(ranges)) & (F.get(begins, at + step - 1) <= F.struct(*ORDER)), at + step).otherwise(at),
    )
    beside = spark.createDataFrame([(*key, sorted(places)) for key, places in _around(ranges).items()], f"{KEY}, beside array<int>")
    found = pages.join(F.broadcast(beside), ORDER, "left").withColumn("own_range", own)
    places = F.array_union(F.array("own_range"), F.coalesce("beside", F.array().cast("array<int>")))
    dealt = found.withColumn("range", F.explode(places)).withColumn("own", F.col("range") == F.col("own_range"))
    return dealt.repartitionById(len(ranges), "range")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each page, a row per input row.

    Pages are split into ranges of host and path, whatever one host's share; each range also gets the pages
    around it, so a page's text does not depend on how pages are split. Repeated rows have the same text, as
    copies of one another tell nothing about the frame. A null or empty page has an empty text; a null url is a
    host of its own. No pages give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> Iterator[tuple[Page, str]]:
            near, place = Nearest(), None
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(7)]
                for i, (part, own, page_id, url, host, path, digest) in enumerate(zip(*columns, strict=True)):
                    if (part, host) != place:
                        yield from near.end()
                        near, place = Nearest(), (part, host)
                    lines = near.lines(digest)
                    if lines is None:
                        lines = page_lines(batch.column(7)[i].as_py())
                    yield from near.add(Page(page_id, url, host, path, lines, digest, own))
            yield from near.end()

        ready: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            ids, urls, texts = zip(*ready, strict=True)
            sizes = [len(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        for page, text in settled():
            ready.append((page.page_id, page.url, text))
            if len(ready) >= 500:
                yield batch_of()
                ready.clear()
        if ready:
            yield batch_of()

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("page_key"),
        F.xxhash64(html).alias("digest"), html.alias("html"),
    )
    dealt = _with_pages_around(rows)
    columns = ["range", "own", "page_id", "url", "host", "path", "digest", "html"]
    return dealt.sortWithinPartitions("range", *ORDER).select(*columns).mapInArrow(run, EXTRACTED)
