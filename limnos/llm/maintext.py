"""Main text of web pages: nearest-URL page differencing over declared markup.

Each page becomes text lines, one a block, with what the markup says of each: part
of an article, part of the main region, boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, comments), or nothing.  Within a host, pages are
put in order of their URL path; a page's nearest page is the neighbour that shares
the longer start of its path.  The two pages' lines are aligned by a longest common
subsequence (bit-parallel, with the alignment found by halving, so memory stays
linear), and lines that they share are deleted, except lines that the markup
declares to be the article: copies of an article and passages that many articles
quote are shared too.  A page's text is its article lines; without any, those of
its main region; without any, its undeclared lines that are not shared.

Pages of a host with equal lines are one page to the alignment, so copies never
delete each other.  A neighbour that leaves a page less than a tenth of its
undeclared text is a copy with small changes: the other neighbour is taken, and if
that is one too, nothing is deleted.

Spark orders pages by range, so a host of any size is spread over many tasks; only
line hashes travel, and each task's first and last page meet their neighbours in
the next tasks' by a join on task numbers.  Texts never move: pages are read again
and meet the few lists of deleted lines.

Defined results: a NULL or empty html gives an empty text; a NULL or malformed url
has no neighbours; repeated rows give repeated results; an unclosed comment, script
or tag runs to the end; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import ship_with_tasks, stored

ship_with_tasks(__name__)

UNDECLARED, MAIN, ARTICLE, BOILERPLATE = range(4)

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript template svg math canvas audio video object select button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
HEAD_ONLY = frozenset("html head title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# The elements that a start tag ends, and those within which it does.
IMPLIED_END = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
               "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
# Elements, roles and words of class or id that mark boilerplate.  STRONG marks hold whatever is inside.
STRONG_TAGS = frozenset("nav footer aside menu dialog".split())
WEAK_TAGS = frozenset("header form search".split())
STRONG_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog menu menubar".split())
WEAK_ROLES = frozenset("banner form alert".split())
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus respond replies reply breadcrumb breadcrumbs".split())
WEAK_WORDS = frozenset(
    "banner sidebar menu nav navbar navigation header masthead footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login "
    "social share sharing related recommended widget toolbar pagination pager copyright form".split())
HEADER_WORDS = frozenset("header masthead banner".split())
ARTICLE_NAMES = frozenset("article article-body article-content articlebody post-content entry-content story-body".split())

SPECIAL = NO_TEXT | STRONG_TAGS | WEAK_TAGS | HEADINGS | {"article", "main"}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_TAG_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {name: re.compile("(?i)</" + name) for name in RAW}
_ASKED = re.compile(r"(?i)class|id\b|role|itemprop|hidden|style")


class _Region:
    """What the open elements say of the text inside them."""

    __slots__ = ("name", "silent", "boiler", "strong", "header", "level")

    def __init__(self, name="", silent=False, boiler=False, strong=False, header=False, level=UNDECLARED):
        self.name, self.silent, self.boiler, self.strong, self.header, self.level = name, silent, boiler, strong, header, level

    def kind(self) -> int:
        return BOILERPLATE if self.boiler else self.level


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if _ASKED.search(text) else {}


def _enter(name: str, attributes: dict[str, str], outer: _Region) -> _Region:
    """The region of an element inside ``outer``."""
    if not attributes and name not in SPECIAL:
        return _Region(name, outer.silent, outer.boiler, outer.strong, outer.header, outer.level)
    names = (attributes.get("class", "") + " " + attributes.get("id", "")).split()
    words = set() if name in ("html", "body") else {w.lower() for n in names for w in _WORD.findall(n)}
    role = attributes.get("role", "").lower()
    silent = (outer.silent or name in NO_TEXT or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
              or "display:none" in attributes.get("style", "").replace(" ", "").lower())
    article = name == "article" or "articleBody" in attributes.get("itemprop", "") or any(n.lower() in ARTICLE_NAMES for n in names)
    main = name == "main" or role == "main"
    strong = outer.strong or name in STRONG_TAGS or role in STRONG_ROLES or bool(words & STRONG_WORDS)
    level, boiler, header = outer.level, outer.boiler, outer.header
    if article or main:
        level, boiler, header = max(level, ARTICLE if article else MAIN), strong, False
    elif name in WEAK_TAGS or role in WEAK_ROLES or words & WEAK_WORDS:
        header = not outer.boiler and level != UNDECLARED and (name == "header" or bool(words & HEADER_WORDS)) and not words & (WEAK_WORDS - HEADER_WORDS)
        boiler = True
    boiler = boiler or strong
    if name in HEADINGS and header and not strong:  # an article's own header keeps its headings
        boiler = False
    return _Region(name, silent, boiler, strong, header, level)


class _Stack:
    """Open elements, with the places of each name for constant-time scope tests."""

    def __init__(self):
        self.items, self.places = [_Region()], {}

    def push(self, region: _Region) -> None:
        self.places.setdefault(region.name, []).append(len(self.items))
        self.items.append(region)

    def last(self, *names: str) -> int:
        found = 0
        for name in names:
            at = self.places.get(name)
            if at and at[-1] > found:
                found = at[-1]
        return found

    def cut(self, place: int) -> None:
        while len(self.items) > place:
            self.places[self.items.pop().name].pop()


def _tag_end(page: str, at: int, unclosed: set) -> int:
    """Where the tag that starts before ``at`` ends (its ``>``), or -1."""
    while True:
        stop = _TAG_STOP.search(page, at)
        if stop is None:
            return -1
        if stop[1] is None:
            return stop.start()
        close = -1 if stop[1] in unclosed else page.find(stop[1], stop.end())
        if close < 0:  # no such quote follows: it is an ordinary character
            unclosed.add(stop[1])
            close = stop.end() - 1
        at = close + 1


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space collapsed, with what the markup says of each."""
    page, out, parts, stack, unclosed = page or "", [], [], _Stack(), set()
    at, size, kind, endless = 0, len(page), [UNDECLARED], set()

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, kind[0]))
        parts.clear()

    def say(start, end):
        region = stack.items[-1]
        if start < end and not region.silent:
            now = region.kind()
            if now != kind[0]:  # an inline element of another kind parts its block
                if any(not p.isspace() for p in parts):
                    flush()
                kind[0] = now
            parts.append(html_entities.unescape(page[start:end]))

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(at, size)
            break
        tag = _TAG.match(page, lt)
        if tag is None:
            if page.startswith("<!--", lt):
                say(at, lt)
                end = page.find("-->", lt + 4)
                end = end + 2 if end >= 0 else size
            elif page.startswith(("<!", "<?", "</"), lt):
                say(at, lt)
                end = page.find(">", lt)
                end = size if end < 0 else end
            else:
                say(at, lt + 1)
                end = lt
            at = end + 1
            continue
        say(at, lt)
        name = tag[2].lower()
        end = _tag_end(page, tag.end(), unclosed)
        if end < 0:
            break
        at = end + 1
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if tag[1]:
            place = stack.last(name)
            if place:
                stack.cut(place)
            continue
        if name not in HEAD_ONLY and stack.places.get("head"):
            stack.cut(stack.last("head"))
        if name in BLOCKS and stack.places.get("p") and (place := stack.last("p")) > stack.last("button", "object", "td", "th", "caption"):
            stack.cut(place)
        if name in IMPLIED_END:
            ended, within = IMPLIED_END[name]
            while (place := stack.last(*ended)) > stack.last(*within):
                stack.cut(place)
        if name in VOID or page[end - 1] == "/" and name in ("path", "g", "circle", "rect"):
            continue
        stack.push(_enter(name, _attributes(page[tag.end():end]), stack.items[-1]))
        if name in RAW:
            close = None if name in endless else _RAW_END[name].search(page, at)
            if close is None:
                if name in ("script", "style"):
                    break
                endless.add(name)
                continue
            at = close.start()
    flush()
    return out


# ---------------------------------------------------------------- alignment
def _row(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b`` (bit-parallel over ``b``)."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks, full = {}, (1 << len(b)) - 1
    v = full
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = masks.get(x)
        if mask is None:
            mask = 0
            if len(at) > 32:  # kept: at most one mask for 32 lines
                bits = np.zeros(len(b), np.uint8)
                bits[at] = 1
                mask = masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                for j in at:
                    mask |= 1 << j
        u = v & mask
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a: list, b: list, shift: int, out: list) -> None:
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append(shift)
        return
    half = len(a) // 2
    cut = int(np.argmax(_row(a[:half], b) + _row(a[:half - 1:-1], b[::-1])[::-1]))
    _align(a[:half], b[:cut], shift, out)
    _align(a[half:], b[cut:], shift + half, out)


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    here, there = set(a), set(b)
    places = [i for i in range(start, len(a) - tail) if a[i] in there]
    found: list[int] = []
    _align([a[i] for i in places], [x for x in b[start:len(b) - tail] if x in here], 0, found)
    return [*range(start), *(places[i] for i in found), *range(len(a) - tail, len(a))]


def _shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _decide(path: str, hashes: list, kinds: list, lens: list, neighbours: list[tuple[str, list]]) -> tuple[list[bool], int]:
    """Which undeclared lines go, and how many lines the nearest page shares."""
    mine = sum(n for n, k in zip(lens, kinds, strict=True) if k == UNDECLARED)
    nearest = None
    for _, other in sorted(neighbours, key=lambda p: -_shared_start(path, p[0])):
        shared = common_lines(hashes, other)
        nearest = len(shared) if nearest is None else nearest
        gone = [i for i in shared if kinds[i] == UNDECLARED]
        if gone and 10 * (mine - sum(lens[i] for i in gone)) >= mine:
            flags = [False] * len(hashes)
            for i in gone:
                flags[i] = True
            return flags, nearest
    return [], nearest or 0


# ---------------------------------------------------------------- Spark
PARSED = "page_id long, url string, sig1 long, sig2 long, texts array<string>, kinds array<tinyint>, hashes array<long>"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64())]
    names = ["page_id", "url", "sig1", "sig2", "texts", "kinds", "hashes"]
    for batch in batches:
        rows, held = [], 0
        for page_id, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            lines = page_lines(page)
            hashes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in lines], np.uint64).view(np.int64)
            packed = hashes.tobytes() + bytes(k for _, k in lines)
            sigs = np.array([xxhash.xxh3_64_intdigest(packed), xxhash.xxh64_intdigest(packed, 5)], np.uint64).view(np.int64).tolist()
            rows.append((page_id, url, *sigs, [t for t, _ in lines], [k for _, k in lines], hashes.tolist()))
            held += len(page or "")
            if held > 1 << 25:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, texts and kinds of each page's lines, their hashes, and two hashes of them all."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_parse_batches, PARSED)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _ADDRESS, 1))
    return rows.select("*", F.nullif(host, F.lit("")).alias("host"), F.regexp_extract(F.coalesce("url", F.lit("")), _ADDRESS, 2).alias("path"))


def _struct(name: str) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in ("host", "path", "sig1", "sig2", "hashes")]).alias(name)


def with_neighbours(distinct: DataFrame) -> DataFrame:
    """``distinct`` (host, path, sig1, sig2, hashes, ...) with ``before`` and ``after``, its neighbours in that order."""
    keys = ["host", "path", "sig1", "sig2"]
    parts = stored(distinct.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "pages-ordered")
    window = Window.partitionBy("part").orderBy(*keys)
    inner = parts.select("*", F.lag(_struct("x")).over(window).alias("before"), F.lead(_struct("x")).over(window).alias("after"))
    key = F.struct(*keys)
    ends = parts.groupBy("part").agg(F.min_by(_struct("x"), key).alias("first"), F.max_by(_struct("x"), key).alias("last"))
    numbers = ends.select("part")  # one number a task of the sort
    order = Window.orderBy("part")
    numbers = numbers.select(F.col("part").alias("at"), F.lag("part").over(order).alias("left"), F.lead("part").over(order).alias("right"))
    lasts, firsts = ends.select(F.col("part").alias("left"), F.col("last")), ends.select(F.col("part").alias("right"), F.col("first"))
    edges = numbers.join(lasts, "left", "left").join(firsts, "right", "left").select(F.col("at").alias("part"), "last", "first")
    joined = inner.join(edges, "part")
    near = lambda c: F.when(F.col(c)["host"] == F.col("host"), F.col(c))
    joined = joined.withColumn("before", F.coalesce("before", "last")).withColumn("after", F.coalesce("after", "first")).drop("last", "first", "part")
    return joined.withColumn("before", near("before")).withColumn("after", near("after"))


DECIDED = "host string, sig1 long, sig2 long, n_lines long, n_shared long, gone array<boolean>"


def _decide_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.bool_())]
    names = ["host", "sig1", "sig2", "n_lines", "n_shared", "gone"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pairs = [(n["path"], n["hashes"]) for n in (r["before"], r["after"]) if n]
            gone, shared = _decide(r["path"], r["hashes"], r["kinds"], r["lens"], pairs)
            rows.append((r["host"], r["sig1"], r["sig2"], len(r["hashes"]), shared, gone))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def page_differences(parsed: DataFrame) -> DataFrame:
    """Per host and distinct page: n_lines, n_shared (lines of the nearest page too) and ``gone``, a flag a line, empty if none goes."""
    known = parsed.where("host IS NOT NULL").select("host", "path", "sig1", "sig2", "hashes", "kinds", F.transform("texts", F.length).alias("lens"))
    distinct = known.groupBy("host", "sig1", "sig2").agg(F.min("path").alias("path"), *[F.any_value(c).alias(c) for c in ("hashes", "kinds", "lens")])
    return with_neighbours(distinct).mapInArrow(_decide_batches, DECIDED)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html)."""
    parsed = parse_pages(pages)
    gone = stored(page_differences(parsed).where(F.size("gone") > 0).select(
        F.col("host").alias("_host"), F.col("sig1").alias("_1"), F.col("sig2").alias("_2"), "gone"), "pages-shared")
    lines = F.arrays_zip("texts", "kinds")
    best = F.array_max(F.filter("kinds", lambda k: k != BOILERPLATE))
    rows = parsed.select("page_id", "url", "host", "sig1", "sig2", lines.alias("lines"), best.alias("best"))
    met = rows.join(gone, (F.col("host") == F.col("_host")) & (F.col("sig1") == F.col("_1")) & (F.col("sig2") == F.col("_2")), "left")
    kept = F.filter("lines", lambda x, i: (x["kinds"] == F.col("best")) & ((F.col("best") != UNDECLARED) | ~F.coalesce(F.get("gone", i), F.lit(False))))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), "\n\n")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
