"""Main text of web pages: marked regions by their markup, unmarked boilerplate by what the pages of a host repeat."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalode.llm.common import mix, prepare, written
from datalode.llm.urls import host_and_path

#: Words of a string that counts as repeated when another page of the host has it too.
REPEATED = 6
#: A string of articles is of a notice of the host when so many pages, more than half of the host's, have it in articles that are else their own.
NOTICED = 5
#: Strings of articles that are held before the frequent ones are told.
HELD = 1 << 21

# Names of HTML elements, from the public standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
CUT = frozenset("aside audio button canvas datalist dialog footer form head menu nav noscript object optgroup option search select svg template video".split())
#: Elements that an open one of their kind ends, and those it does not look beyond.
ENDS_OWN = {"p": (), "li": ("ol", "ul", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or an id that mark a region as none of the article.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs colophon comment comments commentlist consent cookie cookies"
    " disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related"
    " replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Of these, what an article, a main part or a body may be called without being one.
NAMED = frozenset(["comment", "comments", "replies", "ad", "ads", "advert", "advertisement", "sponsored"])

_TOKEN = re.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What a block of text is.
ARTICLE, MAIN, UNMARKED, MARKED = 0, 1, 2, 3


def _marked(name: str, attributes: str, kind: int) -> bool:
    """Whether an element is none of the article by its name, role, class or id."""
    if name in CUT or name == "header" and kind > MAIN:
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for key in ("class", "id") if key in found for w in _PARTS.findall(unescape(found[key]))}
    if name in ("html", "body"):
        return False
    if name in ("article", "main"):
        return bool(words & NAMED)
    return bool(words & MARKS) or "header" in words and kind > MAIN


def blocks_of(html: str, articles: bool = True) -> list[tuple[int, str]]:
    """Kind and text of every block of a page, in order; white space is one space, references are decoded.

    Scripts, styles, comments of the markup and titles give nothing. Unclosed and crossed elements end where the
    element around them does. A part that never ends reaches to the end of the page. Without ``articles`` the texts of
    articles are a sign each, which is all that some callers need."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    kind, at, size = UNMARKED, 0, len(html)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((kind, text))

    def close(depth: int) -> None:
        nonlocal kind
        outer = stack[depth][1]
        if outer != kind:
            if parts:
                flush()
            kind = outer
        del stack[depth:]

    def opened(name: str, beyond: tuple[str, ...]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            other = stack[i][0]
            if other == name:
                return i
            if other in beyond or not beyond and other in BLOCK:
                return -1
        return -1

    def add(text: str) -> None:
        if articles or kind != ARTICLE:
            parts.append(unescape(text) if "&" in text else text)
        elif (not out or out[-1][0] != ARTICLE) and (unescape(text) if "&" in text else text).split():
            out.append((ARTICLE, "-"))

    for found in _TOKEN.finditer(html):
        start, end = found.span()
        if start < at:
            continue  # within a script or the like
        if start > at:
            add(html[at:start])
        at = end
        ends, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if block and parts:
            flush()
        if ends:
            if name not in ("body", "html"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
            continue
        if name == "br":
            parts.append(" ")
        if block and stack:
            depth = opened("p", ())  # a block ends the paragraph before it
            if depth >= 0:
                close(depth)
            if name in ENDS_OWN and name != "p" and (depth := opened(name, ENDS_OWN[name])) >= 0:
                close(depth)
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else size
            continue
        if name in VOID or not block and name not in ("svg", "math") and attributes.endswith("/"):
            continue
        inner = kind
        if kind != MARKED:
            if _marked(name, attributes, kind):
                inner = MARKED
            elif name == "article":
                inner = ARTICLE
            elif kind == UNMARKED and (name == "main" or "role" in attributes and _MAIN_ROLE.search(attributes)):
                inner = MAIN
        stack.append((name, kind))
        if inner != kind:
            if parts:
                flush()
            kind = inner
    if at < size:
        add(html[at:])
    flush()
    return out


def _main(blocks: list[tuple[int, str]]) -> int:
    """Which kind of blocks is the page's main text: its articles, else its main part, else all that is not marked; MARKED if there is none."""
    return min((kind for kind, _ in blocks), default=MARKED) if blocks else MARKED


def _stream(blocks: list[tuple[int, str]], main: int) -> list[str]:
    """The words of a page outside its article or main part, in order; ``_article_suffixes`` has those within."""
    return [w for kind, text in blocks if main == UNMARKED or kind > main for w in text.split(" ")]


class Suffixes:
    """The suffix array of the token streams of one host's pages, up to REPEATED tokens deep.

    Streams lie one after the other; a suffix is a start with at least REPEATED tokens of its page after it. Suffixes are sorted
    by those tokens, so equal strings are neighbours; ``keys`` tells of each sorted suffix the string, for the meeting with other parts of the host."""

    _STEPS = np.random.default_rng(11).integers(1, 2**63, REPEATED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, host: str, streams: list[list[str]]) -> None:
        sizes = np.array([len(s) for s in streams])
        tokens = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for s in streams for w in s], np.uint64)
        page = np.repeat(np.arange(len(streams)), sizes)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.flatnonzero(place + REPEATED <= sizes[page]) if len(tokens) else np.zeros(0, np.int64)
        if len(starts):
            strings = tokens[starts[:, None] + np.arange(REPEATED)]
            order = np.lexsort(strings.T[::-1])
            strings, starts = strings[order], starts[order]
            with np.errstate(over="ignore"):
                sums = (strings * self._STEPS).sum(axis=1, dtype=np.uint64) + np.uint64(xxhash.xxh64_intdigest(host.encode("utf-8", "replace")))
            self.keys = mix(sums).view(np.int64)
            self.first = np.flatnonzero(np.append(True, (strings[1:] != strings[:-1]).any(axis=1)))
        else:
            self.keys, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.page, self.place = page[starts], place[starts]


def _by_host(b: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[list[str]]]]:
    """The pages of a batch by host, with their streams."""
    hosts: dict[str, list[int]] = {}
    for i, h in enumerate(b.column("host").to_pylist()):
        if h:
            hosts.setdefault(h, []).append(i)
    html = b.column("html")
    for host, rows in hosts.items():
        pages = [blocks_of(html[i].as_py() or "", articles=False) for i in rows]
        yield host, rows, [_stream(p, _main(p)) for p in pages]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of a host's suffix array, with the smallest and the largest page that has it."""
    for b in batches:
        page = b.column("page").to_numpy()
        for host, rows, streams in _by_host(b):
            array = Suffixes(host, streams)
            if len(array.keys):
                ids = page[np.array(rows)][array.page]
                columns = [array.keys[array.first], np.minimum.reduceat(ids, array.first), np.maximum.reduceat(ids, array.first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "least", "most"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of every string: its page and word."""
    for b in batches:
        page = b.column("page").to_numpy()
        for host, rows, streams in _by_host(b):
            array = Suffixes(host, streams)
            if len(array.keys):
                columns = [array.keys, page[np.array(rows)][array.page], array.place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "page", "place"])


class _Codes(dict):
    """Hashes of words, worked out once."""

    def __missing__(self, word: str) -> int:
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return code


def _article_suffixes(b: pa.RecordBatch, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every suffix of the blocks of articles and main parts, by its host and first REPEATED words: key, row and place among the words there. None reaches over its block's end."""
    words, sizes, rows = [], [], []
    hosts = b.column("host").to_pylist()
    for i, (host, html) in enumerate(zip(hosts, b.column("html").to_pylist(), strict=True)):
        blocks = blocks_of(html or "") if host else []
        main = _main(blocks)
        if main < UNMARKED:
            for kind, text in blocks:
                if kind == main:
                    some = text.split(" ")
                    words += some
                    sizes.append(len(some))
                    rows.append(i)
    tokens = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    sizes = np.array(sizes, np.int64)
    row, at = np.repeat(np.array(rows, np.int64), sizes), np.arange(len(tokens))
    starts = np.flatnonzero(at + REPEATED <= np.repeat(np.cumsum(sizes), sizes))
    sites = np.array([codes[h or ""] for h in hosts], np.uint64)
    with np.errstate(over="ignore"):
        keys = sites[row[starts]]
        for k in range(REPEATED):
            keys += tokens[starts + k] * Suffixes._STEPS[k]
    return mix(keys).view(np.int64), row[starts], (at - np.searchsorted(row, row))[starts]


def _frequent(least: float):
    """Strings of articles that more than this share of a host's pages have, among those held at once: key, site, pages that have it, pages of the host."""

    def told(keys: np.ndarray, page: np.ndarray, site: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        sites, pages = np.unique(np.unique(own, axis=0)[:, 0], return_counts=True)
        order = np.argsort(keys)
        keys, page, site = keys[order], page[order], site[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        counts = np.diff(np.append(first, len(keys)))
        many = np.repeat(counts > least * pages[np.searchsorted(sites, site[first])], counts)  # a page may have a string twice
        keys, page, site = keys[many], page[many], site[many]
        order = np.lexsort((page, keys))
        keys, page, site = keys[order], page[order], site[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        first = np.flatnonzero(new)
        n = np.add.reduceat(new | np.append(True, page[1:] != page[:-1])[: len(keys)], first, dtype=np.int64) if len(first) else first
        of = pages[np.searchsorted(sites, site[first])]
        fit = np.flatnonzero(n > least * of)
        fit = fit[np.argsort(site[first[fit]], kind="stable")]  # makes the shuffle smaller
        return pa.RecordBatch.from_arrays([pa.array(x[fit]) for x in (keys[first], site[first], n, of)], names=["key", "site", "n", "of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, codes = [], 0, _Codes()
        for b in batches:
            page, site = b.column("page").to_numpy(), b.column("site").to_numpy()
            keys, row, _ = _article_suffixes(b, codes)
            held.append((keys, page[row], site[row], np.stack([site, page], axis=1)))
            size += len(keys) + b.num_rows
            if size > HELD:
                yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size, codes = [], 0, _Codes()
        if size:
            yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _article_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of every string of articles: its page and word."""
    for b in batches:
        keys, row, place = _article_suffixes(b, _Codes())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(b.column("page").to_numpy()[row]), pa.array(place.astype(np.int32))], names=["key", "page", "place"])


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first REPEATED words of every block of articles and main parts that has as many.

    With them the block's place in its article, its words and the article's."""
    for b in batches:
        found, keys = [], []
        for host, html, page in zip(*(b.column(c).to_pylist() for c in ("host", "html", "page")), strict=True):
            blocks = blocks_of(html or "") if host else []
            main = _main(blocks)
            if main >= UNMARKED:
                continue
            own = [text for kind, text in blocks if kind == main]
            sizes = [text.count(" ") + 1 for text in own]
            total = sum(sizes)
            for place, (text, n) in enumerate(zip(own, sizes, strict=True)):
                if n >= REPEATED:
                    first = " ".join(text.split(" ", REPEATED)[:REPEATED])
                    keys.append(xxhash.xxh64_intdigest(f"{host}\n{first}".encode("utf-8", "replace")))
                    found.append((page, place, n, total))
        if found:
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["opening", "page", "place", "words", "total"])


def _copied(asked: DataFrame) -> DataFrame:
    """Pages whose articles have half of their words or more in blocks that open as a block of another page does."""
    blocks = written(asked.mapInArrow(_openings, "opening long, page long, place int, words int, total int"), "openings")
    shared = blocks.groupBy("opening").agg(F.min("page").alias("least"), F.max("page").alias("most")).where(F.col("least") < F.col("most")).select("opening")
    parts = blocks.join(shared, "opening").groupBy("page").agg(F.collect_set(F.struct("place", "words")).alias("parts"), F.first("total").alias("total"))  # a set: rows may repeat
    return parts.where(2 * F.aggregate("parts.words", F.lit(0), lambda a, n: a + n) >= F.col("total")).select("page")


def _notices(asked: DataFrame) -> DataFrame | None:
    """page, notices: places of the strings in a page's articles that are of notices of its host; None if there are none.

    A string on more than half of a host's pages is on more than half of those that some task holds at once (less, where rows repeat), so tasks
    tell of all strings but few, and only these are counted over all pages. A copied article repeats as a whole, a notice stands in articles
    that differ. So pages of copied articles do not count."""
    asked = asked.where("host <> ''")
    sites = written(asked.groupBy("site").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("rows")), "sites")
    share = sites.agg(F.min(F.col("pages") / F.col("rows"))).first()[0]
    if share is None:
        return None
    least = share / 2  # where a string has no larger share of the pages that any task holds, it has at most half of the host's
    found = asked.mapInArrow(_frequent(least), "key long, site long, n long, of long").groupBy("key", "site").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    most = 2 * (F.col("n") + least * (F.col("rows") - F.col("of")))
    few = written(found.join(sites, "site").where((F.col("pages") >= NOTICED) & (most > F.col("pages"))).select("key", "site", "pages"), "frequent")
    if few.isEmpty():
        return None
    some = lambda of: asked.join(of.select("site").distinct(), "site", "left_semi")
    strings = lambda of: some(of).mapInArrow(_article_strings, "key long, page long, place int")
    own = strings(few).join(few, "key").join(written(_copied(some(few)), "copied"), "page", "left_anti")
    counted = own.groupBy("key").agg(F.count_distinct("page").alias("n"), F.first("site").alias("site"), F.first("pages").alias("pages"))
    often = written(counted.where((F.col("n") >= NOTICED) & (2 * F.col("n") > F.col("pages"))).select("key", "site"), "often")
    return None if often.isEmpty() else strings(often).join(often.select("key"), "key").groupBy("page").agg(F.collect_set("place").alias("notices"))


def main_text(blocks: list[tuple[int, str]], places: list[int], notices: list[int] = ()) -> tuple[str, int]:
    """A page's main text, and how many words outside its article or main part lie in repeated strings (which start at ``places``).

    Of articles and main parts the blocks go whose words all lie in strings of notices of the host (which start at ``notices``, among the words there). Where nothing is marked as one, blocks
    whose words all lie in repeated strings go. Neither, if nothing would stay. Marked blocks are never main text."""
    main = _main(blocks)
    covered, noticed = (np.zeros(max(starts, default=-REPEATED) + REPEATED, bool) for starts in (places, notices))
    for marks, starts in ((covered, places), (noticed, notices)):
        for p in starts:
            marks[p : p + REPEATED] = True
    marks = covered if main == UNMARKED else noticed
    own, kept, at, within = [], [], 0, 0
    for kind, text in blocks:
        n = text.count(" ") + 1
        if kind == main < MARKED:
            a = at if main == UNMARKED else within
            own.append(text)
            if a + n > len(marks) or not marks[a : a + n].all():
                kept.append(text)
            within += n
        at += n
    return " ".join(kept or own), int(covered.sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the blocks that decide on their text, made small for the way to the places; no block has a line's end."""
    for b in batches:
        small = []
        for html in b.column("html").to_pylist():
            blocks = blocks_of(html or "")
            main = _main(blocks)
            text = "\n".join(f"{kind}{text}" for kind, text in blocks if kind == main or main == UNMARKED)
            small.append(zlib.compress(text.encode("utf-8", "replace"), 1))
        yield pa.RecordBatch.from_arrays([b.column("page"), b.column("page_id"), b.column("url"), pa.array(small, pa.binary())], names=["page", "page_id", "url", "packed"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, counts = [], []
        for packed, places, notices in zip(*(b.column(c).to_pylist() for c in ("packed", "places", "notices")), strict=True):
            lines = zlib.decompress(packed).decode()
            text, n = main_text([(int(x[0]), x[1:]) for x in lines.split("\n")] if lines else [], places or [], notices or [])
            texts.append(text)
            counts.append(n)
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), sizes, pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated"])


def extract_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text, n_chars and n_repeated of every row.

    What the markup tells goes by the markup: elements, roles, classes and ids of menus, headers, footers, sidebars, notices, adverts,
    forms and comments. The text is that of the page's articles, else of its main part, else of all that is left, less the blocks
    that the host repeats: the words outside of an article or main part of all pages of a host are one stream, whose suffix array
    shows the strings of REPEATED words and more that distinct pages have. Of articles and main parts the array takes all suffixes too, each to its
    block's end. A string that NOTICED pages and more than half of the host's have there, in articles that are else their own, is of a notice of the host, wherever
    in a block it stands. Blocks go whose words all lie in such strings; copied articles, and passages that fewer of the host's articles share, stay whole.

    A host's pages are sorted in the batches in which they come; only the different strings of a batch meet those of the others, so
    a host may hold any share of the pages. ``n_repeated`` counts the words outside the article that repeated strings cover.

    Null, empty and broken pages give what they hold, down to an empty text; white space is Unicode's. Pages whose URL has no host are compared with
    no other. A row that repeats in all columns is one page; one that repeats an id is a page of its own. Long pages count whole; no rows give none."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.xxhash64(F.col(id), F.col(url), F.col(html)).alias("page"), F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    asked = rows.select("page", host_and_path("url")[0].alias("host"), "html").withColumn("site", F.xxhash64("host"))
    strings = asked.mapInArrow(_strings, "key long, least long, most long").groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    repeated = strings.where(F.col("least") < F.col("most")).select("key")
    places = asked.mapInArrow(_places, "key long, page long, place int").join(repeated, "key")
    places = places.groupBy("page").agg(F.collect_set("place").alias("places"))
    packed = rows.mapInArrow(_packed, "page long, page_id long, url string, packed binary").join(places, "page", "left")
    notices = _notices(asked)
    packed = packed.withColumn("notices", F.lit(None).cast("array<int>")) if notices is None else packed.join(notices, "page", "left")
    out = packed.select("page_id", "url", "packed", "places", "notices").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, n_repeated long")
    return out.withColumnsRenamed({"page_id": id, "url": url})
