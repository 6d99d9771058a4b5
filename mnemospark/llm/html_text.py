"""Main text of web pages with a host suffix array.

A light parser turns each page into blocks of text. Blocks inside an article or main element are main text and stay: an
article that several pages share is still the article of each. What stands in a menu, form, footer or the like by
element or role goes, on any page. All other blocks are open, and the host's suffix array decides them: substrings of
``depth`` tokens (words and tags) of the pages' open streams that are on at least ``min_pages`` distinct pages of a host
repeat, and the tokens that they cover are boilerplate.

Reader comments are unique by nature, so what a class or id word names a comment goes with those.

* An open block goes where covered tokens make up ``covered`` of its words: unique runs remain.
* A doubtful block, one outside the main zone of a page that has one, or in a container that a class or id word suggests
  to be an advert, notice, sidebar or the like, is judged with its container, all blocks of the host in elements of one
  path: covered words of ``share`` or more show that the host repeats itself there, and all go, rare ones too. Where the
  array has ``seen`` pages or more of a container and finds less, its runs are unique and stay, whatever the markup
  says. Only with fewer pages, where the array cannot tell, the markup decides: the doubtful block goes.

Main zones hold the bulk of a page and never enter the array, so it works on a small share of the html. Inside a main
zone no element goes by a part of its name; only the whole names of ``NAMED`` count there (reader comments, adverts).

Counts hold for the whole host. A host's distinct open streams are dealt to chunks of about ``chunk_bytes`` characters,
which bounds memory: the streams of a chunk are concatenated, with a separator of its own after each, and the suffixes
are ranked by prefix doubling to ``depth`` tokens. For each rank the chunk emits a 64-bit hash of the passage and at
most ``min_pages`` of its pages; these meet by hash over all chunks, and the passages that repeat go back to the chunks
that have them. How pages are dealt does not change a text. Pages are told apart by the hash of their whole stream: rows
of a host with equal streams are one page, and so are rows of one page_id (null is none) and what such rows link.

Defined results: null, empty or textless html gives the empty text and n_chars 0. Repeated rows each give a row. A
null url is a host of its own kind (empty). Truncated markup ends at its end, a script or the like without an end with its parent. A page of any
length is read whole, as one row: memory of a task grows with its longest page. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import join_by_size, written
from mnemospark.operators.components import components

READ = "page_id long, url string, host string, stream long, label long, parts array<struct<block int, text string>>, open array<string>, blocks array<struct<path long, doubtful boolean, a int, b int>>"
PASSAGES = "hash long, page long, seat long, one boolean"
COVERED = "host string, stream long, n long, blocks array<struct<path long, doubtful boolean, first boolean, words int, covered int>>"
MOST_BROADCAST = 50_000  # streams whose decisions are broadcast; more of them meet their rows in a shuffle
MAIN, ASIDE, SUSPECT, OPEN = "main", "aside", "suspect", "open"

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>=]+|=)*+)>|<(?:/?[a-zA-Z]|!)[^>]*\Z""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Without text of their own: scripts and styles, drawings, frames, form controls. They stand inside a line and do not end its block.
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_INLINE |= {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "semantics", "annotation"}  # formulas
_INLINE |= {"object", "canvas", "picture", "audio", "video", "ruby", "rt", "rp", *_RAW} - {"title"}
_SPACED = {"br", "td", "th"}
_ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
# Start tags that end an open element of these names, whose end tag may be left out.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS |= {n: {"p"} for n in ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")}
_READER_WORDS = {"comment", "comments", "disqus", "replies", "reply"}
_SUSPECT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
    "popup", "promo", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "comment-list", "reader-comments", "sidebar", "newsletter"}
_WORD = re.compile(r"[A-Za-z]+")


class Page(NamedTuple):
    stream: list[str]  # all tokens: tags by name, words
    parts: list[tuple[int, str]]  # text in page order, with the number of its open block; -1: main text
    open: list[str]  # tokens outside main zones and asides
    blocks: list[tuple[int, bool, int, int]]  # open blocks: container path, doubtful, first token in open, token after


def _kind(name: str, attributes: str, in_main: bool) -> str:
    """Zone that an element opens; empty: its parent's."""
    if name in _ASIDE_TAGS or name == "header" and not in_main:
        return ASIDE
    if attributes and ("=" in attributes or "hidden" in attributes):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
        if found.get("role", "").lower() in _ASIDE_ROLES or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) or "display:none" in found.get("style", "").replace(" ", ""):
            return ASIDE
        names = f"{found.get('class', '')} {found.get('id', '')}".lower()
        if in_main:
            return ASIDE if not NAMED.isdisjoint(names.split()) else ""
        if name in ("article", "main") or found.get("role", "").lower() in ("main", "article"):
            return MAIN if NAMED.isdisjoint(names.split()) else ASIDE
        words = set() if name in ("html", "body") else set(_WORD.findall(names))
        if not words.isdisjoint(_READER_WORDS):
            return ASIDE
        if not words.isdisjoint(_SUSPECT_WORDS):
            return SUSPECT
    return MAIN if name in ("article", "main") else ""


def _path(above: int, name: str, attributes: str) -> int:
    """A hash of an element's place: the names and classes of the elements around it, and its own."""
    classes = " ".join(sorted((a or b or c).lower() for k, a, b, c in _ATTR.findall(attributes) if k.lower() == "class")) if attributes else ""
    return xxhash.xxh3_64_intdigest(f"{above}/{name}.{classes}".encode("utf-8", "surrogatepass")) >> 1


def read_page(source: str) -> Page:
    page = Page([], [], [], [])
    stream, parts, open_, blocks = page
    held: list[str] = []
    stack: list[tuple[str, str, int, int]] = []
    zone, path, asides, at, end = OPEN, 0, 0, 0, len(source)  # asides: elements around that are aside or suspect, forms not counted

    def flush() -> None:
        words = html.unescape("".join(held)).split()
        held.clear()
        if not words:
            return
        stream.extend(words)
        if zone == MAIN:
            parts.append((-1, " ".join(words)))
        elif zone != ASIDE:
            parts.append((len(blocks), " ".join(words)))
            blocks.append((path, zone == SUSPECT, len(open_), len(open_) + len(words)))
            open_.extend(words)

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            if name in _SPACED:
                held.append(" ")
            else:
                flush()
        token, around = f"<{m[1]}{name}", zone
        stream.append(token)
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1] != zone:
                        flush()
                    del stack[k:]
                    zone, path, asides = stack[-1][1:] if stack else (OPEN, 0, 0)
                    break
        elif name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            again = re.compile(rf"<{re.escape(name)}[\s/>]", re.I).search(source, at) if m[3].rstrip().endswith("/") else None
            if m[3].rstrip().endswith("/") and (name == "svg" or close is None or again and again.start() < close.start()):
                pass  # closed in its own tag: what follows is not its content
            elif close is None and stack:  # without an end of its own it ends with its parent
                parent = re.compile(rf"</{re.escape(stack[-1][0])}\s*>", re.I).search(source, at)
                at = parent.start() if parent else end
            else:
                at = close.end() if close else end
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            while stack and stack[-1][0] in _ENDS.get(name, ()):
                before = zone
                stack.pop()
                if (stack[-1][1] if stack else OPEN) != before:
                    flush()
                zone, path, asides = stack[-1][1:] if stack else (OPEN, 0, 0)
            kind = _kind(name, m[3], zone == MAIN)
            if kind and kind != zone and (zone != ASIDE or kind == MAIN and not asides):  # a form around the whole page hides no article
                flush()
                zone = kind
            asides += kind in (ASIDE, SUSPECT) and name != "form"
            if zone in (OPEN, SUSPECT) and name not in ("html", "body"):
                path = _path(path, name, m[3])
            stack.append((name, zone, path, asides))
        if around in (OPEN, SUSPECT) or zone in (OPEN, SUSPECT):
            open_.append(token)
    flush()
    if any(k < 0 for k, _ in parts):
        blocks[:] = [(path, True, a, b) for path, _, a, b in blocks]
    return page


def suffix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix among all by its first depth tokens (a power of two), by prefix doubling."""
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def ranked(streams: list[list[str]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the streams, which have a separator after each; and the stream of each place."""
    names: dict[str, int] = {}
    sizes = np.array([len(s) for s in streams], np.int64)
    ids, of = np.empty(int(sizes.sum()) + len(streams), np.int64), np.repeat(np.arange(len(streams)), sizes + 1)
    at = 0
    for k, s in enumerate(streams):
        ids[at : at + len(s)] = [names.setdefault(t, len(names)) for t in s]
        at += len(s)
        ids[at] = -1 - k  # no two separators are alike, so no repeat crosses pages
        at += 1
    return suffix_ranks(ids, depth), of, np.cumsum(sizes + 1) - 1


def distinct_pages(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Places in the order of their ranks, one for each page of a rank."""
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    return order[np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]))]


def spread(starts: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Which of size tokens lie in a substring of depth tokens that begins at one of starts."""
    edge = np.zeros(size + depth + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    return np.cumsum(edge)[:size] > 0


def covered_words(page: Page, cover: np.ndarray) -> list[int]:
    """How many words of each open block lie in repeats, given which tokens of the open stream do."""
    return [int(cover[a:b].sum()) for _, _, a, b in page.blocks]


def windows(tokens: list[str], depth: int) -> np.ndarray:
    """Places whose next depth tokens are all of this stream and hold a word."""
    if len(tokens) < depth:
        return np.zeros(0, np.int64)
    words = np.cumsum([0, *(not t.startswith("<") for t in tokens)])
    return np.flatnonzero(words[depth:] > words[: len(tokens) - depth + 1])


def stays(path: int, doubtful: bool, words: int, hidden: int, containers: dict, covered: float, share: float, seen: int) -> bool:
    """The decision on one open block; containers: (pages, words, covered words) of each path of the host."""
    if hidden >= covered * words:
        return False
    if not doubtful:
        return True
    pages, all_words, all_hidden = containers[path]
    return all_hidden < share * all_words and pages >= seen


def main_texts(sources: list[str], depth: int = 8, min_pages: int = 3, covered: float = 0.9, share: float = 0.1, seen: int = 128) -> list[str]:
    """The main text of each page of one host, distinct pages each: the operator's rule without its distribution."""
    pages = [read_page(s) for s in sources]
    label: dict[tuple[str, ...], int] = {}
    labels = [label.setdefault(tuple(p.stream), len(label)) for p in pages]
    rank, of, ends = ranked([p.open for p in pages], depth)
    at = np.concatenate([np.zeros(0, np.int64), *(ends[k] - len(p.open) + windows(p.open, depth) for k, p in enumerate(pages))])
    met: dict[int, set[int]] = {}
    for place in at.tolist():
        met.setdefault(int(rank[place]), set()).add(labels[of[place]])
    starts = np.array([place for place in at.tolist() if len(met[int(rank[place])]) >= min_pages], np.int64)
    cover = spread(starts, depth, len(rank))
    hidden = [covered_words(p, cover[e - len(p.open) : e]) for p, e in zip(pages, ends, strict=True)]
    containers: dict[int, list[int]] = {}
    counted = set()
    for p, own, one in zip(pages, hidden, labels, strict=True):
        if one not in counted:
            counted.add(one)
            for path in {b[0] for b in p.blocks}:
                containers.setdefault(path, [0, 0, 0])[0] += 1
            for (path, _, a, b), h in zip(p.blocks, own, strict=True):
                containers[path][1] += b - a
                containers[path][2] += h
    out = []
    for p, own in zip(pages, hidden, strict=True):
        keep = [stays(path, doubtful, b - a, h, containers, covered, share, seen) for (path, doubtful, a, b), h in zip(p.blocks, own, strict=True)]
        out.append("\n".join(t for k, t in p.parts if k < 0 or keep[k]))
    return out


def token_id(host: str, tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join([host, *tokens]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def token_hashes(stream: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each token; known holds those met before."""
    import xxhash

    for t in stream:
        if t not in known:
            known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
    return np.array([known[t] for t in stream], np.uint64)


def passage_hashes(tokens: np.ndarray, starts: np.ndarray, depth: int, host: str) -> np.ndarray:
    """A 64-bit hash of the depth tokens from each start, which differs by host."""
    import xxhash

    h = np.full(len(starts), xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")), np.uint64)
    for j in range(depth):
        h = (h ^ tokens[starts + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def grouped(batches, keys: int):
    """Lists of rows (tuples) that follow each other and agree in their first keys columns."""
    held, key = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key and held:
                yield held
                held = []
            key = row[:keys]
            held.append(row)
    if held:
        yield held


def arrow_types(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_pages(rows: DataFrame) -> DataFrame:
    """READ rows: pages as settled and open text."""
    schema = arrow_types(READ)

    def run(batches):
        for b in batches:
            out = []
            for page_id, url, host, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = read_page(source)
                parts, held = [], []
                for k, t in p.parts:  # neighbouring main blocks are one part
                    if k < 0:
                        held.append(t)
                        continue
                    if held:
                        parts.append((-1, "\n".join(held)))
                        held = []
                    parts.append((k, t))
                if held:
                    parts.append((-1, "\n".join(held)))
                out.append((page_id, url, host, token_id(host, p.open), token_id(host, p.stream), parts, p.open if p.blocks else [], p.blocks))
                if len(out) == 256:
                    yield batch_of(out, schema)
                    out = []
            if out:
                yield batch_of(out, schema)

    return rows.select("page_id", "url", "host", "html").mapInArrow(run, READ)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; structs are tuples in the order of their fields."""

    def named(value, kind):
        if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
            names = [f.name for f in kind.value_type]
            return [dict(zip(names, v, strict=True)) for v in value]
        return value

    return pa.RecordBatch.from_arrays([pa.array([named(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def passages(streams: DataFrame, depth: int, min_pages: int) -> DataFrame:
    """PASSAGES of each chunk: hashes with at most min_pages of the pages that have them; one: once for each hash."""

    def run(batches):
        for held in grouped(batches, 1):
            own = [row[3] for row in held]
            rank, _, ends = ranked(own, depth)
            places = [e - len(t) + windows(t, depth) for t, e in zip(own, ends, strict=True)]
            at = np.concatenate([np.repeat(x, len(row[4])) for x, row in zip(places, held, strict=True)])
            if not len(at):
                continue
            page = np.concatenate([np.tile(np.array(row[4], np.int64), len(x)) for x, row in zip(places, held, strict=True)])
            pick = distinct_pages(rank[at], page)
            at, page = at[pick], page[pick]
            first = np.append(True, rank[at][1:] != rank[at][:-1])
            begin = np.flatnonzero(first)
            nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            at, page, first = at[nth < min_pages], page[nth < min_pages], first[nth < min_pages]
            known: dict[str, int] = {}
            tokens = np.concatenate([np.append(token_hashes(t, known), np.uint64(0)) for t in own])
            hashes = passage_hashes(tokens, at, depth, held[0][1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(page), pa.array(np.full(len(at), held[0][0])), pa.array(first)], names=["hash", "page", "seat", "one"])

    return streams.select("seat", "host", "stream", "open", "labels").repartition("seat").sortWithinPartitions("seat", "host", "stream").mapInArrow(run, PASSAGES)


def cover(streams: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """COVERED rows: the words of each open block that lie in repeats. found: repeated hashes by seat."""
    schema = arrow_types(COVERED)

    def run(batches):
        for held in grouped(batches, 1):
            hashes = np.sort(np.array([row[2] for row in held if row[1] == 0], np.int64))
            out, known = [], {}
            for _, kind, _, host, stream, n, open_, blocks in held:
                if kind == 0:
                    continue
                starts = windows(open_, depth)
                own = passage_hashes(token_hashes(open_, known), starts, depth, host)
                hidden = spread(starts[np.isin(own, hashes)], depth, len(open_))
                met: set[int] = set()
                rows = []
                for b in blocks:
                    rows.append((b["path"], b["doubtful"], b["path"] not in met, b["b"] - b["a"], int(hidden[b["a"] : b["b"]].sum())))
                    met.add(b["path"])
                out.append((host, stream, n, rows))
            if out:
                yield batch_of(out, schema)

    none = lambda t: F.lit(None).cast(t)
    own = streams.select("seat", F.lit(1).alias("kind"), none("long").alias("hash"), "host", "stream", "n", "open", "blocks")
    marks = found.select("seat", F.lit(0).alias("kind"), "hash", *[none(own.schema[c].dataType).alias(c) for c in ("host", "stream", "n", "open", "blocks")])
    return marks.unionByName(own).repartition("seat").sortWithinPartitions("seat", "kind").mapInArrow(run, COVERED)


def open_streams(read: DataFrame, min_pages: int, chunk_bytes: int) -> DataFrame:
    """Each distinct open stream of a host, with its distinct pages (n; at most min_pages as labels) and its chunk (seat)."""
    pages = read.select("host", "page_id", "stream", "label").distinct()
    versions = pages.filter(F.col("page_id").isNotNull()).groupBy("host", "page_id").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a < z")
    edges = written(pages.join(versions, ["host", "page_id"]).select("a", F.col("label").alias("b")).filter("a < b").distinct(), "html-versions")
    own = pages.select("host", "stream", "label")
    if not edges.isEmpty():
        one = components(edges).withColumnRenamed("label", "page")
        own = own.join(one, own["label"] == one["node"], "left").select("host", "stream", F.coalesce("page", "label").alias("label"))
    counted = own.distinct().groupBy("host", "stream").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    # A stream of min_pages pages repeats by itself: names made from the two extremes stand for its other pages.
    others = F.transform(F.sequence(F.lit(0), F.lit(min_pages)), lambda k: F.xxhash64("lo", "hi", k))
    labels = F.slice(F.array_distinct(F.concat(F.array("lo", "hi"), F.when(F.col("n") > 2, others).otherwise(F.array().cast("array<long>")))), 1, F.least("n", F.lit(min_pages)).cast("int"))
    texts = read.groupBy("host", "stream").agg(F.first("open").alias("open"), F.first("blocks").alias("blocks"), F.count(F.lit(1)).alias("rows"))
    streams = written(texts.join(counted.select("host", "stream", "n", labels.alias("labels")), ["host", "stream"]), "html-streams")
    size = F.aggregate("open", F.lit(0).cast("long"), lambda z, t: z + F.length(t) + 1)
    hosts = streams.groupBy("host").agg(F.ceil(F.sum(size) / chunk_bytes).alias("chunks"), F.count(F.lit(1)).alias("streams"))
    dealt = join_by_size(streams, hosts, ["host"], "streams")
    return dealt.withColumn("seat", F.xxhash64("host", F.pmod(F.xxhash64("stream"), F.greatest("chunks", F.lit(1)))))


def extract(pages: DataFrame, chunk_bytes: int = 2_000_000, depth: int = 8, min_pages: int = 3, covered: float = 0.9, share: float = 0.1, seen: int = 128) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    read = written(read_pages(pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))), "html-read")
    waiting = read.filter(F.size("blocks") > 0)
    streams = written(open_streams(waiting, min_pages, chunk_bytes), "html-dealt")
    seen_passages = written(passages(streams, depth, min_pages), "html-passages")
    many = seen_passages.select("hash", "page").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    found = seen_passages.filter("one").select("hash", "seat").join(many.select("hash"), "hash", "left_semi")
    judged = written(cover(streams, found, depth), "html-covered")
    blocks = judged.select("host", "stream", "n", F.posexplode("blocks").alias("k", "x")).select("host", "stream", "n", "k", "x.*")
    containers = blocks.filter("doubtful").groupBy("host", "path").agg(
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("pages"), F.sum(F.col("n") * F.col("words")).alias("all_words"), F.sum(F.col("n") * F.col("covered")).alias("all_covered"), F.count(F.lit(1)).alias("size")
    )
    own = F.col("covered") < F.lit(covered) * F.col("words")
    unique = own & (F.col("all_covered") < F.lit(share) * F.col("all_words")) & (F.col("pages") >= seen)
    one = lambda stays: F.struct("k", stays.alias("stays"), "doubtful")
    by_container = join_by_size(blocks.filter("doubtful"), containers, ["host", "path"], "size").select("host", "stream", one(unique).alias("x"))
    both = by_container.unionByName(blocks.filter("not doubtful").select("host", "stream", one(own).alias("x")))
    kept = both.groupBy("host", "stream").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # Streams on which the array overrules the markup, doubtful blocks go and others stay, carry their decisions to their rows.
    ruled = kept.filter(F.exists("x", lambda x: x["stays"] == x["doubtful"])).select("host", "stream", F.transform("x", lambda x: x["stays"]).alias("stays"))
    ruled = written(ruled.join(streams.select("host", "stream", "rows"), ["host", "stream"]), "html-ruled")
    keys = ["host", "stream"]
    if ruled.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        few = F.broadcast(ruled.drop("rows"))
        decided = read.join(few, keys, "left")
    else:
        rest = read.join(ruled.select(*keys), keys, "left_anti").withColumn("stays", F.lit(None).cast("array<boolean>"))
        decided = join_by_size(read, ruled, keys, "rows").unionByName(rest)
    default = F.transform("blocks", lambda b: ~b["doubtful"])
    chosen = F.filter("parts", lambda x: (x["block"] < 0) | F.element_at(F.coalesce("stays", default), F.greatest(x["block"], F.lit(0)) + 1))
    text = F.array_join(F.transform(chosen, lambda x: x["text"]), "\n")
    return decided.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
