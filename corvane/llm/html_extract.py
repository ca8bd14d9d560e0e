"""Main text of HTML pages: structure of each page, and a suffix array of each host for what its pages repeat."""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, small, texts
from corvane.llm.url_filter import host_of

#: Pages of a host that one suffix array holds; larger hosts have several, whose counts are added up.
SHARD_PAGES = 128
#: A repeated substring has this many tokens or more, block ends included.
MIN_TOKENS = 8
#: Pages whose sets of SHINGLE tokens in a row have that Jaccard similarity or more, and what such pairs join, count as one page.
SHINGLE, SAME_PAGE = 5, 0.8
#: Columns of the page matrix that are multiplied at once.
COLUMNS = 8192
#: Text goes where that many of a host's distinct pages, and over that share of them, repeat it: more of what a page marks as its article.
LEAST_PAGES = 3
MARKED_SHARE, UNMARKED_SHARE = 0.6, 0.2

# Elements by what their content is.
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video map select option datalist textarea button title".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An element that opens ends these open ones.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {
    t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()
}
#: Elements within which ENDS looks, so that a list in a list item doesn't end it.
SCOPES = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id names that tell furniture, and those that tell readers' comments.
NAMES = frozenset(
    """nav navbar navigation menu submenu sidebar sidenav header masthead banner footer foot ad ads adv advert adverts advertisement advertising adsense sponsor
    sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social
    breadcrumb breadcrumbs pagination pager related recommended recommendations toolbar widget widgets skip copyright legal disclaimer""".split()
)
HEADERS = frozenset(["header", "masthead"])
#: Names that tell no furniture within an article, and the elements whose names tell some there: an article's paragraphs, headings and lists are its own.
OWN_NAMES = HEADERS | frozenset("legal copyright disclaimer related alert skip".split())
CONTAINERS = frozenset("div section span a figure details".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: HEADED is furniture by the name of a header alone.
FURNITURE_ZONE, HEADED, OPEN, MAIN, ARTICLE = -1, 0, 1, 2, 3
MARKED = re.compile(r"<(?:article|main)\b|\brole\s*=\s*[\"']?(?:article|main)\b", re.I)


def zone_of(tag: str, attributes: str, zone: int, closed: bool) -> tuple[int, bool]:
    """The zone inside an element, and whether an article or main element within may not open it again."""
    named: dict[str, str] = {}
    if attributes and "=" in attributes or " hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            named.setdefault(name.lower(), "".join(values))
    words = {w.lower() for w in WORD.findall(named.get("class", "") + " " + named.get("id", ""))}
    role = named.get("role", "").lower()
    if closed or tag in FURNITURE or words & COMMENT_NAMES and tag not in ("html", "body", "main"):
        return FURNITURE_ZONE, True
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return FURNITURE_ZONE, True
    if tag == "article" or role == "article":
        return ARTICLE, False
    if tag == "main" or role == "main":
        return max(zone, MAIN), False
    if tag in ("html", "body"):
        return zone, False
    if role in ROLES:
        return FURNITURE_ZONE, True
    if zone == ARTICLE:
        # A header within an article has its title.
        return (FURNITURE_ZONE, False) if tag in CONTAINERS and words & (NAMES - OWN_NAMES) else (zone, False)
    if words & (NAMES - HEADERS) or tag == "header":
        return FURNITURE_ZONE, False
    return (min(zone, HEADED) if words & HEADERS else zone), False


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: character references decoded, white space made one space, empty ones left out."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    # Of each open element: its name, zone, whether that is closed, and whether its content is skipped.
    stack: list[tuple[str, int, bool, bool]] = []
    zone, closed, skipped, at = OPEN, False, False, 0
    #: How many elements of a name are open, so that an end tag without one costs nothing.
    still: Counter[str] = Counter()

    def end_elements(k: int) -> None:
        nonlocal zone, closed, skipped
        still.subtract(e[0] for e in stack[k:])
        del stack[k:]
        _, zone, closed, skipped = stack[-1] if stack else ("", OPEN, False, False)

    def end_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((zone, text))
            held.clear()

    size = len(html)
    while at < size:
        m = TAG.search(html, at)
        stop = m.start() if m else size
        if stop > at and not skipped:
            text = html[at:stop]
            held.append(html_entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag not in INLINE:
            end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if still[tag] else ():
                if stack[k][0] == tag:
                    if any(s[1] != zone for s in stack[k:]) or (stack[k - 1][1] if k else OPEN) != zone:
                        end_block()
                    end_elements(k)
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            # Up to its own end tag, or the page's end, nothing is markup.
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else size
            continue
        for other in ENDS.get(tag, ()):
            for k in range(len(stack) - 1, -1, -1) if still[other] else ():
                if stack[k][0] == other:
                    end_elements(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if (m[3] or "").endswith("/") and tag in INLINE:
            continue
        inner, shut = zone_of(tag, m[3] or "", zone, closed)
        if inner != zone:
            end_block()
        zone, closed, skipped = inner, shut, skipped or tag in SKIPPED
        stack.append((tag, zone, closed, skipped))
        still[tag] += 1
    end_block()
    return out


def main_blocks(html: str) -> tuple[int, list[str]]:
    """The zone that holds a page's main text, and its blocks: its articles, else its main element, else all but the furniture.

    What is furniture by a header's name alone counts only on a page that has
    nothing else and marks neither article nor main element.
    """
    found = blocks_of(html)
    best = max((z for z, _ in found), default=OPEN)
    if best == HEADED and not MARKED.search(html):
        return OPEN, [t for z, t in found if z == HEADED]
    best = max(best, OPEN)
    return best, [t for z, t in found if z == best]


def block_hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode()), "big", signed=True)


def same_pages(pages: list[str]) -> np.ndarray:
    """A number for each page's text, which equal and near-equal pages share."""
    number: dict[str, int] = {}
    text = [number.setdefault(p, len(number)) for p in pages]
    pages = list(number)
    words = pc.split_pattern(pa.array([p.replace("\n", " ") for p in pages]), " ")
    ends = words.offsets.to_numpy().astype(np.int64)
    token = words.values.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1)
    key = np.zeros(len(token), np.uint64)
    stop = np.repeat(ends[1:], np.diff(ends))
    for k in range(SHINGLE):
        # A page with fewer tokens than a shingle is one; none goes beyond its page.
        at = np.arange(len(token)) + k
        own = np.where(at < stop, token[np.minimum(at, len(token) - 1)], np.uint64(0))
        key = (key ^ own) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.arange(len(token)) - np.repeat(ends[:-1], np.diff(ends))
    whole = (place == 0) | (np.arange(len(token)) + SHINGLE <= stop)
    page = np.repeat(np.arange(len(pages)), np.diff(ends))[whole]
    _, column = np.unique(key[whole], return_inverse=True)
    cells = np.unique(column.astype(np.int64) * len(pages) + page)
    column, page = cells // len(pages), cells % len(pages)
    size = np.bincount(page, minlength=len(pages))
    shared = np.bincount(column)[column] > 1
    column, page = np.unique(column[shared], return_inverse=True)[1], page[shared]
    both = np.zeros((len(pages), len(pages)))
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        held = np.zeros((len(pages), COLUMNS), np.float32)
        held[page[here], column[here] - first] = 1
        both += held @ held.T
    near = both >= SAME_PAGE * (size[:, None] + size - both) - 1e-9
    np.fill_diagonal(near, True)
    # The least page that is reached stands for all.
    least = np.arange(len(pages))
    while (now := np.where(near, least, len(pages)).min(axis=1)).tolist() != least.tolist():
        least = now
    return least[text]


def repeated_blocks(pages: list[list[str]], same: np.ndarray | None = None) -> dict[int, int]:
    """Block hash to the number of pages on which a block is covered by substrings that distinct pages repeat.

    Pages of one number in same count as one page.

    The pages' token streams stand in a row, with a mark at each block's end and
    a mark of its own at each page's, and their suffixes are sorted by their
    first MIN_TOKENS tokens or more, by prefix doubling. Suffixes that share
    those stand together; where they come from two pages or more, their tokens
    are covered.
    """
    if same is None:
        same = np.arange(len(pages))
    pages, same = [pages[i] for i in np.argsort(same, kind="stable")], np.sort(same)
    blocks = [b for p in pages for b in p]
    if len(pages) < 2 or not blocks:
        return {}
    words = pc.split_pattern(pa.array([b + " \n" for b in blocks]), " ")
    ends = words.offsets.to_numpy().astype(np.int64)
    token = words.values.dictionary_encode().indices.to_numpy().astype(np.int64)
    page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    page = np.repeat(page_of_block, np.diff(ends))
    n = len(token)
    last = np.concatenate((np.flatnonzero(np.diff(page)), [n - 1]))
    token[last] = token.max() + 1 + np.arange(len(last))
    rank, depth = token, 1
    while depth < MIN_TOKENS:
        after = np.concatenate((rank[depth:] + 1, np.zeros(min(depth, n), np.int64)))[:n]
        key = rank * (int(rank.max()) + 3) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, depth = new, 2 * depth
    order = np.argsort(rank, kind="stable")  # the suffix array, to that depth
    sorted_rank, sorted_page = rank[order], same[page[order]]
    # Positions are in order within a rank, so pages are too.
    fresh = np.concatenate(([True], (np.diff(sorted_rank) != 0) | (np.diff(sorted_page) != 0)))
    group = np.concatenate(([0], np.cumsum(np.diff(sorted_rank) != 0)))
    many = np.bincount(group, fresh)[group] >= 2
    start = order[many]
    cover = np.zeros(n + depth + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + depth, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:n] > 0)))
    # The end mark of a block need not be covered.
    whole = covered[ends[1:] - 1] - covered[ends[:-1]] == ends[1:] - 1 - ends[:-1]
    out: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    for k in np.flatnonzero(whole).tolist():
        at = (int(same[page_of_block[k]]), block_hash(blocks[k]))
        if at not in seen:
            seen.add(at)
            out[at[1]] = out.get(at[1], 0) + 1
    return out


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, zone, hashes): blocks of pages(page_id, url, html, host, n_pages) that too many of a host's pages repeat."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_blocks(h) for h in texts(b.column(2))]
            columns = [b.column(0), b.column(1), pa.array([z for z, _ in found], pa.int32()), pa.array(["\n".join(t) for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "shard", "zone", "text"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def count() -> pa.RecordBatch:
            same = same_pages(held)
            found: dict[int | None, int] = dict(repeated_blocks([t.split("\n") for t in held], same))
            if key[2]:
                # What one shard has once may be repeated in another; blocks that are shorter than a substring need their surroundings repeated too.
                for t in held:
                    for h in {block_hash(b) for b in t.split("\n") if b.count(" ") >= MIN_TOKENS - 1}:
                        found.setdefault(h, 1)
            # Without a block: how many distinct pages there are.
            found[None] = len(np.unique(same))
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(found), pa.string()), pa.array([key[1]] * len(found), pa.int32()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["host", "zone", "hash", "n"]
            )

        for b in batches:
            for host, shard, zone, many, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key and key != (host, zone, many, shard):
                    yield count()
                    held.clear()
                key = (host, zone, many, shard)
                held.append(text)
        if held:
            yield count()

    shards = F.ceil(F.col("n_pages") / SHARD_PAGES)
    shard = F.pmod(F.xxhash64("page_id", "url"), shards).alias("shard")
    # A host with fewer pages than may repeat a block has none to lose.
    rows = pages.where((F.col("n_pages") >= LEAST_PAGES) & (F.col("html") != "")).select("host", shard, "html", "n_pages")
    parsed = rows.select("host", "shard", "html").mapInArrow(streams, "host string, shard long, zone int, text string").where("text <> ''")
    counts = pages.select("host", "n_pages").where(shards > 1).distinct().select(F.col("host").alias("h"))
    parsed = parsed.join(small(cut(counts)), F.col("host") == F.col("h"), "left").select("host", "shard", "zone", F.col("h").isNotNull().alias("many"), "text")
    grouped = parsed.repartition("host", "shard", "zone").sortWithinPartitions("host", "shard", "zone")
    found = cut(grouped.mapInArrow(arrays, "host string, zone int, hash long, n long").groupBy("host", "zone", "hash").agg(F.sum("n").alias("n")))
    totals = found.where("hash is null").groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("n_distinct"))
    least = F.greatest(F.lit(LEAST_PAGES), F.col("n_distinct") * F.when(F.col("zone") > OPEN, MARKED_SHARE).otherwise(UNMARKED_SHARE))
    often = found.where((F.col("n") >= LEAST_PAGES) & F.col("hash").isNotNull()).join(totals, F.col("host") == F.col("h")).where(F.col("n") >= least)
    return often.groupBy("host").agg(F.collect_list(F.struct("zone", "hash")).alias("boilerplate")).withColumnRenamed("host", "h")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars, n_removed) for each row of pages.

    Structure comes first: of a page's articles, else its main element, else all
    of it, what menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments and hidden elements hold is left out. Then blocks
    go that a host's suffix arrays find repeated across so many of its pages
    that they are boilerplate; far more pages must repeat what a page itself
    marks as its article, as quoted passages belong to it. Copies and near
    copies count as one page. A page
    never loses all its blocks that way. n_removed counts those it loses.

    A null html is empty and gives no text; pages without a host share one;
    repeated rows are extracted alike.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    totals = cut(rows.groupBy("host").agg(F.count("*").alias("n_pages")).select(F.col("host").alias("h"), "n_pages"))
    known = rows.join(small(totals), F.col("host") == F.col("h")).drop("h")
    found = cut(boilerplate(known))
    lists = "array<struct<zone:int,hash:bigint>>"
    if found.take(1):
        rows = rows.join(small(found), F.col("host") == F.col("h"), "left").drop("h")
    else:
        rows = rows.withColumn("boilerplate", F.lit(None).cast(lists))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, removed = [], []
            for page, listed in zip(texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                zone, blocks = main_blocks(page)
                if listed:
                    gone = {x["hash"] for x in listed if x["zone"] == zone}
                    kept = [t for t in blocks if block_hash(t) not in gone] or blocks
                else:
                    kept = blocks
                out.append("\n".join(kept))
                removed.append(len(blocks) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64()), pa.array(removed, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_removed"])

    return rows.select("page_id", "url", "html", "boilerplate").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, n_removed int")
