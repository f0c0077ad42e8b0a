r"""HTML extraction by nearest-URL page differencing.

A page is cut into text lines (one for each block element). Pages are ordered by URL path within
their host; each is aligned with the nearest page before and after it by longest common
subsequence of lines, and the lines they share are deleted as template. A neighbour that shares
more than half of the page's characters is a copy, not a template: the next one is tried, up to
NEAR pages on each side. Lines inside an article or main element are the text itself and stay,
shared or not (passages recur across articles); only links standing alone there can be deleted.

What differencing cannot see (a menu or advert no neighbour repeats) is told by markup: on a page
that marks its article, lines outside it go; on a page that does not, elements, roles, classes
and ids that name menus, headers, footers, sidebars, notices, adverts, forms or comments go.
`lists=False` leaves that step out: what is left then rests on differencing and article marks alone.

Equal pages of one host are aligned once, at their least path, so equal html gives equal text.
The order is a range partitioning by (host, path), cut into blocks of BLOCK pages that overlap by
NEAR, so a host of any size spreads over many tasks and the result does not depend on
partitions. Only line hashes travel.

A null html or one without text gives the empty text. A null or unparsable URL is the host ""
and its own path. Repeated rows give equal results. Very long pages are aligned in memory that
grows with their lines, not with the square. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select|math)\b[^>]*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z))"""
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)[^>]*+>?""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_BOILER_TAGS = frozenset("nav footer aside form button dialog menu head label".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Words of class and id attributes that mark what is not the article.
_BOILER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead"
    " menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related replies reply share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar topbar widget".split()
)
_MAIN_ROLES = frozenset(("main", "article"))
_SPACE = re.compile(r"[\s\x1c-\x1f]+")

BOILER, DOUBTFUL, MAIN = 0, 1, 2
#: Pages looked at on each side, and pages of a block.
NEAR, BLOCK = 4, 128
#: Cells of an alignment table that is held whole; larger ones are halved first.
CELLS = 1 << 21


def _marks(name: str, attrs: str) -> tuple[bool, bool]:
    """(is boiler, is main) of an element."""
    boiler, main = name in _BOILER_TAGS, name in ("article", "main")
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            boiler |= value in _BOILER_ROLES
            main |= value in _MAIN_ROLES
        elif key == "hidden":
            boiler = True
        elif key == "aria-hidden":
            boiler |= value == "true"
        elif key == "style":
            boiler |= "display:none" in value.replace(" ", "")
        elif not main and name not in ("html", "body"):
            for one in value.split():  # "has-sidebar" and the like mark what stands beside one
                if not one.startswith(("has-", "with-", "no-")):
                    boiler |= not _BOILER_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", one))
    return boiler, main


def lines_of(page: str | None, lists: bool = True) -> list[tuple[int, str]]:
    """(class, text) of every text line of a page, in page order; without `lists` no line is boiler."""
    page = page or ""
    out: list[list] = []  # [boiler, in main, text, all of it in links]
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # name, boiler, main, link
    parts: list[str] = []
    plain = linked = False

    def text(raw: str) -> None:
        nonlocal plain, linked
        if raw:
            parts.append(raw)
            if not raw.isspace():
                linked |= stack[-1][3]
                plain |= not stack[-1][3]

    def flush() -> None:
        nonlocal plain, linked
        if parts:
            line = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if line:
                out.append([stack[-1][1], stack[-1][2], line, linked and not plain])
            parts.clear()
        plain = linked = False

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in _BLOCK and stack[k][0] in _BLOCK and stack[k][0] != "p":
                    break  # an inline end tag does not close a block
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        elif name in ("td", "th", "tr"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "table" or name != "tr" and stack[k][0] == "tr":
                    break
                if stack[k][0] in ("td", "th") or stack[k][0] == name:
                    del stack[k:]
                    break
        if name in ("li", "dd", "dt"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ("ul", "ol", "dl"):
                    break
                if stack[k][0] in ("li", "dd", "dt"):
                    del stack[k:]
                    break
        if name in _VOID:
            continue
        _, boiler, main, link = stack[-1]
        own_boiler, own_main = _marks(name, m["attrs"] or "")
        if name == "header":
            own_boiler |= not main  # an article's own header holds its title
        elif name == "main":
            boiler = False  # whatever its wrappers are called
        own_boiler &= lists
        stack.append((name, boiler or own_boiler, main or own_main and not boiler, link or name == "a"))
    text(page[at:])
    flush()
    marked = any(main and not boiler for boiler, main, *_ in out)
    kinds = []
    for boiler, main, line, links in out:
        kind = BOILER if boiler or lists and marked and not main else MAIN if main and not links else DOUBTFUL
        kinds.append((kind, line))
    return kinds


def place_of(url: str | None) -> tuple[str, str]:
    """Host (lower case) and the rest of a URL that orders pages within it."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and every prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)), out=row[1:])
    return row


def _aligned(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence, from a whole table."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    equal = x[:, None] == y[None, :]
    for i in range(len(x) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(equal[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if equal[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_subsequence(a: list[int], b: list[int], cells: int = CELLS) -> set[int]:
    """Places in a of a longest common subsequence of a and b; a large table is halved (Hirschberg 1975), so memory is linear."""
    place, values, others = np.arange(len(a)), np.asarray(a, np.int64), np.asarray(b, np.int64)
    out: set[int] = set()
    todo = [(place, values, others)]
    while todo:
        place, x, y = todo.pop()
        keep = np.isin(x, y)
        place, x, y = place[keep], x[keep], y[np.isin(y, x[keep])]
        if not len(x):
            continue
        if len(x) == 1 or (len(x) + 1) * (len(y) + 1) <= cells:
            out.update(place[_aligned(x, y)].tolist())
            continue
        mid = len(x) // 2
        cut = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
        todo += [(place[:mid], x[:mid], y[:cut]), (place[mid:], x[mid:], y[cut:])]
    return out


def shared_lines(lines: list[int], sizes: list[int], other: list[int]) -> set[int] | None:
    """Places of a page's lines that its neighbour has too, in order; None if the neighbour is a copy of the page."""
    if lines == other:
        return None
    shared = common_subsequence(lines, other)
    return None if 2 * sum(abs(sizes[i]) for i in shared) > sum(map(abs, sizes)) else shared


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def page_key(host: str, page: str | None) -> str:
    """A 128-bit hash of what a page's alignment depends on, its URL's path apart."""
    return xxhash.xxh3_128_hexdigest(f"{len(host)}:{host}{page or ''}")


def outlines(pages: DataFrame, lists: bool = True) -> DataFrame:
    """host, path, page (its key), the hashes of its lines and their sizes, negative for lines that stay."""
    types = [pa.string()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["host", "path", "page", "lines", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                page = page.as_py()
                host, path = place_of(url)
                lines = lines_of(page, lists)
                rows.append((host, path, page_key(host, page), [_hash(t) for _, t in lines], [-len(t) if kind == MAIN else len(t) for kind, t in lines]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pages.select("url", "html").mapInArrow(run, "host string, path string, page string, lines array<long>, sizes array<int>")


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order of (host, path, page), from 0, over all partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "page"]
    held = saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "page-outlines")
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for k, n in sizes:
        before.append((k, total - (k << 33)))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part long, shift long")
    return held.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("place", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def deletions(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page (its key) and the places of its lines to delete, for the pages that have any."""
    rows = outlines(pages, lists).groupBy("host", "page").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"))
    block = lambda shift: F.floor((F.col("place") + shift) / BLOCK)
    dealt = ranked(rows).withColumn("block", F.explode(F.array_distinct(F.array(block(-NEAR), block(0), block(NEAR)))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        keys, gone = [], []
        for i, row in enumerate(rows):
            if row["place"] // BLOCK != key[0].as_py():
                continue
            found: set[int] = set()
            for side in (-1, 1):
                for k in range(1, NEAR + 1):
                    j = i + side * k
                    if not 0 <= j < len(rows) or rows[j]["host"] != row["host"]:
                        break
                    shared = shared_lines(row["lines"], row["sizes"], rows[j]["lines"])
                    if shared is not None:
                        found |= shared
                        break
            found = {i for i in found if row["sizes"][i] > 0}
            if found:
                keys.append(row["page"])
                gone.append(sorted(found))
        return pa.table({"page": pa.array(keys, pa.string()), "gone": pa.array(gone, pa.list_(pa.int32()))})

    return dealt.groupBy("block").applyInArrow(run, "page string, gone array<int>")


def extract(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, text and n_template (long, lines that differencing deleted) of every row."""
    gone = saved(deletions(pages, lists), "page-deletions")
    # the written table's size is known, so a small one is broadcast and a large one is merge-joined
    keyed = with_keys(pages).join(gone, "page", "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page, places in zip(batch.column("html"), batch.column("gone").to_pylist(), strict=True):
                drop = set(places or ())
                texts.append("\n\n".join(line for i, (kind, line) in enumerate(lines_of(page.as_py(), lists)) if kind != BOILER and i not in drop))
                counts.append(len(drop))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_template"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"page_id {kind}, url string, text string, n_template long")


def with_keys(pages: DataFrame) -> DataFrame:
    """page_id, url, html and page, the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [page_key(place_of(u)[0], h.as_py()) for u, h in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "page"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, html string, page string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
