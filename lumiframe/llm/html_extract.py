"""Main text of web pages by nearest-URL page differencing.

Distinct pages (of equal lines on a host the first) are range-partitioned, sorted by host and URL path and ranked, so a host of any size
spreads over partitions. A page's partner is whichever neighbour by rank of the same host shares the longer path prefix; copies share
the partner of their first page. The lines of both are aligned by a longest common subsequence, and lines that the partner has too
are deleted: what a site repeats from page to page is not the article. That is done on every page.

Mark-up helps on both sides. What can't be article by name is no line at all: scripts, styles, forms, navigation, asides, footers, and blocks whose
class, id or role says advert, notice, menu, comments and the like. Lines inside an ``article`` or ``main`` element are protected: the page
itself says that they are its main text, so a copy of them on another page doesn't delete them.

Pages are read twice, first for 64-bit hashes of their lines, which are all that is shuffled and aligned, then for the text without the lines found.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import discard, materialize, partitions, table, text_batches

# Element names, and words in class, id or role.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math", "canvas", "audio", "video")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist", "optgroup"}
ANCHORS = {"article", "main"}
BOILERPLATE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "share", "social", "related", "recommended", "newsletter", "subscribe", "signup",
    "login", "comment", "comments", "disqus", "replies", "reply", "widget", "pagination", "pager", "toolbar", "copyright", "search", "skip", "complementary", "contentinfo",
}
SITE_HEAD = {"header"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _hints(attrs: str) -> set[str]:
    return {w.lower() for m in _HINT.finditer(attrs) for w in _PART.findall(m[1] or m[2] or m[3] or "")} if "=" in attrs else set()


#: Start tags that end an open paragraph, and for tags with an optional end: what ends them, and within which elements.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
_ROWS = {"table"}
_CELLS = {"tr", "table"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, _CELLS), "th": ({"td", "th"}, _CELLS),
    "tr": ({"tr"}, _ROWS), "tbody": ({"thead", "tbody", "tfoot"}, _ROWS), "thead": ({"thead", "tbody", "tfoot"}, _ROWS), "tfoot": ({"thead", "tbody", "tfoot"}, _ROWS),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
}


def _tag(m: re.Match) -> tuple[str, bool, str]:
    """(name, is an end tag, attributes); no name for what isn't a tag."""
    return (m[3] or m[6] or "").lower(), bool(m[2] or m[5]), m[4] or m[7] or ""


def ends_of(tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """For each start tag's index the index of the tag that ends the element, and whether it is that tag itself (an end tag of the element).

    Ends that HTML implies are found: by the next paragraph, item or cell, and by the end of an enclosing element. Else the page's end counts; an unclosed
    element that holds an ``article`` or ``main`` ends where that begins."""
    out: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    inner: dict[int, int] = {}  # first article or main inside an open element

    def pop(at: int, own: bool) -> None:
        name, k = stack.pop()
        count[name] -= 1
        first = inner.pop(k, None)
        out[k] = (at, True) if own else (at if first is None or name in ANCHORS else first, False)
        if first is not None and stack:
            inner.setdefault(stack[-1][1], first)

    for k, m in enumerate(tokens):
        name, ending, attrs = _tag(m)
        if not name or name in VOID and name != "hr":
            continue
        if ending:
            if count.get(name):
                while stack[-1][0] != name:
                    pop(k, False)
                pop(k, True)
            continue
        if name in ENDS_P and count.get("p"):
            j = len(stack) - 1
            while stack[j][0] in INLINE and j:
                j -= 1
            if stack[j][0] == "p":
                while len(stack) > j:
                    pop(k, False)
        same, within = IMPLIED.get(name, ((), ()))
        if any(count.get(x) for x in same):
            j = len(stack) - 1
            while j >= 0 and stack[j][0] not in same and stack[j][0] not in within:
                j -= 1
            if j >= 0 and stack[j][0] in same:
                while len(stack) > j:
                    pop(k, False)
        if name in ANCHORS and stack:
            inner.setdefault(stack[-1][1], k)
        if name not in VOID and not attrs.endswith("/"):
            stack.append((name, k))
            count[name] = count.get(name, 0) + 1
    while stack:
        pop(len(tokens), False)
    return out


def lines_of(page: str | None) -> tuple[list[str], list[bool]]:
    """The text lines of a page that mark-up doesn't rule out, in page order, and whether each is anchored."""
    lines: list[str] = []
    anchored: list[bool] = []
    now: list[str] = []
    anchor, at, out_to, out_own = 0, 0, -1, False  # left out up to the tag out_to, which may be the element's own end tag
    page = page or ""
    tokens = list(_TOKEN.finditer(page))
    ends = ends_of(tokens)

    def close() -> None:
        if now:
            raw = "".join(now)
            now.clear()
            if t := " ".join((_html.unescape(raw) if "&" in raw else raw).split()):
                lines.append(t)
                anchored.append(anchor > 0)

    for k, m in enumerate(tokens):
        if k > out_to and m.start() > at:
            now.append(page[at : m.start()])
        at = m.end()
        if k < out_to or k == out_to and out_own:
            continue
        name, ending, attrs = _tag(m)
        if not name:
            continue
        if name in INLINE and (ending or not attrs):
            continue
        if not ending and name not in VOID and name not in ("html", "body"):
            words = _hints(attrs)
            if name in LEFT_OUT or words & BOILERPLATE and not (name in ANCHORS or "article" in words) or not anchor and (name in SITE_HEAD or words & SITE_HEAD):
                close()
                if k in ends:
                    out_to, out_own = ends[k]
                continue
        if name in INLINE:
            continue
        close()
        if name in ANCHORS:
            anchor = max(0, anchor + (-1 if ending else 1))
    if len(tokens) > out_to and at < len(page):
        now.append(page[at:])
    close()
    return lines, anchored


def _lcs_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last row of the longest-common-subsequence table of a and b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def lcs_mask(a: list, b: list) -> np.ndarray:
    """Which elements of ``a`` are in one longest common subsequence with ``b``. Linear memory: the table is halved, not kept."""
    both = set(a) & set(b)
    code = {x: k for k, x in enumerate(sorted(both))}
    ia = [k for k, x in enumerate(a) if x in both]
    x, y = np.array([code[a[k]] for k in ia], np.int64), np.array([code[v] for v in b if v in both], np.int64)
    mask = np.zeros(len(a), bool)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and x[p] == y[r]:
            mask[ia[p]] = True
            p, r = p + 1, r + 1
        while p < q and r < s and x[q - 1] == y[s - 1]:
            mask[ia[q - 1]] = True
            q, s = q - 1, s - 1
        if p == q or r == s:
            continue
        if q - p == 1:
            mask[ia[p]] = bool((y[r:s] == x[p]).any())
            continue
        mid = (p + q) // 2
        cut = int(np.argmax(_lcs_rows(x[p:mid], y[r:s]) + _lcs_rows(x[mid:q][::-1], y[r:s][::-1])[::-1]))
        todo += [(p, mid, r, r + cut), (mid, q, r + cut, s)]
    return mask


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_lines(path: str, lines: list, partners: list[tuple[str, list]]) -> list[int]:
    """The numbers of the lines that the partner has too, which is the (path, lines) of the longest common path prefix, ties to the first; none without partners."""
    best = max(((_prefix(path, p), -k) for k, (p, _) in enumerate(partners)), default=None)
    return [] if best is None else np.flatnonzero(lcs_mask(lines, partners[-best[1]][1])).tolist()


def text_of(page: str | None, gone: list[int] | None) -> str:
    """The page's text: its lines but those ``gone``, unless they are protected."""
    lines, anchored = lines_of(page)
    if gone:
        drop = {k for k in gone if not anchored[k]}
        lines = [t for k, t in enumerate(lines) if k not in drop]
    return " ".join(lines)


_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    A null page is empty and gives an empty text; a null or odd URL is a host of its own kind (''), with no path; copies of a page
    don't count as partners; a page without a partner keeps all its lines; repeated rows each get a row; an empty table gives no rows; other
    columns are ignored."""
    part = lambda k: F.lower(F.coalesce(F.regexp_extract(url, _URL, k), F.lit("")))
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), part(1).alias("host"), F.xxhash64(F.coalesce(F.col(page), F.lit(""))).alias("same"))
    kinds = pages.schema[page_id].dataType.simpleString()

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in text_batches(it, "html"):
            got = [[t.encode("utf-8", "surrogatepass") for t in lines_of(h)[0]] for h in b.column(2).to_pylist()]
            marks = [sha256(b"\n".join(x)).hexdigest() for x in got]  # a line holds no line end
            hashes = [np.array([xxh64_intdigest(t) for t in x], np.uint64).view(np.int64) for x in got]
            cols = [b.column(0), *b.columns[3:], pa.array(marks), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "same", "path", "mark", "lines"])

    sketch = materialize(src.withColumn("path", part(2)).mapInArrow(read, f"page_id {kinds}, host string, same long, path string, mark string, lines array<long>"), "lines")
    gone = differenced(sketch).filter(F.size("gone") > 0)
    gone = materialize(sketch.select("host", "same", "mark").distinct().join(gone, ["host", "mark"]).groupBy("host", "same").agg(F.first("gone").alias("gone")), "gone")
    discard(sketch)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "html"):
            out = pa.array([text_of(h, g) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], out, pc.cast(pc.utf8_length(out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    met = src.join(gone.select(F.col("host").alias("h"), F.col("same").alias("s"), "gone"), (F.col("host") == F.col("h")) & (F.col("same") == F.col("s")), "left")
    return met.select("page_id", "url", "html", "gone").mapInArrow(write, f"page_id {kinds}, url string, text string, n_chars long")


def differenced(sketch: DataFrame) -> DataFrame:
    """(host, mark, gone): the lines that each distinct page, copies counted once, shares with its nearest distinct page before or after in the order of host, path and page_id.

    Pages are ranked by range partitions and their sizes, and meet their neighbours by rank: neither copies nor the edges of partitions come between them."""
    place = F.struct("path", "page_id")
    first = sketch.groupBy("host", "mark").agg(F.min(place).alias("p"), F.min_by("lines", place).alias("lines"))
    first = first.select("host", "mark", F.col("p.path").alias("path"), F.col("p.page_id").alias("page_id"), "lines")
    order = ["host", "path", "page_id", "mark"]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in it:
            yield b.append_column("k", pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    cut = first.repartitionByRange(partitions(sketch.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    cut = materialize(cut.mapInArrow(count, T.StructType([*cut.schema.fields, T.StructField("k", T.LongType())])), "ranked")
    sizes = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    ranked = cut.select("host", "mark", "path", "lines", (F.element_at(F.lit(starts), F.col("part") + 1) + F.col("k")).alias("rank"))
    side = lambda name, step: ranked.select((F.col("rank") + step).alias("rank"), F.struct("host", "path", "lines").alias(name))
    met = ranked.join(side("before", 1), "rank", "left").join(side("after", -1), "rank", "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c in range(0, b.num_rows, 64):
                rows = b.slice(c, 64).to_pylist()
                out = [shared_lines(r["path"], r["lines"], [(q["path"], q["lines"]) for q in (r["before"], r["after"]) if q and q["host"] == r["host"]]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], pa.string()) for x in ("host", "mark")] + [pa.array(out, pa.list_(pa.int32()))], names=["host", "mark", "gone"])

    return met.select("host", "mark", "path", "lines", "before", "after").mapInArrow(run, "host string, mark string, gone array<int>")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
