"""HTML extraction by nearest-URL page differencing (operator 1).

Pages of a host are put in the order of their URL paths; the neighbour in that
order with the longer common path is a page's nearest page. A page is cut into
text lines (blocks), its lines are aligned with those of its nearest page by
longest common subsequence, and lines that both pages share are deleted: menus,
notices and footers repeat from page to page, articles do not. If the nearest
page is a copy (it shares nine of ten characters), the other neighbour is taken;
a page between two copies is not differenced.

Structure weighs in. Scripts, styles, forms, navigation, headers and footers
outside the article, sidebars, and blocks whose class, id or role says advert,
comment, menu, cookie notice and the like never yield lines. Where a page marks
articles (article, main, role=main), a marked article of which any line is
unshared is whole, shared lines too, as it may quote a licence; one that is
shared throughout is deleted. Lines outside marked articles stay only if they
are unshared and together longer than the marked ones (the mark is a teaser). In
pages without marks, one or two shared lines between unshared ones stay.

Order and neighbours come from a range-partitioned sort of the URL keys alone and
two joins on positions; a host with a third of all pages is spread over ranges.
Only hashes of lines move to the neighbours, and only the decisions that delete
lines move back to the texts.

Defined cases: null or empty html gives an empty text; a null url stands in a
host of its own; a host with one page is not differenced; repeated rows and ties
are told apart by a row number within equal keys; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import table, through_table

#: Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav aside form menu head svg button select object audio video canvas dialog datalist fieldset".split())
OUTER = frozenset(["header", "footer"])
CLOSES_P = BLOCK - frozenset(["html", "body", "head", "option"])

#: Words of class and id that name what is no article, at the end of a name or among none but WEAK and NEUTRAL words and numbers.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe comment comments disqus respond replies sidebar navbar navigation breadcrumb breadcrumbs pagination masthead popup modal".split())
#: Words that do so only in names of which every word is one of these or of PLACES.
WEAK = frozenset("promo banner notice overlay aside widget widgets menu nav pager footer header related recommended share sharing social toolbar login signup side skip".split())
PLACES = frozenset("site page global top bottom left right box bar block area wrap wrapper container section list item items links link buttons button unit slot main primary secondary".split())
NEUTRAL = PLACES | frozenset("content form body thread text title inner outer author date meta count post entry row column col grid small large".split())
REPLY = frozenset("comment comments reply replies".split())
LAYOUT = re.compile(r"(?:^|[-_])(?:has|with|without|no|not|is)[-_]|[-_](?:wrap|wrapper|layout|container|page|theme|template)$")
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A comment, a declaration, or a tag with its attributes: quotes only count where a value begins, and an unquoted one ends at white space.
TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)
    |<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]|[^\s/>=][^\s/>=]*+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?|=)*+)(?:>|$)""",
    re.DOTALL | re.VERBOSE,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?(?=[\s/>]|$)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def noisy_name(name: str) -> bool:
    """Whether the words of a name say so: ``post-comments`` and ``ad-slot-2`` do, ``ad-hoc`` and ``comments-policy`` do not."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    known = all(w in STRONG or w in WEAK or w in NEUTRAL for w in words)
    strong = any(w in STRONG for w in words) and (known or words[-1] in STRONG)
    return strong or any(w in WEAK for w in words) and all(w in WEAK or w in PLACES for w in words)


def is_noise(attrs: str, article: bool = False) -> bool:
    """Whether class, id, role or hidden rule an element out; an article only as a reader's comment or if hidden."""
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if any(x in REPLY if article else noisy_name(x) for x in value.split() if not LAYOUT.search(x)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and not article and value in NOISE_ROLE:
            return True
    return False


def text_lines(html: str | None) -> list[tuple[int, str]]:
    """(number of the marked article or 0, text) of each block that structure does not rule out, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # element, ruled out, number of the outermost marked article
    buffer: list[str] = []
    off, inside, articles = False, 0, 0
    open_: dict[str, int] = {}  # how many elements of each name the stack holds

    def cut(depth: int) -> None:
        """Close the elements from a depth on."""
        nonlocal off, inside
        for x in stack[depth:]:
            open_[x[0]] -= 1
        del stack[depth:]
        off, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        if buffer:
            line = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if line:
                out.append((inside, line))
            buffer.clear()

    at, html = 0, html or ""
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at and not off:
            buffer.append(html[at:lt])
        m = TAG.match(html, lt) if lt < len(html) else None
        if m is None:
            if lt < len(html) and not off:
                buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.IGNORECASE).search(html, at)
            gt = html.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else len(html)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in BLOCK:  # elements inside a line leave it whole
            flush()
        if closing:
            if open_.get(name):
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name not in VOID:
            if name in CLOSES_P and "p" in (x[0] for x in stack[-4:]):
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            attrs = m[3] or ""
            marked = name in ("article", "main") or "role" in attrs and re.search(r"""role\s*=\s*["']?(main|article)\b""", attrs) is not None
            body = name in ("html", "body")
            off = off or name in NEVER or name in OUTER and not (inside and name == "header") or not body and is_noise(attrs, marked)
            if marked and not off and not inside:
                articles += 1
                inside = articles
            if not attrs.rstrip().endswith("/") or name in BLOCK:
                stack.append((name, off, inside))
                open_[name] = open_.get(name, 0) + 1
            else:
                off, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
    flush()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Positions in a of a longest common subsequence with b (bit-parallel rows; only lines of both count, equal ends are matched first)."""
    both = {*a} & {*b}
    where_a = [k for k, x in enumerate(a) if x in both]
    return {where_a[k] for k in aligned([a[k] for k in where_a], [x for x in b if x in both])}


def aligned(a: list, b: list) -> set[int]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    k, j = len(a) - 1, len(b)
    while k >= 0 and j > 0:  # bit j of a row is clear where the length grows at j
        grown = ~rows[k] & (1 << j) - 1
        if not grown:
            break
        j = grown.bit_length() - 1
        while k > 0 and not rows[k - 1] >> j & 1 and (~rows[k - 1] & (1 << j + 1) - 1).bit_count() == (grown & (1 << j + 1) - 1).bit_count():
            k -= 1
        found.add(head + k)
        k -= 1
    return found


COPY = 0.9


def decided(lines: list[int], places: list[int], sizes: list[int], near: list[list[int]]) -> list[bool]:
    """Which lines of a page stay. near: lines of its nearest page and of the other neighbour (as hashes)."""
    marked = any(places)
    weigh = [n if p or not marked else 0 for n, p in zip(sizes, places, strict=True)]
    shared: set[int] = set()
    for other in near:
        found = shared_lines(lines, other)
        if sum(weigh[k] for k in found) < COPY * sum(weigh):
            shared = found
            break
    own = {p for k, p in enumerate(places) if p and k not in shared}
    stay = [p in own if p else k not in shared for k, p in enumerate(places)]
    if marked:
        outside = sum(n for n, p, s in zip(sizes, places, stay, strict=True) if s and not p)
        if outside <= sum(n for n, p, s in zip(sizes, places, stay, strict=True) if s and p):
            stay = [s and p > 0 for s, p in zip(stay, places, strict=True)]
    else:
        edge = [k for k, s in enumerate(stay) if s]
        for a, b in zip(edge, edge[1:], strict=False):
            if b - a <= 3:
                stay[a:b] = [True] * (b - a)
    return stay


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [text_lines(x) for x in batch.pop("html")]
        yield batch.assign(
            lines=[[t for _, t in x] for x in found],
            places=[[p for p, _ in x] for x in found],
            hashes=[[line_hash(t) for _, t in x] for x in found],
        )


def decision_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, stay) of the pages that lose lines."""
    for batch in batches:
        rows, masks = [], []
        for row in batch.itertuples(index=False):
            near = [x.tolist() for x in (row.near_hashes, row.far_hashes) if x is not None]
            stay = decided(row.hashes.tolist(), row.places.tolist(), row.sizes.tolist(), near)
            if not all(stay):
                rows.append(row.row)
                masks.append(stay)
        yield pd.DataFrame({"row": np.array(rows, np.int64), "stay": pd.Series(masks, dtype=object)})


def url_key(url: Column) -> tuple[Column, Column]:
    """Host and path; scheme, query and fragment do not count."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1)), F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two paths, by their segments."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.when(p == q, F.length(p) + 1).otherwise(-1))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.struct(F.when(s["on"] & (k > 0), s["n"] + k).otherwise(s["n"]).alias("n"), (s["on"] & (k > 0)).alias("on")))["n"]


def nearest(keys: DataFrame) -> DataFrame:
    """(row, near, far): for each row id, the rows of the nearest page of its host and of its other neighbour; keys has host, path, row."""
    spread = keys.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    local = spread.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    local = through_table(local, "urls")
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    bases = local.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("base"))
    line = local.join(bases, "part").select("row", "host", "path", (F.col("base") + F.col("k")).alias("pos"))
    cols = lambda p, d: line.select((F.col("pos") + d).alias("pos"), F.col("row").alias(f"{p}_row"), F.col("host").alias(f"{p}_host"), F.col("path").alias(f"{p}_path"))
    near = line.join(cols("prev", 1), "pos", "left").join(cols("next", -1), "pos", "left")
    len_of = lambda p: F.when(F.col(f"{p}_host") == F.col("host"), common_prefix(F.col("path"), F.col(f"{p}_path")))
    near = near.select("row", "prev_row", "next_row", len_of("prev").alias("a"), len_of("next").alias("b"))
    prev_first = F.col("a") >= F.coalesce("b", F.lit(-1))
    prev, next_ = F.when(F.col("a").isNotNull(), F.col("prev_row")), F.when(F.col("b").isNotNull(), F.col("next_row"))
    return near.select("row", F.when(prev_first, prev).otherwise(next_).alias("near"), F.when(prev_first, next_).otherwise(prev).alias("far"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", "url", "html").mapInPandas(line_batches, f"page_id {kind}, url string, lines array<string>, places array<int>, hashes array<long>")
    host, path = url_key(F.col("url"))
    parsed = through_table(parsed.withColumns({"host": host, "path": path, "row": F.monotonically_increasing_id()}), "lines")
    near = nearest(parsed.select("host", "path", "row"))
    own = parsed.select("row", "places", "hashes", F.transform("lines", F.length).alias("sizes"))
    of = lambda x: parsed.select(F.col("row").alias(x), F.col("hashes").alias(f"{x}_hashes"))
    paired = own.join(near, "row").join(of("near"), "near", "left").join(of("far"), "far", "left")
    stay = paired.select("row", "hashes", "places", "sizes", "near_hashes", "far_hashes").mapInPandas(decision_batches, "row long, stay array<boolean>")
    left = parsed.select("row", "page_id", "url", "lines").join(through_table(stay, "stay"), "row", "left")
    lines = F.when(F.col("stay").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, k: F.get("stay", k)))
    texts = left.select("page_id", "url", F.array_join(lines, "\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
