"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines, one for every block of visible text in page order, menus and footers
included. Pages of one host are put in the order of their URL paths and each is paired with
the neighbour whose path shares the longer beginning (the earlier one if equal). The pair's
lines are aligned by longest common subsequence, and lines that both have are the site's,
not the page's: they are deleted, wherever they stand.

Markup only names candidates for what is left: lines inside menus, headers, footers,
sidebars, notices, adverts, forms and comment sections (by tags, roles and class names) are
none; where a page names its article (<article>, <main>), the containers that hold most of
the text are. A class or id name counts only if all words of one of its tokens do (`main-nav`,
but not `share-of-market`). An <article> is all the page's own, and neighbours quote each
other: its lines stay. In a <main>, and on pages that name nothing, shared lines go, but two
addresses of one text share all of it: where more than half of a <main> is shared, or every
line of the page, the neighbour is a copy and they stay.

Defined results: null and empty html give the empty text; the only page of a host is not
differenced; null URLs form one host of their own with empty paths, in the order of their
ids. Repeated rows (of one id, url and html) are one page in that order and each give a row.
Nothing is capped: every line of every page counts, and very long pages are aligned in halves,
in memory that grows with their lines, not with the square.

The texts lie on disk once, in the last join's shuffle, and the hashes of the lines twice (of marked
lines, whose text goes no further, three times): no table
of either is written, every page is parsed twice instead. Rows meet by a 128-bit hash of what they
hold, so the input must hold the same rows whenever it is read; a row that changes is not differenced.
"""

from __future__ import annotations

import html as html_lib
import json
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, written
from .url_filter import host_of, path_of

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noframes noembed noscript template svg math".split())
#: Elements that never belong to the main text.
DROPPED = frozenset("nav footer aside form button select option dialog menu object canvas audio video applet map datalist".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside form".split()
)
#: Values of role that mark what is not the main text.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class and id names that mark what is not the main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond responses feedback share sharing social related recommended recommendations teaser teasers widget toolbar pagination pager search".split()
)
#: As MARKS, but only outside the article, whose own header holds its title.
HEADERS = frozenset("header head".split())
#: The only marks that an article may carry and yet not be one.
NO_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser teasers card".split())
#: Words that may stand beside a mark in one token without changing what it says.
BESIDE = frozenset(
    "site page main global local top bottom left right primary secondary sub side sticky fixed mobile desktop inner outer wrapper wrap container content box block area section list item items row bar panel unit slot zone group inline reader readers user users visitor visitors post posts article articles story stories blog entry link links button buttons icon icons form field thread body title text count header head small large big dark light wp js".split()
)
#: Rows times columns from which an alignment is halved.
CELLS = 1 << 26
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _says(value: str, marks: frozenset[str]) -> bool:
    """Whether a token consists of marks, numbers and words that may stand beside them."""
    for token in value.split():
        words = [w.lower() for w in _NAME.findall(token)]
        if any(w in marks for w in words) and all(w in marks or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    marks = NO_ARTICLE if tag in ("article", "main") else MARKS if inside else MARKS | HEADERS
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id"):
            if _says(value, marks):
                return True
        elif name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "style" and _HIDDEN.search(value.lower()):
            return True
    return False


def parts_of(page: str) -> list[tuple[int, str]]:
    """The page's lines in order, each with its place: -1 marked as none of the main text, 2 * n or
    2 * n + 1 the n-th article or main element (the innermost one), 0 elsewhere."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, marked from here on, container
    run: list[str] = []
    inside, off, at, n, made = 0, False, 0, len(page), 0

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                blocks.append((-1 if off else inside, text))
            run.clear()

    def close(depth: int) -> None:
        nonlocal inside, off
        if stack[-1][1] != (depth > 0 and stack[depth - 1][1]):
            flush()
        del stack[depth:]
        off, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                flush()
            if depth is not None:
                close(depth)
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            stop = page.find(">", at)
            at = n if end is None or stop < 0 else stop + 1
            if tag not in ("svg", "math"):
                run.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
        elif tag == "br":
            run.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        gone = off or _dropped(tag, attrs, inside > 0)
        if gone and not off:
            flush()
        if tag in ("article", "main") and not gone:
            made += 1
            inside = 2 * made + (tag == "main")
        off = gone
        stack.append((tag, off, inside))
    if at < n:
        run.append(page[at:])
    flush()
    return blocks


def main_lines(blocks: list[tuple[int, str]], shared: list[bool]) -> list[bool]:
    """Which lines are the main text, for lines that a neighbour shares or not."""
    if all(shared):  # a copy of its neighbour, or no line at all
        shared = [False] * len(blocks)
    mass: dict[int, list[int]] = {}
    for (where, text), s in zip(blocks, shared):
        if where > 0:
            own = mass.setdefault(where, [0, 0])
            own[s] += len(text)
    whole = {w for w, (a, b) in mass.items() if w % 2 == 0 or b > a}
    weight = {w: a + b if w in whole else a for w, (a, b) in mass.items()}
    most = max(weight.values(), default=0)
    chosen = {w for w, x in weight.items() if 2 * x >= most}
    return [w in chosen and (w in whole or not s) if most else w == 0 and not s for (w, _), s in zip(blocks, shared)]


def lines_of(page: str) -> list[str]:
    """The main text's lines of a page without neighbours."""
    blocks = parts_of(page)
    return [t for (_, t), keep in zip(blocks, main_lines(blocks, [False] * len(blocks))) if keep]


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each line of a, whether a longest common subsequence of a and b takes it.

    Lines that only one side has go first, then the common beginning and end; the rest is
    bit-parallel, one big integer a row: time and bits are rows times columns.
    """
    both = set(a) & set(b)
    at, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    core = [a[i] for i in at]
    lo = next((i for i, (x, y) in enumerate(zip(core, b)) if x != y), min(len(core), len(b)))
    most = min(len(core), len(b)) - lo
    hi = next((i for i in range(most) if core[-1 - i] != b[-1 - i]), most)
    inner = _aligned(core[lo : len(core) - hi], b[lo : len(b) - hi])
    taken = [False] * len(a)
    for i, t in zip(at, [True] * lo + inner + [True] * hi):
        taken[i] = t
    return taken


def _rows(a: list[int], b: list[int]):
    """After each of a: the bit-parallel column over b, whose zero bits mark where the length grows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every beginning of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _aligned(a: list[int], b: list[int]) -> list[bool]:
    if len(a) > 1 and len(a) * len(b) > CELLS:
        mid = len(a) // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return _aligned(a[:mid], b[:cut]) + _aligned(a[mid:], b[cut:])
    rows = list(_rows(a, b))
    full = (1 << len(b)) - 1
    taken, j = [False] * len(a), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # go back to the last growth at or before j
        low = ~rows[i] & ((1 << (j + 1)) - 1)
        if not low:
            break
        j = low.bit_length() - 1
        before = rows[i - 1] if i else full
        if not (~before >> j) & 1:
            taken[i] = True
            j -= 1
    return taken


def mark(lines: list[str]) -> list[int]:
    """A signed 64-bit hash of each line."""
    return [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in lines]


def named(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, html, uid): 128 bits of the SHA-256 of what a row holds are its name, wherever it is read."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    whole = F.concat(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"))), F.lit("\n"), html)
    return pages.select(F.col(id_col), F.col(url_col), html.alias("html"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("uid"))


def outlines(rows: DataFrame) -> DataFrame:
    """(uid, marks) of named rows: hashes of each page's lines."""
    schema = T.StructType([T.StructField("uid", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType()))])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [mark([t for _, t in parts_of(x)]) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.list_(pa.int64()))], names=schema.names)

    return map_arrow(rows.select("uid", "html"), lambda: step, schema)


def parsed(rows: DataFrame) -> DataFrame:
    """(id, url, uid, blocks, marks) of named rows: parts_of(), packed. Marked lines go on as hashes only, the others as text only."""
    source = rows.select(*rows.columns[:2], "uid", "html")
    schema = T.StructType([*source.schema[:3], T.StructField("blocks", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType()))])

    def make():
        pack = zstandard.ZstdCompressor(level=9).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [parts_of(x) for x in batch.column(3).to_pylist()]
            blocks = pa.array([pack(json.dumps([(w, t if w >= 0 else "") for w, t in x], ensure_ascii=False).encode("utf-8", "surrogatepass")) for x in got], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns[:3], blocks, pa.array([mark([t for w, t in x if w < 0]) for x in got], pa.list_(pa.int64()))], names=schema.names)

        return step

    return map_arrow(source, make, schema)


def neighbours(sites: DataFrame, id_col: str) -> DataFrame:
    """(uid, host, path, prev, next): uid and path of the pages before and after, in each host's order.

    Repeated rows lie in one partition and are one page. One range-partitioned sort; rows at partition
    borders look into a table of two rows a partition, so no host, however large, is ever gathered in one task.
    """
    keys = ["host", "path", id_col, "uid"]
    ordered = sites.select(*keys).repartitionByRange(*keys).distinct().sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn("part", F.spark_partition_id()), "url-order")
    row = F.struct("host", "path", "uid")
    w = Window.partitionBy("part").orderBy(*keys)
    inner = ordered.select("*", F.lag(row).over(w).alias("prev"), F.lead(row).over(w).alias("next"))
    by_part = Window.orderBy("part")  # two rows a partition: bounded by the partition count
    ends = ordered.groupBy("part").agg(F.min_by(row, F.struct(*keys)).alias("lo"), F.max_by(row, F.struct(*keys)).alias("hi"))
    ends = ends.select("part", F.lag("hi").over(by_part).alias("before"), F.lead("lo").over(by_part).alias("after"))
    inner = inner.join(F.broadcast(ends), "part")
    prev, next_ = F.coalesce("prev", "before"), F.coalesce("next", "after")
    same = lambda c: F.when(c["host"].eqNullSafe(F.col("host")), c)
    return inner.select("uid", "host", "path", same(prev).alias("prev"), same(next_).alias("next"))


def partners(near: DataFrame) -> DataFrame:
    """(uid, partner): the neighbour of the longer common path beginning, the earlier if equal."""

    def closer(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for path, p, q in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            alike = [len(os.path.commonprefix([path, x["path"]])) if x else -1 for x in (p, q)]
            best = p if alike[0] >= alike[1] else q
            out.append(best["uid"] if best else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uid", "partner"])

    schema = T.StructType([near.schema["uid"], T.StructField("partner", T.BinaryType())])
    return map_arrow(near.select("uid", "path", "prev", "next"), lambda: closer, schema).where("partner is not null")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_lines, n_shared, n_marked): the main text of every page, blocks joined by a blank line.

    Of n_lines lines n_shared go that the neighbour shares, n_marked more go by markup alone.
    """
    rows = named(pages, id_col, url_col, html_col)
    sites = rows.select(id_col, "uid", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pair = partners(neighbours(sites, id_col))
    other = outlines(rows).select(F.col("uid").alias("partner"), F.col("marks").alias("other")).dropDuplicates(["partner"])
    pair = pair.join(other, "partner").select("uid", "other")
    # by shuffle at every size, so that disk measured on small tables holds on large ones
    rows = parsed(rows).join(pair.hint("merge"), "uid", "left").select(id_col, url_col, "blocks", "marks", "other")
    counts = ("n_chars", "n_lines", "n_shared", "n_marked")
    schema = T.StructType([*rows.schema[:2], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)])

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def one(packed: bytes, marks: list[int], other: list[int] | None) -> tuple:
            blocks = json.loads(unpack(packed).decode("utf-8", "surrogatepass"))
            marked = iter(marks)
            own = [next(marked) if w < 0 else x for (w, _), x in zip(blocks, mark([t for _, t in blocks]))]
            shared = shared_lines(own, other or [])
            main = main_lines(blocks, shared)
            text = "\n\n".join(t for (_, t), keep in zip(blocks, main) if keep)
            by_site = sum(s and not k for s, k in zip(shared, main))
            return text, len(text), len(blocks), by_site, len(blocks) - by_site - sum(main)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = zip(*(one(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), f) for x, f in zip(got, (pa.string(), *[pa.int64()] * 4)))], names=schema.names)

        return step

    return map_arrow(rows, make, schema)
