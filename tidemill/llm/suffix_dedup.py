"""Removal of repeated passages by two-stage suffix sorting, over any number of documents.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the
same or in another document. Texts that are equal as a whole are found first, by a 128-bit
hash: all their strings start elsewhere, and one of them goes on for the others. Every window
of `length` bytes has an anchor: the least hash of its k-byte grams. Equal windows have equal
anchors, so

1. every text is cut into segments, runs of windows that share the place of their anchor (at
   most length - k + 1, about 90), and anchors that occur once in the corpus are dropped with their segments;
2. of segments with equal anchors and equal hashes of all their bytes two go on, at most;
3. the bytes of these are cut out and dealt by anchor; each task compares the two, builds
   suffix arrays of whole anchors: suffixes smaller than their successors are sorted directly,
   the rest induced by bucket scans, and common prefixes of neighbours mark the windows that
   stand twice or more. So every window that goes is one of at least two whose bytes were compared;
4. what was found goes back to each segment's places, and the texts are cut.

An anchor with very many different segments is dealt in salted parts. Each part marks what
it finds by itself; of windows it finds but once, and of one of each it finds often, hashes
are counted over the parts. So no anchor is gathered in one task, and nothing is capped.

Defined results: null text is the empty text; texts under `length` bytes keep everything;
strings are judged on the input. Rows of equal text lose it all, whatever their ids; ids, null
or not, say nothing about a row. Spans lie between bytes; without_repeats() drops what is left of a
character that a span has cut. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, small_batches, tidy, written
from .repeats import common_prefix_at_least, segments, two_stage_suffixes

LENGTH, GRAM = 200, 24
#: Windows of one very long text that are looked at together, and bytes of short ones.
SLICE, BLOCK = 1 << 20, 1 << 18
#: Bytes of different segments from which an anchor is dealt in parts; and of one suffix array.
PART_BYTES, ARRAY_BYTES = 1 << 20, 1 << 18

_L, _I = T.LongType(), T.IntegerType()


def text_segments(texts: list[bytes], length: int, gram: int, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the bytes, text number, start, windows, offset) of every segment of the texts.

    Texts are looked at in blocks, many short ones together, a very long one in slices that
    overlap by a window.
    """
    found: list[tuple[np.ndarray, ...]] = []
    block: list[tuple[int, int, bytes]] = []

    def look() -> None:
        data = b"".join(x for _, _, x in block)
        ends = np.cumsum([len(x) for _, _, x in block])
        a, s, n, o = segments(np.frombuffer(data, np.uint8), length, gram, ends)
        who = np.searchsorted(ends, s, "right")
        g = np.zeros(len(a), np.int64)
        if hashed:
            digest = xxhash.xxh3_64_digest
            g = np.frombuffer(b"".join([digest(data[i:j]) for i, j in zip(s.tolist(), (s + n + length - 1).tolist())]), "<i8")
        text = np.array([t for t, _, _ in block])[who]
        shift = (np.array([at for _, at, _ in block]) - (ends - [len(x) for _, _, x in block]))[who]
        found.append((a.view(np.int64), g, text, (s + shift).astype(np.int32), n.astype(np.int32), o.astype(np.int32)))
        block.clear()

    size = 0
    for t, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), SLICE):
            piece = data[at : at + SLICE + length - 1]
            block.append((t, at, piece))
            size += len(piece)
            if size >= BLOCK:
                look()
                size = 0
    if block:
        look()
    return tuple(np.concatenate(x) for x in zip(*found))


#: What texts are told apart by: two 64-bit hashes of their bytes.
KEY = ("ta", "tb")


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("ta"), F.xxhash64(F.lit("b"), text).alias("tb")]


def distinct_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(ta, tb, text packed) of every distinct text and (ta, tb) of those that stand there more than once.

    Texts that stand there once are not shuffled, unless Spark finds the others too many to
    send around; copies meet in a partial aggregation.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*_key(text), text.alias("text"))
    copied = written(rows.groupBy(*KEY).agg(F.count("*").alias("c")).where("c > 1").select(*KEY), "copied")
    once = rows.join(copied, list(KEY), "left_anti")
    first = rows.join(copied, list(KEY), "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    return written(_packed(once.unionByName(first)), "texts"), copied


def _segments(texts: DataFrame, length: int, gram: int, places: bool) -> DataFrame:
    """(m) of every segment; with places (m, g, ta, tb, s, n, o)."""
    schema = T.StructType([T.StructField("m", _L)] + ([T.StructField("g", _L), *texts.schema[:2], *(T.StructField(x, _I) for x in "sno")] if places else []))

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            m, g, who, s, n, o = text_segments([unpack(t) for t in batch.column(2).to_pylist()], length, gram, places)
            if not places:
                return pa.RecordBatch.from_arrays([pa.array(m)], names=["m"])
            who = pa.array(who)
            return pa.RecordBatch.from_arrays([pa.array(m), pa.array(g), batch.column(0).take(who), batch.column(1).take(who), pa.array(s), pa.array(n), pa.array(o)], names=schema.names)

        return step

    return map_arrow(texts, make, schema)


def repeated_places(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(m, g, ta, tb, s, n, o): segments whose anchor occurs twice or more in the distinct texts.

    The anchors are written first, so the join deals both sides itself and can split an
    anchor that very many texts hold.
    """
    often = written(_segments(texts, length, gram, False).groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "repeated-anchors")
    out = written(_segments(texts, length, gram, True).join(often, "m"), "repeated-places")
    discard(often)
    return out


def _bits(runs: np.ndarray) -> bytes:
    return np.packbits(runs, bitorder="little").tobytes()


def _sorted_groups(parts: list[tuple[int, bytes, int, int]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (windows, bytes, weight, group): numbers of its windows' strings, and their weights in all.

    Equal strings within one group have equal numbers. One suffix array over all parts.
    """
    if not parts:
        return []
    text = b"".join(x[1] for x in parts)
    sizes = np.array([len(x[1]) for x in parts])
    starts = np.cumsum(sizes) - sizes
    windows = np.array([x[0] for x in parts])
    owner = np.repeat(np.arange(len(parts)), windows)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    x = np.frombuffer(text, np.uint8)
    order = two_stage_suffixes(x, length)
    chain = common_prefix_at_least(x, order, length)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(np.append(0, ~chain))
    group = np.array([p[3] for p in parts])[owner]
    # windows of other anchors cannot be equal; groups tell salted parts of one anchor apart
    _, inv = np.unique(number[at] * (int(group.max()) + 1) + group, return_inverse=True)
    weight = np.bincount(inv, np.array([p[2] for p in parts], float)[owner])[inv]
    cuts = np.cumsum(windows)[:-1]
    return list(zip(np.split(inv, cuts), np.split(weight, cuts)))


def _halves(rows: list[tuple], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, first window, end) of what can have an equal: windows whose longer side does.

    A window holds its anchor with `length - gram` more bytes, so at least half of them on
    one side. Windows with half or more on the left need another segment with the same
    half before the anchor, the others one with the same half after it; the rest of a
    segment is not sorted. Parts of dealt anchors stay whole, their equals may be elsewhere.
    """
    half = (length - gram) // 2
    sides: list[tuple[int, int, int, tuple]] = []
    count: dict[tuple, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for i, (m, salt, salts, _, _, n, o, data) in enumerate(rows):
        if salts > 1:
            sides.append((i, 0, n, ()))
            continue
        cut = min(n, max(0, o - half + 1))
        if cut:
            sides.append((i, 0, cut, (m, 0, digest(data[o - half : o + gram]))))
        if cut < n:
            sides.append((i, cut, n, (m, 1, digest(data[o : o + gram + length - gram - half]))))
    for *_, key in sides:
        count[key] = count.get(key, 0) + 1
    out: list[tuple[int, int, int]] = []
    for i, a, b, key in sides:
        if not key or count[key] > 1:
            if out and out[-1][0] == i:
                out[-1] = (i, out[-1][1], b)
            else:
                out.append((i, a, b))
    return out


_MARKED = T.StructType([T.StructField("m", _L), T.StructField("g", _L), T.StructField("runs", T.BinaryType()), T.StructField("first", T.BinaryType()), T.StructField("prints", T.BinaryType()), T.StructField("weights", T.BinaryType())])


def _mark(length: int, gram: int):
    """Over rows (m, salt, salts, g, w, n, o, data) sorted by (m, salt, g): which windows are repeated.

    A kind of segment (m, g) has a row, or two adjacent ones from different places; w is how
    many places a row stands for. Of parts of a dealt anchor also `first` (bits: windows to
    be counted over the parts), their 16-byte prints and their weights within the part.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        groups: dict[tuple[int, int], int] = {}
        looked = _halves(rows, length, gram)
        parts = []
        for i, a, b in looked:
            m, salt, _, _, w, _, _, data = rows[i]
            parts.append((b - a, data[a : b + length - 1], w, groups.setdefault((m, salt), len(groups))))
        again = {i: (a, b, *x) for (i, a, b), x in zip(looked, _sorted_groups(parts, length))}
        out, met = [], set()
        for i, (m, _, salts, g, _, n, _, data) in enumerate(rows):
            if i and rows[i - 1][0] == m and rows[i - 1][3] == g:
                if rows[i - 1][7] != data:
                    raise ValueError(f"different bytes of equal hash {g} at anchor {m}")
                continue
            runs = np.zeros(n, bool)
            first = prints = weights = None
            if i in again:
                a, b, number, weight = again[i]
                runs[a:b] = weight > 1
                if salts > 1:
                    new = np.zeros(n, bool)
                    for j, x in enumerate(number.tolist()):
                        if x not in met:
                            met.add(x)
                            new[j] = True
                    first = _bits(new)
                    prints = b"".join(xxhash.xxh3_128_digest(data[j : j + length]) for j in np.flatnonzero(new).tolist())
                    weights = weight[new].astype("<i8").tobytes()
            out.append((m, g, _bits(runs), first, prints, weights))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=_MARKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > ARRAY_BYTES and row[:2] != held[-1][:2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield flush(held)
        tidy()

    return run


def _across(marked: DataFrame) -> DataFrame:
    """(m, g, runs) of dealt anchors: what the parts found, and what only all of them show."""
    one = T.StructType([T.StructField("m", _L), T.StructField("a", _L), T.StructField("b", _L), T.StructField("g", _L), T.StructField("i", _I), T.StructField("w", _L)])

    def unpack():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list[np.ndarray]] = [[] for _ in one]
            for m, g, first, prints, weights in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                p = np.frombuffer(prints, "<i8").reshape(-1, 2)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(first, np.uint8), bitorder="little"))
                for c, x in zip(cols, (np.full(len(p), m), p[:, 0], p[:, 1], np.full(len(p), g), at.astype(np.int32), np.frombuffer(weights, "<i8"))):
                    c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=one.names)

        return step

    rows = map_arrow(marked, unpack, one)
    twice = rows.groupBy("m", "a", "b").agg(F.sum("w").alias("all")).where("all > 1")
    found = rows.where("w = 1").join(twice.drop("all"), ["m", "a", "b"]).groupBy("m", "g").agg(F.collect_list("i").alias("more"))
    schema = T.StructType([T.StructField("m", _L), T.StructField("g", _L), T.StructField("runs", T.BinaryType())])

    def merge():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for runs, more in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bits = np.unpackbits(np.frombuffer(runs, np.uint8), bitorder="little").astype(bool)
                bits[more or []] = True
                out.append(_bits(bits))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=schema.names)

        return step

    return map_arrow(marked.select("m", "g", "runs").join(found, ["m", "g"], "left"), merge, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """rows with `text` as compressed bytes, for the shuffles that texts take."""
    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema])
    at = rows.columns.index("text")

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([pack(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=schema.names)

        return step

    return map_arrow(rows, make, schema)


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """(m, salt, salts, g, w, n, o, data) from rows (text, spans)."""
    schema = T.StructType([T.StructField("m", _L), T.StructField("salt", _L), T.StructField("salts", _L), T.StructField("g", _L), T.StructField("w", _L), T.StructField("n", _I), T.StructField("o", _I), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = unpack(text)
                out += [(x["m"], x["g"] % x["salts"], x["salts"], x["g"], x["w"], x["n"], x["o"], data[x["s"] : x["s"] + x["n"] + length - 1]) for x in spans]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out[i : i + 4096]), (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.binary()))], names=schema.names)
        tidy()

    return rows.mapInArrow(run, schema)


def spans_of(size: int, start: np.ndarray, windows: np.ndarray, runs: list[bytes], length: int) -> np.ndarray:
    """Maximal removed [start, end) spans of a text of `size` bytes from its segments."""
    grow = np.zeros(size + 1, np.int64)
    at = np.concatenate([np.flatnonzero(np.unpackbits(np.frombuffer(r, np.uint8), count=int(w), bitorder="little")) + a for a, w, r in zip(start, windows, runs)])
    np.add.at(grow, at, 1)
    np.add.at(grow, at + length, -1)
    gone = np.diff(np.concatenate([[0], np.cumsum(grow)[:-1] > 0, [0]]))
    return np.stack([np.flatnonzero(gone == 1), np.flatnonzero(gone == -1)], axis=1)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(id, carried columns, n_bytes, n_removed, n_spans, kept binary, spans array, copied) of every document.

    `copied` says that the whole text stands there more than once. With `characters`, kept
    is without what is left of a character that a span has cut.
    """
    small_batches(docs.sparkSession)
    texts, copied = distinct_texts(docs, text_col)
    places = repeated_places(texts, length, gram)
    # any two places of a kind will do: the bytes are the same everywhere
    spot = (*KEY, "s", "n", "o")
    kinds = places.groupBy("m", "g").agg(F.count("*").alias("w"), *(F.first(c).alias(c) for c in spot), *(F.last(c).alias(f"l_{c}") for c in (*KEY, "s")))
    kinds = written(kinds, "segment-kinds")
    large = kinds.groupBy("m").agg(F.sum(F.col("n") + (length - 1)).alias("bytes")).where(F.col("bytes") >= PART_BYTES)
    large = written(large.select("m", F.expr(f"1 + bytes div {PART_BYTES}").alias("parts")), "large-anchors")
    kinds_dealt = kinds.join(large, "m", "left").withColumn("salts", F.coalesce("parts", F.lit(1).cast("long")))
    head = kinds_dealt.select(*KEY, F.struct("m", "g", F.lit(1).cast("long").alias("w"), "s", "n", "o", "salts").alias("x"))
    tail = kinds_dealt.where("w > 1").select(*(F.col(f"l_{c}").alias(c) for c in KEY), F.struct("m", "g", (F.col("w") - 1).alias("w"), F.col("l_s").alias("s"), "n", "o", "salts").alias("x"))
    # as many as the text's length allows, whatever the number of copies
    wanted = head.unionByName(tail).groupBy(*KEY).agg(F.collect_list("x").alias("spans"))
    cut = _cut(texts.join(wanted, list(KEY)).select("text", "spans"), length)
    marked = written(cut.repartition("m", "salt").sortWithinPartitions("m", "salt", "g").mapInArrow(_mark(length, gram), _MARKED), "marked")
    found = marked.where("first is null").select("m", "g", "runs").unionByName(_across(marked.where("first is not null")))

    back = places.join(found, ["m", "g"]).join(copied, list(KEY), "left_anti").groupBy(*KEY).agg(F.collect_list(F.struct("s", "n", "runs")).alias("found"))
    back = written(back.select(*KEY, "found", F.lit(False).alias("copied")).unionByName(copied.select(*KEY, F.lit(None).cast(back.schema["found"].dataType).alias("found"), F.lit(True).alias("copied"))), "found")
    discard(texts, places, kinds, large, marked)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = [f"c{i}" for i in range(1 + len(carry))]
    source = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip((id_col, *carry), held)), *_key(text), text.alias("text"))
    rows = _packed(source).join(back, list(KEY), "left").select(*held, "text", "found", F.coalesce("copied", F.lit(False)).alias("copied"))
    schema = T.StructType(
        [*rows.schema[: len(held)], T.StructField("n_bytes", _L), T.StructField("n_removed", _L), T.StructField("n_spans", _L), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(_L))), T.StructField("copied", T.BooleanType())]
    )

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def one(data: bytes, start: np.ndarray, windows: np.ndarray, runs: list, copied: bool) -> tuple:
            if copied and len(data) >= length:
                return len(data), len(data), 1, b"", [[0, len(data)]]
            if not runs:
                return len(data), 0, 0, data, []
            spans = spans_of(len(data), start, windows, runs, length)
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed = len(data) - len(kept)
            if characters:
                kept = kept.decode(errors="ignore").encode()
            return len(data), removed, len(spans), kept, spans.tolist()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            k = len(held)
            found = batch.column(k + 1)
            flat, size = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy()
            start, windows, runs = flat.field("s").to_numpy(), flat.field("n").to_numpy(), flat.field("runs").to_pylist()
            ends = np.cumsum(size).tolist()
            got = zip(*(one(unpack(t), start[a:b], windows[a:b], runs[a:b], c) for t, c, a, b in zip(batch.column(k).to_pylist(), batch.column(k + 2).to_pylist(), [0, *ends], ends)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([*batch.columns[:k], *(pa.array(list(x), t) for x, t in zip(got, kinds)), batch.column(k + 2)], names=schema.names)

        return step

    out = map_arrow(rows, make, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate((id_col, *carry))), "n_bytes", "n_removed", "n_spans", "kept", "spans", "copied")


def without_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs (every column) with repeated passages cut from the texts, and size_col their new length.

    What is left of a character that a span has cut goes too. Every document stays.
    """
    held = [f"x{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, held))
    rows = remove_repeats(docs.toDF(*held), length=length, id_col=at[id_col], text_col=at[text_col], carry=tuple(h for h in held if h != at[id_col]), characters=True)
    text = F.decode("kept", "UTF-8")
    out = {c: F.col(h) for c, h in at.items()} | {text_col: F.when(F.col(at[text_col]).isNotNull(), text)}
    if size_col in at:
        out[size_col] = F.length(text).cast("long")
    return rows.select(*(x.alias(c) for c, x in out.items()))
