"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits. Bits that correlate over the corpus share one of `PARTS` parts;
part i gets a threshold t_i >= -1 with sum(t_i + 1) = max_bits + 1, so two fingerprints at
most max_bits apart differ by at most t_i bits in some part. Thresholds are unequal and
chosen for each fingerprint by dynamic programming over how many fingerprints its probes
would meet, from exact histograms of all fingerprints' parts. Probes meet the index by key,
candidates are verified by counting differing bits, and of every task's links only a
spanning forest leaves it, so a group of n copies never costs n * n rows.

Equal fingerprints are one node. Defined results: null text is the empty text; texts
without words have fingerprint zero and link like any other; a null id takes no part in the
choice of the smallest id (a group of nothing else has a null one). Repeated rows link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, small_batches, texts_of, tidy, written
from .components import components, forest

BITS, PARTS, WIDTH = 64, 4, 16
SEED = 42
#: Radii that a part may be probed to, and how many values that takes.
RADII = (0, 1, 2)
PROBES = (1, 1 + WIDTH, 1 + WIDTH + WIDTH * (WIDTH - 1) // 2)
#: What sending one probe costs, in candidates verified.
PROBE_COST = 4
#: Pairs that are expanded at once; larger groups are searched from link to link.
BLOCK = 1 << 18
#: Rows, or probes, of one key from which it is dealt in blocks.
HOT = 1 << 17
#: Buckets in which the texts that hold a shingle are counted.
SKETCH = 1 << 18
#: Bits for each row of a list that is sent around, at most, and in one row of the table that holds them (Spark's bitmaps).
LIST_BITS, MOST_BITS, WORD_BITS = 16, 1 << 27, 1 << 15
#: Texts of a component that elect leaders at once, and leaders that they elect.
GROUP, LEADERS = 1000, 64

_L = T.LongType()


def shingle_rows(text: str, shingle: int) -> np.ndarray:
    """(n, 8) bytes: each shingle's hash; fewer words make one shingle, none make none."""
    words = text.encode().lower().split()  # A-Z only; cuts at space and U+0009..U+000D
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())]), np.uint8).reshape(n, 8)


def fingerprint(text: str, shingle: int) -> bytes:
    """Eight bytes, the highest bit first: set where over half of the shingles' hashes have it."""
    rows = shingle_rows(text, shingle)
    return _majority(rows) if len(rows) else bytes(8)


def _majority(rows: np.ndarray) -> bytes:
    """The bits that over half of the rows of eight bytes have."""
    n, total = len(rows), np.zeros(BITS, np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(rows[i : i + 255 * 256], axis=1)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every whole text; bits are the fingerprint's, as a signed long."""
    texts = texts_of(docs, id_col, text_col)
    schema = T.StructType([texts.schema[0], T.StructField("fp", _L)])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = b"".join(fingerprint(t, shingle) for t in batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=schema.names)

        return step

    return map_arrow(texts, make, schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, the lowest bit first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits, over all of them; the driver gets 4096 sums."""
    schema = T.StructType([T.StructField("n", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            for i in range(0, len(x), 1 << 20):
                total += (x[i : i + (1 << 20)].T @ x[i : i + (1 << 20)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["n"])

    each = fps.select("fp").mapInArrow(run, schema).select(F.posexplode("n").alias("at", "n"))
    out = np.zeros(BITS * BITS, np.int64)
    for r in each.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int) -> np.ndarray:
    """PARTS rows of WIDTH bits: each part grows by the bit that correlates most with it."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for _ in range(PARTS):
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < WIDTH:
            nxt = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            free.remove(nxt)
        parts.append(sorted(part))
    return np.array(parts)


def part_values(fps: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Each fingerprint's value in each part, shape (n, PARTS)."""
    bits = _bits(fps)
    return np.stack([bits[:, p].astype(np.int64) @ (1 << np.arange(WIDTH)) for p in parts], axis=1)


def _flips(radius: int) -> np.ndarray:
    one = 1 << np.arange(WIDTH)
    out = [np.zeros(1, np.int64)]
    if radius >= 1:
        out.append(one)
    if radius >= 2:
        i, j = np.triu_indices(WIDTH, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def candidate_counts(histogram: np.ndarray) -> np.ndarray:
    """counts[r, v]: fingerprints whose value lies within RADII[r] bits of v, for one part."""
    v = np.arange(1 << WIDTH)
    return np.stack([sum(histogram[v ^ f] for f in _flips(r)) for r in RADII])


def allocate(counts: np.ndarray, values: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds t (n, PARTS) with sum(t + 1) = max_bits + 1 and least estimated cost, by DP."""
    n, need, width = len(values), max_bits + 1, len(RADII) + 1
    if not 0 <= max_bits < PARTS * len(RADII):
        raise ValueError(f"max_bits must be 0..{PARTS * len(RADII) - 1}: {PARTS} parts are probed to radius {RADII[-1]} at most")
    cost = np.zeros((PARTS, width, n))
    for i in range(PARTS):
        for r in range(len(RADII)):
            cost[i, r + 1] = counts[i, r, values[:, i]] + PROBE_COST * PROBES[r]
    best = np.full((PARTS + 1, need + 1, n), np.inf)
    best[0, 0] = 0
    pick = np.zeros((PARTS + 1, need + 1, n), np.int8)
    for i in range(PARTS):
        for s in range(need + 1):
            for t in range(min(width - 1, s) + 1):
                c = best[i, s - t] + cost[i, t]
                less = c < best[i + 1, s]
                best[i + 1, s][less] = c[less]
                pick[i + 1, s][less] = t
    out, left = np.zeros((n, PARTS), np.int64), np.full(n, need)
    for i in range(PARTS, 0, -1):
        t = pick[i][left, np.arange(n)]
        out[:, i - 1] = t - 1
        left = left - t
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of differing bits of two int64 arrays."""
    return np.bitwise_count((a ^ b).view(np.uint64))


class _Links:
    """A task's links, kept as a spanning forest."""

    def __init__(self):
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > 1 << 21:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nodes, roots = forest(np.concatenate(self.a), np.concatenate(self.b))
        other = nodes != roots
        self.a, self.b, self.n = [nodes[other]], [roots[other]], int(other.sum())
        return self.a[0], self.b[0]


def _search(indexed: np.ndarray, probing: np.ndarray, max_bits: int, links: _Links) -> None:
    """Links of one large group, found from link to link, each fingerprint reached once."""
    fps = np.unique(np.concatenate([indexed, probing]))
    is_in = np.isin(fps, indexed)
    # two lists of the unreached; whoever is reached leaves them, so dense groups empty fast
    rest = [np.flatnonzero(is_in), np.flatnonzero(~is_in)]
    while len(rest[0]):
        todo = [rest[0][0]]
        rest[0] = rest[0][1:]
        while todo:
            x = todo.pop()
            for side in (0, 1) if is_in[x] else (0,):
                near = differing(fps[rest[side]], fps[x]) <= max_bits
                if near.any():
                    got = rest[side][near]
                    rest[side] = rest[side][~near]
                    links.add(fps[got], np.full(len(got), fps[x]))
                    todo.extend(got.tolist())


def _verify(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, max_bits: int, links: _Links) -> None:
    """Meets probes and index entries of equal key; rows hold whole keys."""
    order = np.argsort(key, kind="stable")
    key, fp, probe = key[order], fp[order], probe[order]
    qk, qf, xk, xf = key[probe], fp[probe], key[~probe], fp[~probe]
    lo, hi = np.searchsorted(xk, qk, "left"), np.searchsorted(xk, qk, "right")
    met = hi > lo
    qk, qf, lo, hi = qk[met], qf[met], lo[met], hi[met]
    if not len(qk):
        return
    first = np.flatnonzero(np.append(True, np.diff(qk) != 0))
    queries = np.diff(np.append(first, len(qk)))
    large = queries * (hi - lo)[first] > BLOCK
    for g in np.flatnonzero(large):
        s = first[g]
        _search(xf[lo[s] : hi[s]], qf[s : s + queries[g]], max_bits, links)
    small = ~np.repeat(large, queries)
    qf, lo, n = qf[small], lo[small], (hi - lo)[small]
    upto = np.cumsum(n)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 4 * BLOCK))
    for s, e in zip(cuts, np.append(cuts[1:], len(n))):
        k = n[s:e]
        at = np.repeat(lo[s:e] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        a, b = np.repeat(qf[s:e], k), xf[at]
        linked = (differing(a, b) <= max_bits) & (a != b)
        links.add(a[linked], b[linked])


def _dealt(keys: list, own: list, probe: list, part: int, value: np.ndarray, fps: np.ndarray, there: np.ndarray, most: np.ndarray, asks: bool) -> tuple[list, list, list]:
    """Adds rows of a part's values: a key of over HOT rows is dealt in a grid of blocks of rows by blocks of probes.

    Each row goes to every block of probes of its key and each probe to every block of rows,
    so all of them meet and no task holds more than about HOT of either.
    """
    rows, probes = 1 + there[value] // HOT, 1 + most[value] // HOT
    base = (value + (part << WIDTH)) << 32
    place = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    fixed, across = (place % probes, rows) if asks else (place % rows, probes)
    owner = np.repeat(np.arange(len(value)), across)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(across) - across, across)
    a, b = (turn, fixed[owner]) if asks else (fixed[owner], turn)
    keys.append(base[owner] + (a << 16) + b)
    own.append(fps[owner])
    probe.append(np.full(len(owner), asks))
    return keys, own, probe


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of distinct `fp` at most max_bits apart."""
    spark = nodes.sparkSession
    n = nodes.count()
    parts = group_bits(bit_statistics(nodes), n)

    def cut():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = part_values(batch.column(0).to_numpy(), parts) + (np.arange(PARTS) << WIDTH)
            return pa.RecordBatch.from_arrays([pa.array(v.ravel(), pa.int64())], names=["key"])

        return step

    histogram = np.zeros(PARTS << WIDTH, np.int64)
    by_key = map_arrow(nodes.select("fp"), cut, T.StructType([T.StructField("key", T.LongType())])).groupBy("key").agg(F.count("*").alias("n"))
    for r in by_key.toLocalIterator():  # at most PARTS * 2**WIDTH rows, whatever the corpus
        histogram[r["key"]] = r["n"]
    counts = np.stack([candidate_counts(h) for h in histogram.reshape(PARTS, -1)])
    allocate(counts, np.zeros((1, PARTS), np.int64), max_bits)  # raises here, not in a task
    sent = spark.sparkContext.broadcast(counts)  # of that fixed size

    def deal():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = batch.column(0).to_numpy()
            values = part_values(fps, parts)
            t = allocate(sent.value, values, max_bits)
            keys, own, probe = [], [], []
            for i in range(PARTS):
                there, most = sent.value[i, 0], sent.value[i, -1]  # the exact histogram, and who may ask
                keys, own, probe = _dealt(keys, own, probe, i, values[:, i], fps, there, most, False)
                for r in RADII:
                    who = t[:, i] == r
                    f = _flips(r)
                    asked = values[who, i][:, None] ^ f
                    met = (there[asked] > (f == 0)).ravel()  # what no other answers stays here
                    keys, own, probe = _dealt(keys, own, probe, i, asked.ravel()[met], np.repeat(fps[who], len(f))[met], there, most, True)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, own, probe)], names=["key", "fp", "probe"])

        return step

    dealt = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("probe", T.BooleanType())])
    rows = map_arrow(nodes.select("fp"), deal, dealt)
    dealt_rows = rows.repartition(F.col("key")).sortWithinPartitions("key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows, most = _Links(), [], 0, 1 << 20
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += b.num_rows
            if rows > most:  # all but the last key are complete
                key, fp, probe = (np.concatenate(x) for x in zip(*held))
                done = int(np.searchsorted(key, key[-1], "left"))
                if done:
                    _verify(key[:done], fp[:done], probe[:done], max_bits, out)
                held, rows = [[key[done:], fp[done:], probe[done:]]], len(key) - done
                most = max(1 << 20, 2 * rows)
        if held:
            _verify(*(np.concatenate(x) for x in zip(*held)), max_bits, out)
        a, b = out.shrink()
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])
        tidy()

    return dealt_rows.mapInArrow(verify, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): the smallest id that links of at most max_bits bits reach."""
    rows = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes, max_bits))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp"), "left").select(id_col, "fp", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_rows(text, shingle).reshape(-1).view(np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted distinct arrays; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def word_key(text: Column) -> Column:
    """16 bytes of a text's words, A-Z lower-cased: equal for texts of equal words (MD5; null is the empty text)."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(lower, "[ \\t-\\r]+", " "))))


def _unpacked() -> Callable[[bytes], str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return lambda z: unpack(z).decode()


def representatives(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k long, node, id, z), (id, node) of copies that go, and (id, node) of rows that stand there more than once.

    A node is a sequence of words. It is represented by its smallest id (null only if it has no
    other) and gets a number k; z is its packed text. Texts are shuffled only if Spark finds
    the copies too many to send around.
    """
    rows = docs.select(F.col(id_col).alias("id"), word_key(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(rows.groupBy("node", "id").agg(F.count("*").alias("n")), "words")
    least = counts.groupBy("node").agg(F.min_by("id", F.struct(F.col("id").isNull(), "id")).alias("least"), F.count("*").alias("ids"))
    several = written(least.where("ids > 1").select(F.col("node").alias("_n"), "least"), "copied")
    copies = written(counts.join(several, F.col("node") == F.col("_n")).where(~F.col("id").eqNullSafe(F.col("least"))).select("id", "node"), "copies")
    repeats = written(without(counts.where("n > 1"), copies).select("id", "node"), "repeats")
    one = without_few(rows, copies)
    if repeats.head() is not None:
        again = among(one, repeats).groupBy("id", "node").agg(F.first("text").alias("text"))
        one = without(one, repeats).unionByName(again)
    discard(counts, several)
    schema = T.StructType([*one.schema[:2], T.StructField("z", T.BinaryType())])

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], names=schema.names)

        return step

    packed = map_arrow(one.select("id", "node", "text"), make, schema).withColumn("k", F.monotonically_increasing_id())
    return written(packed, "texts"), copies, repeats


def without(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows whose (id, node) is not listed; null ids are ids like any other."""
    at = listed.select(F.col("id").alias("_i"), F.col("node").alias("_n"))
    return rows.join(at, F.col("id").eqNullSafe(F.col("_i")) & (F.col("node") == F.col("_n")), "left_anti")


def marked(rows: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
    """rows with `_maybe`: false only where no row of listed, a table, has the same keys.

    One bit of LIST_BITS for each row of listed is sent to every task, at most MOST_BITS; so rows
    with long texts need not be shuffled to find that they are not listed.
    """
    bits = max(WORD_BITS, min(MOST_BITS, 1 << (LIST_BITS * listed.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    at = listed.select(place.alias("at")).groupBy(F.expr(f"at div {WORD_BITS}").alias("_word"))
    words = at.agg(F.bitmap_construct_agg(F.col("at") % WORD_BITS).alias("_bits"))
    met = rows.withColumn("_at", place).join(F.broadcast(words), F.expr(f"_at div {WORD_BITS}") == F.col("_word"), "left")
    byte = f"cast(conv(hex(substr(_bits, cast(_at % {WORD_BITS} div 8 as int) + 1, 1)), 16, 10) as bigint)"
    return met.withColumn("_maybe", F.expr(f"coalesce(getbit({byte}, cast(_at % 8 as int)) = 1, false)")).drop("_at", "_word", "_bits")


def without_few(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """without() of long rows and a table: only rows that may be listed are shuffled."""
    both = marked(rows, listed, "id", "node")
    return both.where("not _maybe").drop("_maybe").unionByName(without(both.where("_maybe").drop("_maybe"), listed))


def among(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows whose (id, node) is listed."""
    at = listed.select(F.col("id").alias("_i"), F.col("node").alias("_n"))
    return rows.join(at, F.col("id").eqNullSafe(F.col("_i")) & (F.col("node") == F.col("_n")), "left_semi")


def prints_and_counts(texts: DataFrame, shingle: int) -> tuple[DataFrame, np.ndarray]:
    """(k, fp) of every (k, z) row, and in how many of the texts a shingle of each of SKETCH buckets stands.

    One pass over all texts; each task adds up its buckets, and the driver gets SKETCH sums.
    """
    schema = T.StructType([T.StructField("k", _L), T.StructField("fp", _L), T.StructField("bucket", T.IntegerType()), T.StructField("n", _L)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, text = np.zeros(SKETCH, np.int64), _unpacked()
        for b in batches:
            fps = []
            for z in b.column(1).to_pylist():
                rows = shingle_rows(text(z), shingle)
                fps.append(_majority(rows) if len(rows) else bytes(8))
                np.add.at(total, bucket_of(np.unique(rows.reshape(-1).view(np.uint64))), 1)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=schema.names)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 15):
            some = at[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=schema.names)
        tidy()

    small_batches(texts.sparkSession)
    rows = written(texts.select("k", "z").mapInArrow(run, schema), "prints")
    counts = np.zeros(SKETCH, np.int64)
    for r in rows.where("k is null").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SKETCH rows
        counts[r["bucket"]] = r["n"]
    return rows.where("k is not null").select("k", "fp"), counts


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket in which a shingle is counted."""
    return (shingles >> np.uint64(17)).astype(np.int64) % SKETCH


def prefix(shingles: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the order (bucket's count, hash), so many that sets as similar as `least` share one."""
    need = int(np.ceil(least * len(shingles) - 1e-9))
    return shingles[np.lexsort((shingles, counts[bucket_of(shingles)]))][: len(shingles) - need + 1]


def prefixes(texts: DataFrame, shingle: int, least: float, counts: np.ndarray) -> DataFrame:
    """(h, k, n, at): every text's prefix shingles with their places, and how many shingles it has.

    Texts without words are one node and have no near one.
    """
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # of a fixed size
    schema = T.StructType([T.StructField("h", _L), T.StructField("k", _L), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def make():
        text = _unpacked()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(text(z), shingle) for z in batch.column(1).to_pylist()]
            firsts = [prefix(x, sent.value, least) if len(x) else x for x in sets]
            many = [len(x) for x in firsts]
            places = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
            sizes = np.repeat(np.array([len(x) for x in sets], np.int32), many)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(sizes), pa.array(places)], names=schema.names)

        return step

    return map_arrow(texts.select("k", "z"), make, schema)


def candidate_pairs(rows: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: numbers of prefix rows that meet others at a place from which `least` can be reached.

    A sort-merge join on the shingle, whose partitions Spark can split where very many texts
    hold it; the sides of a self-join share one shuffle.
    """
    x = rows.select("h", F.col("k").alias("x"), F.col("n").alias("xn"), F.col("at").alias("xat"))
    y = others.select("h", F.col("k").alias("y"), F.col("n").alias("yn"), F.col("at").alias("yat"))
    reach = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat"))  # holds for the first shingle a pair shares
    need = (F.col("xn") + F.col("yn")) * (least / (1 + least)) - 1e-9
    met = x.hint("merge").join(y, "h").where((F.col("x") != F.col("y")) & (reach >= need) & (F.least("xn", "yn") >= F.greatest("xn", "yn") * least - 1e-9))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b, ia, ib) of those (a, b) pairs, a table, whose exact similarity is at least `least`, with their ids."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    texts = marked(texts, ends, "k").where("_maybe")
    left, right = (texts.select(F.col("k").alias(c), F.col("id").alias(f"i{c}"), F.col("z").alias(f"z{c}")) for c in "ab")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib", "za", "zb")
    schema = T.StructType([*rows.schema[:4], T.StructField("near", T.BooleanType())])

    def make():
        text, held = _unpacked(), (None, None)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal held
            near = []
            for b, za, zb in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5))):
                if held[0] != b:  # rows come in order of b
                    held = (b, shingle_set(text(zb), shingle))
                near.append(similarity(shingle_set(text(za), shingle), held[1]) >= least)
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], names=schema.names)

        return step

    return map_arrow(rows, make, schema).where("near").drop("near")


def beaten(edges: DataFrame) -> DataFrame:
    """Numbers that go so that no (win, lose) edge has both ends left and whoever goes has a winner that stays.

    Whoever no edge beats stays, who loses to them goes, and so on until no edge is left.
    """
    edges, gone = written(edges, "edges"), None
    none = edges.select(F.col("lose").alias("k")).limit(0)
    while edges.head() is not None:
        stay = edges.select(F.col("win").alias("k")).distinct().join(edges.select(F.col("lose").alias("k")), "k", "left_anti")
        out = written(edges.join(stay, F.col("win") == F.col("k")).select(F.col("lose").alias("k")).distinct(), "beaten")
        gone = out if gone is None else gone.unionByName(out)
        last = edges
        for end in ("win", "lose"):
            edges = edges.join(out.select(F.col("k").alias(end)), end, "left_anti")
        edges = written(edges, "edges")
        discard(last)
    return none if gone is None else gone


def _leaders(shingle: int, least: float):
    """Over (c, k, z) rows in order of c: (c, k, z of leaders, by of those that go for one).

    A row goes for the first leader that is as similar as `least`, else it becomes a leader
    while there are fewer than LEADERS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, group, held = _unpacked(), None, []
        for b in batches:
            out = []
            for c, k, z in zip(*(x.to_pylist() for x in b.columns)):
                if c != group:
                    group, held = c, []
                s = shingle_set(text(z), shingle)
                by = next((i for i, t in held if similarity(s, t) >= least), None)
                if by is None and len(held) < LEADERS:
                    held.append((k, s))
                    out.append((c, k, z, None))
                elif by is not None:
                    out.append((c, k, None, by))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["c", "k", "z", "by"])

    return run


def _followers(shingle: int, least: float):
    """Over (c, salt, is member, k, z) rows in that order: (k, by) of members that go for a leader of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, group, held = _unpacked(), None, []
        for b in batches:
            out = []
            for c, salt, member, k, z in zip(*(x.to_pylist() for x in b.columns)):
                if (c, salt) != group:
                    group, held = (c, salt), []
                s = shingle_set(text(z), shingle)
                if not member:
                    held.append((k, s))
                elif (by := next((i for i, t in held if similarity(s, t) >= least), None)) is not None:
                    out.append((k, by))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["k", "by"])

    return run


def thinned(texts: DataFrame, prints: DataFrame, shingle: int, max_bits: int, least: float) -> DataFrame:
    """(k, by): who goes for whom within the components of fingerprints at most max_bits apart.

    Of each component GROUP texts of smallest hash elect leaders in order of id, unlike each
    other; all its texts are then compared with these, a large component in salted parts. Components that are
    still large and have shrunk by a tenth elect again. What this does not reach stays for the
    exact search, so nothing depends on it but the time that a large group takes.
    """
    nodes = written(prints.groupBy("fp").agg(F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, max_bits)).select(F.col("node").alias("_f"), "root")
    found = prints.join(nodes.where("n > 1").select(F.col("fp").alias("_f"), F.col("fp").alias("root")).unionByName(roots).groupBy("_f").agg(F.min("root").alias("c")), F.col("fp") == F.col("_f"))
    roots_too = roots.select(F.col("root").alias("c")).distinct()
    lone = prints.join(roots_too, F.col("fp") == F.col("c"), "left_semi").select("k", F.col("fp").alias("c"))
    live = written(found.select("k", "c").unionByName(lone).distinct(), "members")
    small_batches(texts.sparkSession)
    order, gone = F.xxhash64("k"), None
    while live.head() is not None:
        size = live.groupBy("c").agg(F.count("*").alias("n"))
        live = written(live.join(size, "c").where("n > 1"), "members")
        first = live.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy(order, "k"))).where(F.col("i") <= GROUP)  # limited before its shuffle
        first = first.select("c", "k").join(texts.select("k", "id", "z"), "k").repartition("c").sortWithinPartitions("c", F.col("id").isNull(), "id", "k")
        led = written(first.select("c", "k", "z").mapInArrow(_leaders(shingle, least), "c long, k long, z binary, by long"), "leaders")
        out = led.where("by is not null").select("k", "by")
        heads = led.where("by is null").select("c", "k", "z")
        rest = live.where(F.col("n") > GROUP).withColumn("salts", F.expr(f"1 + n div {GROUP}"))
        if rest.head() is not None:
            salted = heads.join(rest.select("c", "salts").distinct(), "c").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), "k", "z")
            asked = rest.join(led.select("k"), "k", "left_anti").join(texts.select("k", "z"), "k").select("c", F.pmod(order, "salts").alias("salt"), F.lit(True).alias("member"), "k", "z")
            both = salted.unionByName(asked).repartition("c", "salt").sortWithinPartitions("c", "salt", "member")
            out = out.unionByName(both.mapInArrow(_followers(shingle, least), "k long, by long"))
        out = written(out, "gone")
        gone = out if gone is None else gone.unionByName(out)
        left = rest.join(out.select("k"), "k", "left_anti").join(heads.select("k"), "k", "left_anti").select("k", "c", "n")
        fewer = left.groupBy("c").agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m <= 0.9 * n").select("c")
        live, last = written(left.join(fewer, "c", "left_semi").select("k", "c"), "members"), live
        discard(last, led)
    return texts.select("k", F.col("k").alias("by")).limit(0) if gone is None else written(gone, "gone")


def keep_one(docs: DataFrame, *, shingle: int = 5, max_bits: int = 6, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (every column) without near-duplicates: of what stays no two rows are as similar as
    `least` (Jaccard over distinct shingles), and whatever goes is so similar to one that stays.

    Rows are told apart by id and words, never by the id alone. Of rows with the same words
    the smallest id stays (a null id only if there is no other), of wholly equal ones one row.
    Large groups are thinned by the components of their fingerprints (see thinned()); of what
    is left, every pair as similar as `least` is found by exact prefixes. In a pair the one
    that more have gone for stays, else the smaller id. Those who had gone for one that goes
    itself are taken back and compared again.
    """
    texts, copies, repeats = representatives(docs, id_col, text_col)
    prints, counts = prints_and_counts(texts, shingle)
    gone = thinned(texts, prints, shingle, max_bits, least)
    left = texts.join(gone.select("k"), "k", "left_anti")
    rows = prefixes(left, shingle, least, counts)
    pairs = written(similar_pairs(written(candidate_pairs(rows, rows, least), "candidates"), texts, shingle, least), "similar")
    weight = gone.groupBy("by").agg(F.count("*").alias("w"))
    for end in ("a", "b"):
        pairs = pairs.join(weight.select(F.col("by").alias(end), F.col("w").alias(f"w{end}")), end, "left").fillna(0, [f"w{end}"])
    lost = written(beaten(_ranked(pairs, "wa > wb")), "lost")

    back = written(gone.join(lost.select(F.col("k").alias("by")), "by", "left_semi").select("k"), "taken-back")
    gone = gone.select("k").join(back, "k", "left_anti").unionByName(lost)
    if back.head() is not None:
        again = written(prefixes(texts.join(back, "k", "left_semi"), shingle, least, counts), "prefixes")
        # of those who stay only what shares a shingle with these is dealt
        asked = written(again.select("h").distinct(), "asked")
        stayed = prefixes(left.join(lost, "k", "left_anti"), shingle, least, counts).join(asked, "h", "left_semi")
        pairs = similar_pairs(written(candidate_pairs(again, stayed.unionByName(again), least), "candidates"), texts, shingle, least)
        for end in ("a", "b"):
            pairs = pairs.join(back.select(F.col("k").alias(end), F.lit(1).alias(f"w{end}")), end, "left").fillna(0, [f"w{end}"])
        gone = gone.unionByName(beaten(_ranked(pairs, "wa < wb")))
    off = written(copies.unionByName(texts.join(gone.select("k"), "k", "left_semi").select("id", "node")), "off")
    held = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: h for n, h in zip(docs.columns, held)}
    source = docs.toDF(*held).withColumns({"id": F.col(at[id_col]), "node": word_key(F.col(at[text_col]))})
    kept = without_few(source, off)
    if repeats.head() is not None:
        once = among(kept, repeats).groupBy("id", "node").agg(F.first(F.struct(*held)).alias("r")).select("r.*")
        kept = without(kept, repeats).select(*held).unionByName(once)
    discard(prints)
    return kept.select(*(F.col(h).alias(n) for n, h in zip(docs.columns, held)))


def _ranked(pairs: DataFrame, first_wins: str) -> DataFrame:
    """(win, lose) of (a, b) pairs; where weights are equal the smaller id wins, a null id never, else the smaller number."""
    order = F.struct(F.col("ia").isNull(), "ia", "a") < F.struct(F.col("ib").isNull().alias("c"), F.col("ib"), F.col("b"))
    first = F.expr(first_wins) | (F.col("wa") == F.col("wb")) & order
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("win"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lose"))
