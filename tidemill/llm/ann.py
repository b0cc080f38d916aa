"""Approximate nearest neighbours by cosine over learned partitions.

On a bounded sample: an exact neighbour graph, balanced partitioning of that graph
(recursive bisection by its second eigenvector, cut at the median, refined by swaps of equal
numbers), and a small softmax classifier trained on each vector's neighbours' partitions.
Tables of every size are partitioned, in 32 parts at least (fewer only if there are too few
rows to tell them apart); where one classifier's parts would hold too many rows, each part
learns a classifier of its own, on a bounded sample of its rows, and a partition is a part of
a part. All rows are placed in their likeliest partition; a query goes to its likeliest
partitions, as many as the sample shows to be needed, and what it meets there is reranked
exactly. How many that is depends on the data: isotropic random vectors have no partitions
to learn, and most must be read for a high recall.

Equal vectors are pre-aggregated: no answer needs more than the k + 1 smallest ids of one
vector, and equal queries are searched once. Partitions are dealt in salted blocks of rows
against blocks of queries, so no partition is gathered in one task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than most (the shorter, if equally many). Rows
with the query's id are its own and no candidates; of several vectors of an id the smallest
takes part. Null ids take no part. Fewer candidates than k give all of them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, small_batches, written


@dataclass(frozen=True)
class Settings:
    """Bounds and aims; sample is the most rows that one classifier is fitted on, most_parts its most parts."""

    sample: int = 4096
    graph_k: int = 10
    rows_a_part: int = 1000
    least_parts: int = 32
    most_parts: int = 256
    sub_sample: int = 1024
    most_sub_parts: int = 64
    recall: float = 0.93
    block_rows: int = 16_384
    block_queries: int = 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the upper half of nodes: second eigenvector of the graph's walk, then swaps."""
    place = np.full(len(graph), -1)
    place[nodes] = np.arange(len(nodes))
    a, b = np.repeat(np.arange(len(nodes)), graph.shape[1]), place[graph[nodes].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n = len(nodes)
    deg = np.bincount(a, minlength=n) + 1.0
    v = rng.normal(size=n)
    for _ in range(60):
        v = (v + np.bincount(a, v[b], n)) / deg
        v -= (v @ deg) / deg.sum()
        v /= np.linalg.norm(v) + 1e-12
    upper = np.zeros(n, bool)
    upper[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        same = upper[a] == upper[b]
        gain = np.bincount(a, np.where(same, -1.0, 1.0), n)
        hi, lo = np.flatnonzero(upper), np.flatnonzero(~upper)
        hi, lo = hi[np.argsort(-gain[hi], kind="stable")], lo[np.argsort(-gain[lo], kind="stable")]
        m = min(len(hi), len(lo))
        swap = int((gain[hi[:m]] + gain[lo[:m]] > 2).sum() * 0.5)
        if not swap:
            break
        upper[hi[:swap]], upper[lo[:swap]] = False, True
    return upper


def balanced_parts(graph: np.ndarray, levels: int, seed: int = 5) -> np.ndarray:
    """A partition number below 2 ** levels for every node, partitions of equal size."""
    rng, label = np.random.default_rng(seed), np.zeros(len(graph), np.int64)
    for _ in range(levels):
        new = label * 2
        for p in np.unique(label):
            nodes = np.flatnonzero(label == p)
            new[nodes] += _bisect(nodes, graph, rng)
        label = new
    return label


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 64, steps: int = 400, seed: int = 5) -> list[np.ndarray]:
    """A softmax classifier with one hidden layer, by Adam, towards each row's distribution."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(len(x), 512))
        h = np.maximum(x[rows] @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
        dh = (d @ w[2].T) * (h > 0)
        for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def logits(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    """The classifier's scores of every partition."""
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def _log_shares(x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
    z = logits(x, w)
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Router:
    """The classifiers, how many partitions a query probes, and what the sample showed.

    subs has a classifier for each part of the first one, all with as many parts, or nothing.
    """

    weights: list[np.ndarray] | None
    parts: int
    probes: int
    sample_recall: float
    subs: list[list[np.ndarray]] | None = None

    def ranked(self, x: np.ndarray, take: int | None = None) -> np.ndarray:
        """The `take` likeliest partitions of each unit vector (all if None), likeliest first."""
        if self.weights is None:
            return np.zeros((len(x), 1), np.int64)
        z = _log_shares(x, self.weights)
        if self.subs:
            z = np.concatenate([z[:, [p]] + _log_shares(x, w) for p, w in enumerate(self.subs)], axis=1)
        if take == 1:
            return z.argmax(axis=1)[:, None]
        return np.argsort(-z, axis=1, kind="stable")[:, :take]


def _levels(rows: float, sample: int, least: int, most: int, rows_a_part: int) -> int:
    """Bisections that give parts of about rows_a_part rows, within bounds and with 16 sampled rows a part."""
    wanted = max(least, min(most, rows / rows_a_part))
    return max(0, min(round(np.log2(wanted)), int(np.log2(max(1, sample // 16)))))


def _learnt(x: np.ndarray, levels: int, s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """A classifier into 2 ** levels parts, and the neighbour graph it was learnt from."""
    graph = neighbour_graph(x, min(s.graph_k, len(x) - 1))
    label, parts = balanced_parts(graph, levels), 1 << levels
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1
    return train_router(x, target / target.sum(1, keepdims=True)), graph


def fit_router(x: np.ndarray, rows: int, k: int, s: Settings = Settings(), subs=None) -> Router:
    """From a sample of unit vectors and the number of rows to be placed.

    subs(router, levels) gives a classifier for each part, learnt from that part's rows; it is
    asked only where most_parts parts would hold over rows_a_part rows each.
    """
    levels = _levels(rows, len(x), s.least_parts, s.most_parts, s.rows_a_part)
    if levels == 0:
        return Router(None, 1, 1, 1.0)
    weights, graph = _learnt(x, levels, s)
    made = Router(weights, 1 << levels, 1 << levels, 1.0)
    more = _levels(rows / made.parts, s.sub_sample, 1, s.most_sub_parts, s.rows_a_part) if made.parts >= s.most_parts else 0
    if more and subs:
        made.subs = subs(made, more)
        made.parts <<= more
    near = graph[:, : min(k, graph.shape[1])]
    hits, home = np.zeros(made.parts, np.int64), np.concatenate([made.ranked(x[i : i + 1024], 1)[:, 0] for i in range(0, len(x), 1024)])
    for i in range(0, len(x), 256):
        ranked = made.ranked(x[i : i + 256])
        place = np.empty_like(ranked)
        np.put_along_axis(place, ranked, np.arange(made.parts)[None, :].repeat(len(ranked), 0), axis=1)
        met = place[np.arange(len(ranked))[:, None], home[near[i : i + 256]]]  # at which probe each neighbour is met
        hits += np.bincount(met.ravel(), minlength=made.parts)
    share = np.cumsum(hits) / near.size
    made.probes = next((p for p, r in enumerate(share.tolist(), 1) if r >= s.recall and p > 1), made.parts)
    made.sample_recall = float(share[made.probes - 1])
    return made


def sub_classifiers(index: DataFrame, s: Settings):
    """For fit_router: classifiers of the parts, each learnt in a task of its own from sub_sample rows of smallest hash.

    The driver gets most_parts sets of weights of a fixed size.
    """

    def learn(router: Router, levels: int) -> list[list[np.ndarray]]:
        placed = _packed(index, router, 1, ["id"])
        chosen = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("id", "v"), "id"))  # limited before its shuffle
        some = placed.withColumn("n", chosen).where(F.col("n") <= s.sub_sample).select("part", "v")

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            x = _unit(np.frombuffer(b"".join(rows["v"].sort_values()), np.float64).reshape(len(rows), -1))
            w = _learnt(x, levels, s)[0] if len(x) >= 16 << levels else _blind(x.shape[1], 1 << levels)
            return pd.DataFrame({"part": [rows["part"].iloc[0]], "w": [pickle.dumps([a.astype(np.float32) for a in w])]})

        got = {r["part"]: [a.astype(np.float64) for a in pickle.loads(r["w"])] for r in some.groupBy("part").applyInPandas(one, "part int, w binary").collect()}
        dim = router.weights[0].shape[0]
        return [got.get(p) or _blind(dim, 1 << levels) for p in range(router.parts)]

    return learn


def _blind(dim: int, parts: int) -> list[np.ndarray]:
    """A classifier that finds all parts equally likely, for parts of few rows: all of them go to the first."""
    return [np.zeros((dim, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts)]


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # else squares of tiny or huge components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) rows that take part, without repeats."""
    v = F.col("v")
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    )
    # the modal length is one row
    size = good.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    # -0.0 and 0.0 are one component
    return good.join(F.broadcast(size), F.size(v) == F.col("d")).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def _packed(rows: DataFrame, router: Router, take: int, others: list[str]) -> DataFrame:
    """rows with v as bytes and part, once for each of the `take` likeliest partitions."""
    fields = [rows.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("v", T.BinaryType()), T.StructField("part", T.IntegerType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("v")
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            part = router.ranked(_unit(x), take)
            n = part.shape[1]
            keep = np.repeat(np.arange(batch.num_rows), n)
            cols = [batch.column(batch.schema.get_field_index(c)).take(pa.array(keep)) for c in others]
            packed = [r.tobytes() for r in x]
            return pa.RecordBatch.from_arrays([*cols, pa.array([packed[i] for i in keep], pa.binary()), pa.array(part.ravel().astype(np.int32))], names=schema.names)

        return step

    return map_arrow(rows.select(*others, "v"), make, schema)


def _nearest(k: int):
    """Of one block of rows and one of queries: each query's k nearest, exactly scored."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(rows), -1)
            q = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(len(queries), -1)
            ids, qids, ux = rows["id"].to_numpy(), queries["qid"].to_numpy(), _unit(x).T
            xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for i in range(0, len(q), 256):
                s = _unit(q[i : i + 256]) @ ux
                m = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - m, axis=1)[:, -m] - 1e-9
                a, b = np.nonzero(s >= floor[:, None])
                exact = (q[i + a] * x[b]).sum(axis=1) / (qn[i + a] * xn[b])
                odd = ~np.isfinite(exact)
                exact[odd] = s[a[odd], b[odd]]
                order = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                kept = rank < k
                out["qid"].append(qids[i + a[kept]])
                out["vec_id"].append(ids[b[kept]])
                out["score"].append(exact[kept])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, float if c == "score" else np.int64) for c, v in out.items()})

    return run


def search(rows: DataFrame, query_ids, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which query_ids(id column) holds."""
    return search_with_router(rows, query_ids, k=k, id_col=id_col, vector_col=vector_col, settings=settings)[0]


def search_with_router(rows: DataFrame, query_ids, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> tuple[DataFrame, Router, float]:
    """search(), its router and the share of the distinct vectors that a query was compared with on average."""
    good = written(usable(rows, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # limited before its shuffle
    index = written(good.withColumn("n", first).where(F.col("n") <= k + 1).drop("n"), "index")
    asked = good.where(query_ids(F.col("id")))
    queries = written(asked.groupBy("v").agg(F.min("id").alias("qid")), "queries")
    sample = index.orderBy(F.xxhash64("id", "v"), "id").limit(settings.sample).collect()
    n = index.count()
    if sample:
        small_batches(rows.sparkSession)
        router = fit_router(_unit(np.array([r["v"] for r in sorted(sample)])), n, k, settings, sub_classifiers(index, settings))
    else:
        router = Router(None, 1, 1, 1.0)
    placed = written(_packed(index, router, 1, ["id"]), "placed")
    routed = written(_packed(queries, router, router.probes, ["qid"]), "routed")
    # two rows a partition: bounded by most_parts * most_sub_parts
    size = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    asks: dict[int, int] = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    scanned = sum(m * asks.get(p, 0) for p, m in size.items()) / max(1, n * queries.count())
    blocks = [(p, -(-m // settings.block_rows), -(-asks.get(p, 0) // settings.block_queries)) for p, m in size.items()]
    table = rows.sparkSession.createDataFrame(blocks, "part int, row_blocks int, query_blocks int")
    left = placed.join(F.broadcast(table), "part").where("query_blocks > 0")
    left = left.select("part", F.expr("pmod(xxhash64(id, v), cast(row_blocks as bigint))").alias("i"), F.expr("explode(sequence(0L, cast(query_blocks - 1 as bigint)))").alias("j"), "id", "v")
    right = routed.join(F.broadcast(table), "part")
    right = right.select("part", F.expr("explode(sequence(0L, cast(row_blocks - 1 as bigint)))").alias("i"), F.expr("pmod(xxhash64(qid, v), cast(query_blocks as bigint))").alias("j"), "qid", "v")
    keys = ["part", "i", "j"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _nearest(k + 1)(a, b), "qid long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    found = met.withColumn("n", best).where(F.col("n") <= k + 1).drop("n")
    named = asked.join(queries, "v").select(F.col("id").alias("query_id"), "qid")
    others = named.join(found, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), router, scanned
