"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, language, source. A token budget flows down it. At every node
the children get shares by weight, but none more than its subtree can supply (its tokens
times the permitted epochs); what a short child leaves is shared among its siblings by
weight, and only what a whole subtree cannot take goes back to its parent's siblings. Each
leaf then reads its documents in seeded epochs: a fresh order for every epoch, by the MD5 of
seed, epoch and id. Whole epochs take every document, the last one a token-prefix: documents
as long as the tokens before them are fewer than what is left of the budget.

The prefix needs no global sort: tokens are summed by leaf and by the first hexadecimal
digits of the order key, running sums over these few buckets find the bucket in which the
budget ends, the same is done within that bucket by the next digits, only what is left is
ordered (one in 16 ** (2 * bucket_hex) of a leaf), and the last key taken is all that is sent
back: the selection itself is a filter.

Defined results: null domain, language or source is the empty text; nodes without a weight
have `other` as weight; weight 0 takes nothing. Null text has no tokens. Rows of equal id
have equal keys and are taken together. Documents without tokens come with their epoch or
prefix. An empty table gives no rows. Shares are rounded down, less than a token a node.
Columns may have any names; where rows have an `epoch` already, the new one is `epoch_`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by level and name, the budget as a share of all tokens, epochs and seed."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 1
    budget_num: int = 1
    budget_den: int = 2
    max_epochs: int = 1
    seed: str = "mix"
    bucket_hex: int = 3
    max_leaves: int = 100_000

    def weight(self, level: int, name: str) -> int:
        """A node's weight among its siblings."""
        return self.weights.get(LEVELS[level], {}).get(name, self.other)


def share_out(budget: int, children: Iterable[tuple[str, int, int]]) -> dict[str, int]:
    """Budgets of (name, weight, capacity) children; a short child's rest goes to its siblings."""
    order = sorted((c for c in children if c[1] > 0), key=lambda c: (Fraction(c[2], c[1]), c[0]))
    weight, out = sum(w for _, w, _ in order), {}
    for i, (name, w, cap) in enumerate(order):
        if cap * weight > w * budget:
            out |= {n: w_ * budget // weight for n, w_, _ in order[i:]}
            break
        out[name] = cap
        budget, weight = budget - cap, weight - w
    return out


def budgets(leaves: Mapping[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Token budget of every leaf, from the leaves' tokens."""
    total = sum(leaves.values())

    def down(budget: int, paths: list[tuple[str, ...]], level: int) -> dict[tuple[str, ...], int]:
        if level == len(LEVELS):
            return {paths[0]: budget}
        below: dict[str, list[tuple[str, ...]]] = {}
        for p in paths:
            below.setdefault(p[level], []).append(p)
        shares = share_out(budget, [(n, mix.weight(level, n), mix.max_epochs * sum(leaves[p] for p in ps)) for n, ps in below.items()])
        out: dict[tuple[str, ...], int] = {}
        for n, ps in below.items():
            out |= down(shares.get(n, 0), ps, level + 1)
        return out

    return down(total * mix.budget_num // mix.budget_den, sorted(leaves), 0) if leaves else {}


def order_key(seed: str, epoch: Column, id_col: Column) -> Column:
    """A document's place in an epoch: hexadecimal MD5 of seed:epoch:id."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def tokens(text: Column) -> Column:
    """Words: runs of what is neither space nor U+0009..U+000D."""
    spaces = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # words begin where a space, or the beginning, is followed by something else
    return F.regexp_count(spaces, F.lit("[^ ]+")).cast("long")


def leaf_columns(docs: DataFrame, domain: Column, *, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> list[Column]:
    """id and the three levels, without nulls in the levels."""
    return [F.col(id_col), *(F.coalesce(c, F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col(lang_col), F.col(source_col))))]


def plan(measured: DataFrame, mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """(domain, lang, source, budget, full, cut) of every leaf.

    `full` whole epochs, then the documents of epoch `full` whose order key is at most `cut`
    (null: none). measured holds id_col, the levels and n_tokens. The leaf table is collected:
    a row a leaf, refused beyond `max_leaves`.
    """
    spark = measured.sparkSession
    rows = measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).limit(mix.max_leaves + 1).collect()
    if len(rows) > mix.max_leaves:
        raise ValueError(f"more than {mix.max_leaves} leaves")
    supply = {tuple(r[:3]): r["n"] or 0 for r in rows}
    given = budgets(supply, mix)
    table = [(*p, b, b // supply[p] if supply[p] else int(b > 0), b % supply[p] if supply[p] else 0) for p, b in given.items()]
    leaves = spark.createDataFrame(table, "domain string, lang string, source string, budget long, full int, rest long")
    keyed = measured.join(F.broadcast(leaves.where("rest > 0")), list(LEVELS)).select(*LEVELS, "rest", "n_tokens", order_key(mix.seed, F.col("full"), F.col(id_col)).alias("key"))
    inside = keyed.withColumn("before", F.lit(0).cast("long"))
    for step in (1, 2):
        bucketed = inside.withColumn("bucket", F.substring("key", 1, step * mix.bucket_hex))
        sums = bucketed.groupBy(*LEVELS, "rest", "before", "bucket").agg(F.sum("n_tokens").alias("n"))
        run = Window.partitionBy(*LEVELS).orderBy("bucket")  # at most 16 ** bucket_hex rows a leaf
        last = sums.withColumn("upto", F.col("before") + F.sum("n").over(run)).where("upto >= rest and upto - n < rest")
        last = last.select(*LEVELS, "bucket", (F.col("upto") - F.col("n")).alias("next"))  # a row a leaf
        inside = bucketed.join(F.broadcast(last), [*LEVELS, "bucket"]).drop("bucket", "before").withColumnRenamed("next", "before")
    inside = inside.groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("key")
    cuts = inside.withColumn("upto", F.col("before") + F.sum("n").over(run)).where("upto >= rest").groupBy(*LEVELS).agg(F.min("key").alias("cut"))
    return leaves.join(F.broadcast(cuts), list(LEVELS), "left").select(*LEVELS, "budget", "full", "cut")


def select(rows: DataFrame, leaves: DataFrame, mix: Mix, levels: list[Column], id_col: str = "doc_id", with_epoch: bool = True) -> DataFrame:
    """rows (every column) once for each epoch that takes them, with `epoch`; a filter, no shuffle.

    levels: the columns that give rows their domain, language and source. Without with_epoch
    the columns are those of rows.
    """
    held = [f"c{i}" for i in range(len(rows.columns))]
    placed = rows.select(*(F.col(f"`{n}`").alias(h) for n, h in zip(rows.columns, held)), *(c.alias(f"_{n}") for n, c in zip(LEVELS, levels)))
    leaf = leaves.select(*(F.col(n).alias(f"_{n}") for n in LEVELS), "full", "cut")
    every = placed.join(F.broadcast(leaf), [f"_{n}" for n in LEVELS]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    key = order_key(mix.seed, F.col("epoch"), F.col(held[rows.columns.index(id_col)]))
    taken = every.where((F.col("epoch") < F.col("full")) | (key <= F.col("cut")))
    name = "epoch"
    while name in [n.lower() for n in rows.columns]:
        name += "_"
    return taken.select(*(F.col(h).alias(n) for n, h in zip(rows.columns, held)), *([F.col("epoch").alias(name)] if with_epoch else []))
