"""URL filters by Bloom filter cascades: exact membership without joins.

A list of keys is encoded in level 0, the keys of the corpus that level 0 takes for listed
by mistake in level 1, the listed keys that level 1 takes for mistakes in level 2, and so on
until nothing is mistaken. Asked about any key of that universe, the first level that denies
the key decides, so the answer is exact. Level 0 is made so tight (share of mistakes about
0.7 * listed / unlisted) that what later levels hold is bounded by the list, not the corpus.

The universe is every key a URL of the corpus can ask about: each suffix of its host at a
label border, joined to each prefix of its path as long as some rule's path, and each host
label. It is gathered in full by a distributed distinct; only mistakes reach the driver.

Defined results: null URLs and URLs without `://` have empty host and path and ask about no
rule; the verdict is then `allow`. A path that is empty does not start with `/`. Of rules
of equal length the smaller text wins. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Bloom:
    """Bits for n keys with k probes each; level salts the hash."""

    level: int
    k: int
    bits: np.ndarray

    @classmethod
    def of(cls, keys: Sequence[str], rate: float, level: int) -> Bloom:
        k = max(1, math.ceil(-math.log2(rate)))
        m = max(64, math.ceil(len(keys) * k / math.log(2)))
        made = cls(level, k, np.zeros(m, bool))
        for x in keys:
            made.bits[made._at(x)] = True
        return made

    def _at(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), seed=self.level)
        a, b, m = h >> 64, h & (1 << 64) - 1 | 1, len(self.bits)
        return [(a + i * b) % m for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        return bool(self.bits[self._at(key)].all())


@dataclass
class Cascade:
    """Alternating levels; exact for every key of the universe that it was built on."""

    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def first_level(listed: Sequence[str], unlisted: int) -> Bloom:
    """Level 0, as tight as keeps the expected mistakes below the list's size."""
    rate = min(0.5, math.sqrt(0.5) * len(listed) / max(1, unlisted))
    return Bloom.of(listed, rate, 0)


def build(listed: Iterable[str], unlisted: int, mistaken: Callable[[Bloom], Sequence[str]]) -> Cascade:
    """mistaken(level 0): the universe's unlisted keys that level 0 holds, from a scan of them all."""
    keys = sorted(set(listed))
    if not keys:
        return Cascade()
    made = Cascade([first_level(keys, unlisted)])
    inside, outside = keys, sorted(mistaken(made.levels[0]))
    while outside:
        made.levels.append(Bloom.of(outside, 0.5, len(made.levels)))
        inside, outside = outside, [x for x in inside if x in made.levels[-1]]
    return made


@dataclass(frozen=True)
class Rules:
    """Rules as host and path in one text, like `example.com/en/`; and blocked host labels."""

    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    blocked_labels: tuple[str, ...] = ()

    def prefixes(self) -> list[int]:
        """Lengths of the rules' paths."""
        return sorted({len(r) - len(r.partition("/")[0]) for r in (*self.allow, *self.block)})


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_keys(host: str, path: str, prefixes: list[int]) -> list[str]:
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [s + path[:n] for s in suffixes for n in prefixes if n <= len(path)]


def _label_keys(host: str) -> list[str]:
    return [f"label:{x}" for x in set(host.split(".")) if x]


def universe(sites: DataFrame, rules: Rules) -> DataFrame:
    """Distinct keys (kind, key) that (host, path) rows can ask about."""
    prefixes = rules.prefixes()
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = {("rule", k) for h, p in set(zip(hosts, paths)) for k in _rule_keys(h, p, prefixes)}
            keys |= {("label", k) for h in set(hosts) for k in _label_keys(h)}
            kinds, names = zip(*sorted(keys)) if keys else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["kind", "key"])

        return step

    longest = max(prefixes, default=0)
    short = sites.select("host", F.substring("path", 1, longest).alias("path"))
    return map_arrow(short.distinct(), make, schema).distinct()


def cascades(keys: DataFrame, rules: Rules) -> tuple[Cascade, Cascade, Cascade]:
    """For allowed rules, blocked rules and blocked labels, over the written universe `keys`."""
    counts = {r["kind"]: r["n"] for r in keys.groupBy("kind").agg(F.count("*").alias("n")).collect()}

    def one(kind: str, listed: tuple[str, ...]) -> Cascade:
        def mistaken(level: Bloom) -> list[str]:
            sent, known = keys.sparkSession.sparkContext.broadcast(level), set(listed)  # of the list's size

            def make():
                def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([x for x in batch.column(0).to_pylist() if x not in known and x in sent.value], pa.string())], names=["key"])

                return step

            found = map_arrow(keys.where(F.col("kind") == kind).select("key"), make, T.StructType([T.StructField("key", T.StringType())]))
            return [r["key"] for r in found.collect()]  # about as many as are listed, by level 0's rate

        return build(listed, counts.get(kind, 0), mistaken)

    return one("rule", rules.allow), one("rule", rules.block), one("label", tuple(f"label:{x}" for x in rules.blocked_labels))


def judge(pages: DataFrame, rules: Rules, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every URL."""
    sites = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    allow, block, labels = cascades(written(universe(sites.select("host", "path"), rules), "url-keys"), rules)
    sent = pages.sparkSession.sparkContext.broadcast((allow, block, labels))  # of the lists' size
    prefixes = rules.prefixes()
    schema = T.StructType([*sites.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def make():
        allow, block, labels = sent.value
        memo: dict[str, bool] = {}

        def blocked(host: str) -> bool:
            if host not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[host] = any(k in labels for k in _label_keys(host))
            return memo[host]

        def one(host: str, path: str) -> tuple[str | None, str]:
            for key in sorted(_rule_keys(host, path, prefixes), key=lambda k: (-len(k), k)):
                if key in allow:
                    return key, "allow"
                if key in block:
                    return key, "block"
            return None, "block" if blocked(host) else "allow"

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=schema.names)

        return step

    return map_arrow(sites, make, schema)
