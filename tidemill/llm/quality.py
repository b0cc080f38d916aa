"""Rule bitmask ledger for document quality.

One pass measures every text and evaluates every rule once: the ledger holds the
measurements and one bit per failed rule. A policy is a named, versioned mask over those
bits, so a new policy, its verdicts and the ablation of each rule (what it alone rejects)
are bitwise expressions over the ledger and never touch a text again.

Words are runs of bytes other than space and U+0009..U+000D. Defined results: a null text
has no words; a text without words measures zero everywhere and fails the rules that ask
for words; null ids stay null; repeated rows give repeated ledger rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SPACES = " \t\n\v\f\r"


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    words = text.encode().split()  # bytes.split() cuts at exactly the six spaces
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), echoes


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a WINDOW-word window that is found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measures, is true. Its bit never changes."""

    name: str
    bit: int
    fails: str


#: Bits are append-only: a ledger written earlier stays readable.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_words", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("long_words", 4, "word_chars > 25 * n_words"),
    Rule("short_words", 5, "word_chars < 2 * n_words"),
    Rule("echoed_words", 6, "10 * n_echo_words > 3 * n_words"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_words", "duplicate_lines", "long_words", "short_words", "echoed_words"),
}


def mask(policy: str) -> int:
    """The policy's bits."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in POLICIES[policy])


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the MEASURES) of every whole text."""
    texts = texts_of(docs, id_col, text_col)
    schema = T.StructType([texts.schema[0], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = zip(*(measure(x) for x in batch.column(1).to_pylist()))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found)], names=[batch.schema.names[0], *MEASURES])

        return step

    return map_arrow(texts, make, schema)


def failure_bits() -> Column:
    """Every rule, evaluated once, as one long."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures, failed_rules long): the table that policies are applied to."""
    return measured(docs, id_col=id_col, text_col=text_col).withColumn("failed_rules", failure_bits())


def keep(docs: DataFrame, policy: str = "v1", *, text_col: str = "text") -> DataFrame:
    """docs (every column, as they are) without the documents that the policy rejects.

    Texts are measured where they lie: no shuffle and no join. Columns may have any names,
    those of measures too.
    """
    names = docs.columns
    held = [f"c{i}" for i in range(len(names))]
    at = names.index(text_col)
    source = docs.toDF(*held)
    schema = T.StructType([*source.schema, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = zip(*(measure(x or "") for x in batch.column(at).to_pylist()))
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in found)], names=schema.names)

        return step

    rows = map_arrow(source, make, schema).withColumn("failed_rules", failure_bits())
    return rows.where(~rejects(policy)).select(*(F.col(h).alias(n) for h, n in zip(held, names)))


def rejects(policy: str) -> Column:
    """True for ledger rows that the policy rejects."""
    return F.col("failed_rules").bitwiseAND(F.lit(mask(policy))) != 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, failed, only_this): documents that fail it, and that no other rule of the policy rejects.

    One aggregation over the bits; an empty ledger gives zeros.
    """
    m = mask(policy)
    hit = F.col("failed_rules").bitwiseAND(F.lit(m))
    own = [r for r in RULES if r.name in POLICIES[policy]]
    sums = rows.agg(
        *(F.sum(F.when(hit.bitwiseAND(F.lit(1 << r.bit)) != 0, 1).otherwise(0)).alias(f"f{r.bit}") for r in own),
        *(F.sum(F.when(hit == (1 << r.bit), 1).otherwise(0)).alias(f"o{r.bit}") for r in own),
    )
    stacked = ", ".join(f"'{r.name}', coalesce(f{r.bit}, 0), coalesce(o{r.bit}, 0)" for r in own)
    return sums.select(F.expr(f"stack({len(own)}, {stacked}) as (rule, failed, only_this)"))
