"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_extract, mixing, quality, simhash, suffix_dedup, toxicity, url_filter, warc
from .common import written

#: Each source's domain; sources that are not listed are `other`.
DOMAINS = {
    "web": ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"),
    "reference": ("src8", "src9", "src10", "src11", "src12", "src13"),
    "forum": ("src14", "src15", "src16", "src17"),
}
#: Half of all tokens, at most three epochs of a source.
MIX = mixing.Mix(
    weights={"domain": {"web": 4, "reference": 5, "forum": 2}, "lang": {"en": 3, "de": 2, "fr": 2, "es": 2}},
    budget_num=1, budget_den=2, max_epochs=3, seed="tidemill",
)
#: The rules of the URL filter.
URL_RULES = url_filter.Rules(
    allow=("com/", "www.example.com/en/"),
    block=("example.com/en/", "net/es/", "net/fr/"),
    blocked_labels=("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"),
)


def tokenizer_file() -> str:
    """The rank file of the installed public vocabulary; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_pattern() -> str:
    """The split pattern that belongs to the rank file."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: Column) -> Column:
    """The domain of DOMAINS that a source belongs to."""
    found = F.lit("other")
    for name, sources in DOMAINS.items():
        found = F.when(source.isin(*sources), F.lit(name)).otherwise(found)
    return found


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and epoch that the mix takes."""
    docs = table(spark, sf_dir, "documents")
    leaf = mixing.leaf_columns(docs, domain_of(F.col("source")))
    rows = written(docs.select(*leaf, mixing.tokens(F.col("text")).alias("n_tokens")), "token-counts")
    leaves = mixing.plan(rows, MIX)
    return mixing.select(rows, leaves, MIX, [F.col(n) for n in mixing.LEVELS])


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated 200-byte strings are gone."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by fifty."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, lambda i: i % 50 == 0, k=5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over four-word shingles and its group at four bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        F.expr("cast(score >= 0.5 as int)").alias("predicted"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_file(), tokenizer_pattern()))


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger's measures, the base policy's verdict and policy v1's."""
    rows = written(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejects("base").alias("base_failed"),
        (~quality.rejects("v1")).alias("kept"),
        "failed_rules",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of policy v1 how many documents fail it, and how many it alone rejects."""
    return quality.ablation(written(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger"), "v1")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back through the capture index."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_html_main_text": op2_html_main_text,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_ledger": op9_quality_ledger,
    "op10_warc": op10_warc,
    "quality_ablation": quality_ablation,
}
