"""Normalization of one role's frame: values, evidence arrays, unchanged row count.

Input: provenance columns and one cell (see functions.rules) for each field. Output: the
provenance, each field's value as a string, raw_<field> as evidence prints it, and two arrays
on the row itself, so that no later step has to join evidence to rows:
events STRUCT<field, code, original, cleaned> and issues STRUCT<field, code, action, original,
value, reason>. Sentences are made where evidence becomes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import FIELDS, FLAGS, PROVENANCE
from ..functions.rules import Steps, fenced, field_rule, layered, shown_original


def _present(entries: list[Column]) -> Column:
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def normalize(cells: DataFrame, role: str) -> DataFrame:
    """Every field by its rule.

    Lowers the session's hugeMethodLimit to what the JIT compiles: one generated method for
    all rules would otherwise run interpreted.
    """
    conf, limit = cells.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    if int(conf.get(limit, "65535")) > 8000:
        conf.set(limit, "8000")
    fields = FIELDS[role]
    steps = [Steps(f"_{f}") for f in fields]
    outcome = {f: field_rule(f, F.col(f), t) for f, t in zip(fields, steps)}
    frame = layered(cells.select(*PROVENANCE, *fields), steps)
    frame = frame.select(*PROVENANCE, *(outcome[f].alias(f"_r_{f}") for f in fields), *(shown_original(F.col(f)).alias(f"raw_{f}") for f in fields))
    events, issues = [], []
    for f in fields:
        r, original = F.col(f"_r_{f}"), F.col(f"raw_{f}")
        events.append(
            F.when(
                r["event"].isNotNull(),
                F.struct(
                    F.lit(f).alias("field"), r["event"].alias("code"), original.alias("original"), F.coalesce(r["value"], F.lit("")).alias("cleaned"),
                ),
            )
        )
        issues.append(
            F.when(
                r["issue"].isNotNull(),
                F.struct(
                    F.lit(f).alias("field"), r["issue"].alias("code"), F.when(r["issue"].isin(*FLAGS), "FLAG").otherwise("VALIDATION_FAILURE").alias("action"),
                    original.alias("original"), F.coalesce(r["value"], F.lit("")).alias("value"), r["reason"].alias("reason"),
                ),
            )
        )
    out = frame.select(
        *PROVENANCE,
        *(F.col(f"_r_{f}")["value"].alias(f) for f in fields),
        *(f"raw_{f}" for f in fields),
        _present(events).alias("events"),
        _present(issues).alias("issues"),
    )
    return fenced(out, *fields, "events", "issues")


def evidence_rows(normalized: DataFrame, role: str, kind: str) -> DataFrame:
    """The events or issues of a frame, one row each, with role and provenance."""
    said = event_message if kind == "events" else issue_message
    return normalized.select(F.lit(role).alias("record_type"), *PROVENANCE, F.explode(kind).alias("e")).select("record_type", *PROVENANCE, "e.*", said(F.col("e")).alias("message"))


def event_message(e: Column) -> Column:
    """The sentence of a normalization event."""
    return F.concat(F.lit("Normalized "), e["field"], F.lit(" using "), e["code"], F.lit("."))


def issue_message(e: Column) -> Column:
    """The sentence of a normalization defect."""
    return F.concat(e["code"], F.lit(" for "), e["field"], F.lit(": "), e["reason"], F.lit("."))


def summary(frames: dict[str, DataFrame]) -> dict[str, object]:
    """Rows by role, and events and issues by code; one small aggregate each."""
    out: dict[str, object] = {"rows": {r: f.count() for r, f in frames.items()}}
    for kind in ("events", "issues"):
        rows = None
        for role, f in frames.items():
            part = evidence_rows(f, role, kind).select("code")
            rows = part if rows is None else rows.unionByName(part)
        out[kind] = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()} if rows is not None else {}
    return out
