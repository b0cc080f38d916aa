"""The registered queries of the cleansing operators over the messy order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import FIELDS
from ..functions.rules import Steps, field_rule, layered
from ..operators import evidence, validate
from ..operators.dedupe import resolve
from ..operators.fuzzy import candidates
from ..operators.invariants import violations
from ..operators.normalize import evidence_rows, normalize
from . import messy, scans
from .pipeline import validated

Query = Callable[[SparkSession, str], DataFrame]
_REF = ["_source_file", "_source_row"]


def _frame(spark: SparkSession, d: str, role: str) -> DataFrame:
    return normalize(messy.cells(spark, d, role), role)


def _bundle(spark: SparkSession, d: str) -> validate.Validated:
    return validated({r: messy.cells(spark, d, r) for r in FIELDS}, messy.AS_OF)[0]


def _disposed(spark: SparkSession, d: str) -> DataFrame:
    """Sales rows with dispositions, without the columns that only evidence needs."""
    sales, customers, products = (validate.slim(_frame(spark, d, r)) for r in FIELDS)
    c, p = validate.prepare_reference(customers, "customers", messy.AS_OF), validate.prepare_reference(products, "products", messy.AS_OF)
    return validate.dispose(sales, c, p, messy.AS_OF)


def _scalar(role: str, field: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = Steps("_x")
        outcome = field_rule(field, F.col(field), t)
        rows = layered(messy.cells(spark, d, role).select(*_REF, field), [t])
        return rows.select(*_REF, outcome["value"].alias("value"), outcome["event"].alias("event"), outcome["issue"].alias("issue"))

    return query


def norm_events(spark: SparkSession, d: str) -> DataFrame:
    """Every normalization event of all three roles."""
    parts = [evidence_rows(_frame(spark, d, r), r, "events") for r in FIELDS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("record_type", *_REF, "field", "code", "original", "cleaned", "message")


def norm_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Normalization defects by role and code."""
    out = None
    for role in FIELDS:
        part = evidence_rows(_frame(spark, d, role), role, "issues").groupBy("record_type", "code").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def hard_failures(spark: SparkSession, d: str) -> DataFrame:
    """All failures of each failing sales row, in priority order, and the first."""
    rows = validate.checked(_frame(spark, d, "sales"), messy.AS_OF).where(F.size("failures") > 0)
    codes = F.transform("failures", lambda x: x["code"])
    return rows.select(*_REF, F.array_join(codes, "|").alias("codes"), F.get(codes, F.lit(0)).alias("primary_code"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    sales = _frame(spark, d, "sales")
    rows = validate.checked(sales, messy.AS_OF).where(F.size("failures") == 0).select(*sales.columns)
    return resolve(rows, "order_id", list(FIELDS["sales"]))


def dedupe_status(spark: SparkSession, d: str) -> DataFrame:
    """Survivors, duplicates and conflicts among rows that pass the hard checks."""
    return _resolved(spark, d).select(*_REF, "status", F.col("survivor.file").alias("survivor_file"), F.col("survivor.row").alias("survivor_row"))


def dedupe_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Order ids whose rows disagree, with their number of rows."""
    return _resolved(spark, d).where("status = 'CONFLICT'").groupBy("order_id").agg(F.count("*").alias("n"))


def _reference(role: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = validate.prepare_reference(_frame(spark, d, role), role, messy.AS_OF)
        return rows.select(*_REF, "disposition", "primary_rule_code", F.col("survivor.file").alias("survivor_file"), F.col("survivor.row").alias("survivor_row"))

    return query


def fk_codes(spark: SparkSession, d: str) -> DataFrame:
    """Unknown references of surviving rows."""
    c, p = (validate.prepare_reference(_frame(spark, d, r), r, messy.AS_OF) for r in ("customers", "products"))
    rows = validate.unknown_references(_resolved(spark, d).where("status = 'SURVIVOR'"), c, p)
    return rows.where("no_customer or no_product").select(*_REF, "no_customer", "no_product")


def accepted_sales(spark: SparkSession, d: str) -> DataFrame:
    """The accepted rows in the cleaned schema: the flagship."""
    return evidence.cleaned_rows(_disposed(spark, d))


def _bucket(disposition: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _disposed(spark, d).where(F.col("disposition") == disposition)
        return rows.select(*_REF, F.array_join("rule_codes", "|").alias("rule_codes"), "primary_rule_code", F.col("survivor.file").alias("survivor_file"), F.col("survivor.row").alias("survivor_row"))

    return query


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Transaction counts and whether they add up."""
    return validate.reconciliation(_disposed(spark, d))


def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reference counts by table."""
    return validate.reference_counts({r: validate.prepare_reference(validate.slim(_frame(spark, d, r)), r, messy.AS_OF) for r in ("customers", "products")})


def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate customer names, exactly scored."""
    c = validate.prepare_reference(_frame(spark, d, "customers"), "customers", messy.AS_OF)
    return candidates(validate.usable(c)).select("left_id", "right_id", "common", "total")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """The whole audit log in its frozen order."""
    return evidence.audit_log(_bundle(spark, d))


def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all three roles that were not accepted, with every raw value and reasons."""
    return evidence.rejected_rows(_bundle(spark, d))


def _counts(normalization: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return evidence.code_counts(evidence.audit_events(_bundle(spark, d)), normalization)

    return query


def disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows of all roles by disposition."""
    return evidence.disposition_counts(evidence.rejected_rows(_bundle(spark, d)))


def summary_shares(spark: SparkSession, d: str) -> DataFrame:
    """Dispositions with their share of the input as text."""
    counts = validate.reconciliation(_disposed(spark, d))
    rows = counts.selectExpr("input", "stack(3, 'accepted', accepted, 'quarantined', quarantined, 'deduplicated', deduplicated) as (disposition, n)")
    return rows.select("disposition", "n", evidence.share_text(F.col("n"), F.col("input")).alias("share"))


def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants (none), beside the number of rows that were checked."""
    v, sales = validated({r: messy.cells(spark, d, r) for r in FIELDS}, messy.AS_OF)
    checked = sales.agg(F.lit("rows_checked").alias("invariant"), F.count("*").alias("n"))
    return violations(v, sales).unionByName(checked)


QUERIES: dict[str, Query] = {
    "accepted_sales": accepted_sales,
    "quarantined_sales": _bucket("QUARANTINED"),
    "deduplicated_sales": _bucket("DEDUPLICATED"),
    "norm_identifier": _scalar("sales", "order_id"),
    "norm_customer_identifier": _scalar("sales", "customer_id"),
    "norm_quantity": _scalar("sales", "quantity"),
    "norm_currency": _scalar("sales", "unit_price_eur"),
    "norm_date": _scalar("sales", "order_date"),
    "norm_country": _scalar("sales", "country"),
    "norm_text": _scalar("customers", "customer_name"),
    "norm_email": _scalar("customers", "email"),
    "norm_category": _scalar("products", "category"),
    "norm_events": norm_events,
    "norm_issue_counts": norm_issue_counts,
    "hard_failures": hard_failures,
    "dedupe_status": dedupe_status,
    "dedupe_conflicts": dedupe_conflicts,
    "reference_customers": _reference("customers"),
    "reference_products": _reference("products"),
    "fk_codes": fk_codes,
    "reconciliation": reconciliation,
    "reference_counts": reference_counts,
    "fuzzy_candidates": fuzzy_candidates,
    "audit_log": audit_log,
    "rejected_rows": rejected_rows,
    "rule_counts": _counts(False),
    "normalization_counts": _counts(True),
    "csv_scan": scans.csv_scan,
    "xlsx_scan": scans.xlsx_scan,
    "input_file_digests": scans.input_file_digests,
    "disposition_counts": disposition_counts,
    "summary_shares": summary_shares,
    "invariant_violations": invariant_violations,
}
