"""Dispositions: hard checks, duplicate resolution, foreign keys; one for every row.

The order is fixed: hard checks, duplicates among rows that pass them, references of the
survivors. Evidence is collected in an array on the row, STRUCT<order, stage, field, code,
action, original, related, message>; `order` and `stage` sort the reasons, the audit
log sorts by its own keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import AS_OF, FIELDS, HARD, KEY, PROVENANCE, RANK
from ..functions.rules import fenced
from ..functions.work import written
from .dedupe import resolve

_REF = "struct<file string, sheet string, row int>"
EVIDENCE = f"array<struct<step int, code_rank int, field string, code string, action string, original string, related {_REF}, message string>>"
#: Decimal text that is below zero, as a money reason reads a kept value.
_NEGATIVE = r"\A-(?=[0-9.]*[1-9])(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def _code_rank(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), code)


def evidence(step: int, code: Column, field: Column, action: Column, message: Column, original: Column | None = None, related: Column | None = None) -> Column:
    """One entry of a row's evidence."""
    return F.struct(
        F.lit(step).alias("step"), _code_rank(code).alias("code_rank"), field.alias("field"), code.alias("code"), action.alias("action"),
        (F.lit("") if original is None else F.coalesce(original, F.lit(""))).alias("original"),
        (F.lit(None) if related is None else related).cast(_REF).alias("related"), message.alias("message"),
    )


def hard_reason(code: Column, field: Column, value: Column, as_of: str) -> Column:
    """The sentence that explains a hard failure."""
    return (
        F.when(code.startswith("MISSING_"), F.concat(field, F.lit(" is missing.")))
        .when(code == "INVALID_IDENTIFIER", F.concat(field, F.lit(" violates the bounded identifier pattern.")))
        .when(code == "INVALID_ORDER_DATE", "order_date is missing, unparseable, or impossible.")
        .when(code == "FUTURE_ORDER_DATE", f"order_date is later than the frozen demo date {as_of}.")
        .when(code == "INVALID_QUANTITY", "quantity is missing, non-integer, or not greater than zero.")
        .when(value.rlike(_NEGATIVE), F.concat(F.lit("unit_price_eur is negative ("), value, F.lit(").")))
        .otherwise("unit_price_eur is missing, malformed, ambiguous, or over-precise.")
    )


def has_issue(field: str) -> Column:
    """Whether normalization found a defect in the field."""
    return F.exists("issues", lambda x: x["field"] == field)


def hard_failures(as_of: str = AS_OF) -> Column:
    """ARRAY<STRUCT<rank, tie, code, field, value, reason, origin>> of a normalized sales row, in priority order."""

    def entry(code: Column, field: Column, value: Column, origin: str) -> Column:
        tie = F.when(code == "INVALID_IDENTIFIER", F.array_position(F.array(*(F.lit(f) for f in FIELDS["sales"][:3])), field)).otherwise(0).cast("int")
        return F.struct(_code_rank(code).alias("rank"), tie.alias("tie"), code.alias("code"), field.alias("field"), F.coalesce(value, F.lit("")).alias("value"), hard_reason(code, field, F.coalesce(value, F.lit("")), as_of).alias("reason"), F.lit(origin).alias("origin"))

    found = F.transform(F.filter("issues", lambda x: x["code"].isin(*HARD)), lambda x: entry(x["code"], x["field"], x["value"], "NORMALIZATION_ISSUE"))
    rules = (
        ("INVALID_QUANTITY", "quantity", ~F.col("quantity").rlike(r"\A[0-9]*[1-9][0-9]*\z")),
        ("INVALID_UNIT_PRICE", "unit_price_eur", F.col("unit_price_eur").startswith("-")),
        ("FUTURE_ORDER_DATE", "order_date", F.col("order_date") > as_of),  # ISO text sorts as dates do
    )
    business = F.filter(F.array(*(F.when(~has_issue(f) & broken, entry(F.lit(code), F.lit(f), F.col(f), "BUSINESS_RULE")) for code, f, broken in rules)), lambda x: x.isNotNull())
    return F.sort_array(F.concat(found, business))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def prepare_reference(normalized: DataFrame, role: str, as_of: str = AS_OF) -> DataFrame:
    """Reference rows with disposition, rule_codes, primary_rule_code, survivor, usable and evidence."""
    key = KEY[role]
    key_issue = F.element_at(F.transform(F.filter("issues", lambda x: x["field"] == key), lambda x: x["code"]), 1)
    code = F.when(F.size(F.filter("issues", lambda x: x["field"] == key)) > 0, key_issue)
    if role == "products":
        code = F.coalesce(code, F.when(has_issue("unit_price_eur") | F.col("unit_price_eur").startswith("-"), "INVALID_UNIT_PRICE"))
    frame = written(fenced(normalized.withColumn("_code", code), "_code"), "reference")
    where = F.when(F.col("_code") == "INVALID_UNIT_PRICE", "unit_price_eur").otherwise(key)
    value = F.when(F.col("_code") == "INVALID_UNIT_PRICE", F.col("unit_price_eur")).otherwise(F.col(key)) if role == "products" else F.col(key)
    shut = evidence(2, F.col("_code"), where, F.lit("VALIDATION_FAILURE"), F.concat(F.lit("Reference row excluded: "), hard_reason(F.col("_code"), where, F.coalesce(value, F.lit("")), as_of)), value)
    refused = frame.where(F.col("_code").isNotNull()).select(
        *normalized.columns, F.lit("REFERENCE_REJECTED").alias("disposition"), F.array("_code").alias("rule_codes"), F.lit(None).cast(_REF).alias("survivor"), F.array(shut).cast(EVIDENCE).alias("evidence"),
    )
    rest = resolve(frame.where(F.col("_code").isNull()), key, list(FIELDS[role]))
    twin = evidence(1, F.lit("REFERENCE_DUPLICATE_EXACT"), F.lit(key), F.lit("DEDUPLICATION"), F.concat(F.lit("Identical reference copy of "), _quoted(F.col(key)), F.lit("; the first source-order row is retained.")), related=F.col("survivor"))
    clash = evidence(1, F.lit("REFERENCE_KEY_CONFLICT"), F.lit(key), F.lit("REFERENCE_FAILURE"), F.concat(F.lit("Conflicting reference facts for "), _quoted(F.col(key)), F.lit("; the key is unavailable.")))
    status = F.col("status")
    decided = rest.select(
        *normalized.columns,
        F.when(status == "SURVIVOR", "REFERENCE_VALID").when(status == "DUPLICATE", "REFERENCE_DEDUPLICATED").otherwise("REFERENCE_REJECTED").alias("disposition"),
        F.when(status == "SURVIVOR", F.array().cast("array<string>")).when(status == "DUPLICATE", F.array(F.lit("REFERENCE_DUPLICATE_EXACT"))).otherwise(F.array(F.lit("REFERENCE_KEY_CONFLICT"))).alias("rule_codes"),
        F.when(status == "DUPLICATE", F.col("survivor")).cast(_REF).alias("survivor"),
        F.when(status == "SURVIVOR", F.array().cast(EVIDENCE)).when(status == "DUPLICATE", F.array(twin).cast(EVIDENCE)).otherwise(F.array(clash).cast(EVIDENCE)).alias("evidence"),
    )
    return written(refused.unionByName(decided).withColumn("primary_rule_code", F.get("rule_codes", F.lit(0))), "prepared")


def usable(prepared: DataFrame) -> DataFrame:
    """Reference rows that foreign keys may point to; their key is unique."""
    return prepared.where(F.col("disposition") == "REFERENCE_VALID")


def unknown_references(rows: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """rows with no_customer and no_product; Spark broadcasts a key set only if it is small."""
    c = usable(customers).select(F.col("customer_id").alias("_c"))
    p = usable(products).select(F.col("product_id").alias("_p"))
    joined = rows.join(c, F.col("customer_id") == F.col("_c"), "left").join(p, F.col("product_id") == F.col("_p"), "left")
    return joined.withColumns({"no_customer": F.col("_c").isNull(), "no_product": F.col("_p").isNull()}).drop("_c", "_p")


def checked(normalized: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Sales rows with `failures`."""
    return fenced(normalized.withColumn("failures", hard_failures(as_of)), "failures")


def slim(normalized: DataFrame) -> DataFrame:
    """A normalized frame without what only evidence needs: raw values and events."""
    return normalized.select(*(c for c in normalized.columns if c != "events" and not c.startswith("raw_")))


def dispose(normalized: DataFrame, customers: DataFrame, products: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Sales rows with disposition, rule_codes, primary_rule_code, survivor and evidence.

    Carries every column of normalized; slim() first where no evidence is wanted.
    """
    # three branches read the checked rows, two the resolved ones: both are written once
    rows, kept = written(checked(normalized, as_of), "checked"), normalized.columns
    nobody = F.lit(None).cast(_REF).alias("survivor")
    hard = rows.where(F.size("failures") > 0).select(
        *kept, F.lit("QUARANTINED").alias("disposition"), F.transform("failures", lambda x: x["code"]).alias("rule_codes"), nobody,
        F.transform("failures", lambda x: evidence(0, x["code"], x["field"], F.lit("VALIDATION_FAILURE"), x["reason"], x["value"])).cast(EVIDENCE).alias("evidence"),
    )
    rest = written(resolve(rows.where(F.size("failures") == 0).select(*kept), "order_id", list(FIELDS["sales"])), "resolved")
    order = _quoted(F.col("order_id"))
    twin = evidence(1, F.lit("DUPLICATE_EXACT"), F.lit("order_id"), F.lit("DEDUPLICATION"), F.concat(F.lit("Identical transaction copy of "), order, F.lit("; the first source-order row is retained.")), related=F.col("survivor"))
    clash = evidence(1, F.lit("DUPLICATE_KEY_CONFLICT"), F.lit("order_id"), F.lit("VALIDATION_FAILURE"), F.concat(F.lit("Conflicting business facts for "), order, F.lit("; every group member is quarantined.")))
    grouped = rest.where("status <> 'SURVIVOR'").select(
        *kept, F.when(F.col("status") == "DUPLICATE", "DEDUPLICATED").otherwise("QUARANTINED").alias("disposition"),
        F.array(F.when(F.col("status") == "DUPLICATE", "DUPLICATE_EXACT").otherwise("DUPLICATE_KEY_CONFLICT")).alias("rule_codes"),
        F.when(F.col("status") == "DUPLICATE", F.col("survivor")).cast(_REF).alias("survivor"),
        F.when(F.col("status") == "DUPLICATE", F.array(twin).cast(EVIDENCE)).otherwise(F.array(clash).cast(EVIDENCE)).alias("evidence"),
    )
    last = unknown_references(rest.where("status = 'SURVIVOR'").select(*kept), customers, products)

    def missing(flag: str, code: str, field: str, name: str) -> Column:
        said = F.concat(F.lit(f"{field} "), _quoted(F.col(field)), F.lit(f" is absent from the usable {name} reference."))
        return F.when(F.col(flag), evidence(2, F.lit(code), F.lit(field), F.lit("REFERENCE_FAILURE"), said, F.col(field)))

    gone = F.filter(F.array(missing("no_customer", "UNKNOWN_CUSTOMER_REFERENCE", "customer_id", "customer"), missing("no_product", "UNKNOWN_PRODUCT_REFERENCE", "product_id", "product")), lambda x: x.isNotNull())
    linked = last.withColumn("_gone", gone).select(
        *kept, F.when(F.size("_gone") > 0, "QUARANTINED").otherwise("ACCEPTED").alias("disposition"), F.transform("_gone", lambda x: x["code"]).alias("rule_codes"), nobody, F.col("_gone").cast(EVIDENCE).alias("evidence"),
    )
    return hard.unionByName(grouped).unionByName(linked).withColumn("primary_rule_code", F.get("rule_codes", F.lit(0)))


@dataclass(frozen=True)
class Validated:
    """The validated bundle; every frame is lazy."""

    sales: DataFrame
    customers: DataFrame
    products: DataFrame
    pairs: DataFrame

    def bucket(self, disposition: str) -> DataFrame:
        """Sales rows of one disposition."""
        return self.sales.where(F.col("disposition") == disposition)

    def outcome(self, file: str, sheet: str, row: int) -> DataFrame:
        """The sales row of one reference."""
        return self.sales.where((F.col("_source_file") == file) & (F.col("_source_sheet") == sheet) & (F.col("_source_row") == row))


def validate(sales: DataFrame, customers: DataFrame, products: DataFrame, as_of: str = AS_OF, threshold: int = 90) -> Validated:
    """Normalized frames to dispositions and fuzzy candidates."""
    from .fuzzy import candidates

    c, p = prepare_reference(customers, "customers", as_of), prepare_reference(products, "products", as_of)
    return Validated(dispose(sales, c, p, as_of), c, p, candidates(usable(c), threshold))


def reconciliation(sales: DataFrame) -> DataFrame:
    """(input, accepted, quarantined, deduplicated, reconciled) in one row."""
    n = lambda d: F.count_if(F.col("disposition") == d).alias(d.lower())
    out = sales.agg(F.count("*").alias("input"), n("ACCEPTED"), n("QUARANTINED"), n("DEDUPLICATED"))
    return out.withColumn("reconciled", F.expr("input = accepted + quarantined + deduplicated"))


def reference_counts(prepared: dict[str, DataFrame]) -> DataFrame:
    """(record_type, input, valid, rejected, deduplicated, reconciled), a row a table."""
    out = None
    for role, frame in prepared.items():
        n = lambda d: F.count_if(F.col("disposition") == f"REFERENCE_{d}").alias(d.lower())
        one = frame.agg(F.count("*").alias("input"), n("VALID"), n("REJECTED"), n("DEDUPLICATED")).select(F.lit(role).alias("record_type"), "*", F.expr("input = valid + rejected + deduplicated").alias("reconciled"))
        out = one if out is None else out.unionByName(one)
    return out


def provenance_columns() -> list[Column]:
    """Provenance under the names of evidence tables."""
    return [F.col(p).alias(p.lstrip("_")) for p in PROVENANCE]
