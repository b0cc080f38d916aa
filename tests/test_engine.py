"""Interaction cases, references, evidence, invariants."""

import random

import pytest
from pyspark.sql import types as T

from tidemill.functions.contracts import FIELDS, PROVENANCE
from tidemill.functions.rules import CELL
from tidemill.operators import evidence, invariants, validate
from tidemill.operators.fuzzy import candidates, deletions, key_pairs, lcs_length, met_pairs
from tidemill.plans.pipeline import RoleError, validated
from tidemill.sources.files import cell

SALE = {"order_id": "T-100", "customer_id": "K7", "product_id": "W3", "order_date": "2025-03-14", "quantity": "6", "unit_price_eur": "18.25", "country": "FR"}
CUSTOMER = {"customer_id": "K7", "customer_name": "Gesine Ollsen", "email": "g.ollsen@post.invalid", "country": "FR"}
PRODUCT = {"product_id": "W3", "product_name": "Brass Hinge", "category": "HOME", "unit_price_eur": "18.25"}


def frame(spark, role, rows):
    schema = T.StructType([T.StructField("_source_file", T.StringType()), T.StructField("_source_sheet", T.StringType()), T.StructField("_source_row", T.IntegerType()), *(T.StructField(f, CELL) for f in FIELDS[role])])
    return spark.createDataFrame([(f"{role}.csv", "", i, *(cell(r[f]) for f in FIELDS[role])) for i, r in enumerate(rows, 2)], schema)


def bundle(spark, sales, customers=(CUSTOMER,), products=(PRODUCT,)):
    return validated({"sales": frame(spark, "sales", sales), "customers": frame(spark, "customers", customers), "products": frame(spark, "products", products)})


def outcome(v):
    rows = v.sales.orderBy(*PROVENANCE).collect()
    return [(r["disposition"], list(r["rule_codes"])) for r in rows]


@pytest.mark.parametrize(
    "sales, expected",
    [
        ([{}], [("ACCEPTED", [])]),
        ([{"order_id": " t-8 ", "order_date": "30/12/2024", "unit_price_eur": "EUR 7 315,90", "country": "Fra"}], [("ACCEPTED", [])]),
        ([{"quantity": "0"}], [("QUARANTINED", ["INVALID_QUANTITY"])]),
        ([{}, {}], [("ACCEPTED", []), ("DEDUPLICATED", ["DUPLICATE_EXACT"])]),
        ([{"quantity": "11"}, {"quantity": "12"}], [("QUARANTINED", ["DUPLICATE_KEY_CONFLICT"])] * 2),
        ([{"country": ""}, {}], [("QUARANTINED", ["DUPLICATE_KEY_CONFLICT"])] * 2),
        ([{"quantity": "-9"}, {"quantity": "9"}], [("QUARANTINED", ["INVALID_QUANTITY"]), ("ACCEPTED", [])]),
        ([{"customer_id": "K0", "product_id": "W0"}], [("QUARANTINED", ["UNKNOWN_CUSTOMER_REFERENCE", "UNKNOWN_PRODUCT_REFERENCE"])]),
        ([{"order_date": "2026-10-08"}], [("QUARANTINED", ["FUTURE_ORDER_DATE"])]),
        ([{"order_date": "2026-10-07", "unit_price_eur": "0,00"}], [("ACCEPTED", [])]),
        ([{"customer_id": "", "order_date": "2026-10-08", "quantity": "0"}], [("QUARANTINED", ["MISSING_CUSTOMER_ID", "FUTURE_ORDER_DATE", "INVALID_QUANTITY"])]),
        ([{"order_id": "T 1", "product_id": "W.", "unit_price_eur": "-88.0001"}], [("QUARANTINED", ["INVALID_IDENTIFIER", "INVALID_IDENTIFIER", "INVALID_UNIT_PRICE"])]),
    ],
)
def test_cases(spark, sales, expected):
    v, _ = bundle(spark, [SALE | s for s in sales])
    assert outcome(v) == expected


def test_empty_sales(spark):
    v, sales = bundle(spark, [])
    assert validate.reconciliation(v.sales).head().asDict() == {"input": 0, "accepted": 0, "quarantined": 0, "deduplicated": 0, "reconciled": True}
    invariants.check(v, sales)
    assert evidence.audit_log(v).count() == 0


def test_references_evidence_and_invariants(spark):
    customers = [CUSTOMER, CUSTOMER, CUSTOMER | {"customer_id": "K8"}, CUSTOMER | {"customer_id": "K8", "country": ""}, CUSTOMER | {"customer_id": ""}, CUSTOMER | {"customer_id": "K9", "customer_name": "Gesina Ollsen", "email": "x"}]
    products = [PRODUCT, PRODUCT | {"product_id": "W4", "unit_price_eur": "-3"}]
    v, sales = bundle(spark, [SALE, SALE | {"order_id": "T-101", "customer_id": "K8"}, SALE | {"order_id": "T-102", "product_id": "W4"}], customers, products)
    got = {r["record_type"]: (r["input"], r["valid"], r["rejected"], r["deduplicated"]) for r in validate.reference_counts({"customers": v.customers, "products": v.products}).collect()}
    assert got == {"customers": (6, 2, 3, 1), "products": (2, 1, 1, 0)}
    assert outcome(v) == [("ACCEPTED", []), ("QUARANTINED", ["UNKNOWN_CUSTOMER_REFERENCE"]), ("QUARANTINED", ["UNKNOWN_PRODUCT_REFERENCE"])]
    log = evidence.audit_log(v).orderBy("event_index").collect()
    assert [r["event_index"] for r in log] == list(range(1, len(log) + 1))
    assert [(r["source_row"], r["code"]) for r in log if r["record_type"] == "customers"] == [
        (2, "FUZZY_CUSTOMER_CANDIDATE"), (3, "REFERENCE_DUPLICATE_EXACT"), (4, "REFERENCE_KEY_CONFLICT"), (5, "REFERENCE_KEY_CONFLICT"), (6, "MISSING_CUSTOMER_ID"), (7, "INVALID_EMAIL_FORMAT"),
    ]
    assert log[0]["message"] == "Customer names 'K7' and 'K9' score 92.3077 at or above 90.0; evidence only, no merge."
    rejected = {(r["record_type"], r["source_row"]): r for r in evidence.rejected_rows(v).collect()}
    assert rejected["products", 3]["reason"] == "Reference row excluded: unit_price_eur is negative (-3.00)."
    assert rejected["products", 3]["unit_price_eur"] == "-3" and rejected["sales", 3]["reason"] == "customer_id 'K8' is absent from the usable customer reference."
    invariants.check(v, sales)


def test_broken_invariant_raises(spark):
    v, sales = bundle(spark, [SALE, SALE | {"order_id": "T-101"}])
    with pytest.raises(invariants.InvariantError):
        invariants.check(v, sales.where("order_id = 'T-100'"))


def test_repeated_reference_is_refused(spark):
    twice = frame(spark, "sales", [SALE]).union(frame(spark, "sales", [SALE]))
    with pytest.raises(Exception, match="repeated reference"):
        validated({"sales": twice, "customers": frame(spark, "customers", [CUSTOMER]), "products": frame(spark, "products", [PRODUCT])})[0].sales.count()


def test_missing_role(spark):
    with pytest.raises(RoleError):
        validated({"sales": frame(spark, "sales", [SALE])})


def test_order_independence(spark):
    rows = [SALE | {"order_id": f"T-{i % 5}", "quantity": str(1 + i % 2 * (i % 5 == 1))} for i in range(12)]
    f = frame(spark, "sales", rows)
    base = {"customers": frame(spark, "customers", [CUSTOMER]), "products": frame(spark, "products", [PRODUCT])}
    one = outcome(validated({"sales": f, **base})[0])
    two = outcome(validated({"sales": f.repartition(3, "_source_row"), **base})[0])
    assert one == two


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(4)
    names = {f"N{i:03d}": "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))).strip() or None for i in range(90)}
    names |= {f"Z{i}": n for i, n in enumerate(["Tove Lindqvist", "Tove Lindkvist", "TOVE LINDQVIST", "Gro\u00dfmann", "GROSSMANN"])}
    rows = spark.createDataFrame([(k, v, "f", "", i) for i, (k, v) in enumerate(names.items())], "customer_id string, customer_name string, _source_file string, _source_sheet string, _source_row int")

    def lcs(a, b):
        d = [0] * (len(b) + 1)
        for x in a:
            p = d[:]
            for j, y in enumerate(b):
                d[j + 1] = p[j] + 1 if x == y else max(p[j + 1], d[j])
        return d[-1]

    key = {k: " ".join(v.split()).casefold() for k, v in names.items() if v}
    want = {(a, b, lcs(key[a], key[b]), len(key[a]) + len(key[b])) for a in key for b in key if a < b and 200 * lcs(key[a], key[b]) >= 90 * (len(key[a]) + len(key[b]))}
    assert {(r["left_id"], r["right_id"], r["common"], r["total"]) for r in candidates(rows).collect()} == want and len(want) > 4


def test_fuzzy_names_that_begin_alike_do_not_all_meet(spark):
    rng = random.Random(5)
    names = sorted({"Margaret " + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(700)})
    pairs = sum(2 * lcs_length(a, b) >= 0.9 * (len(a) + len(b)) for i, a in enumerate(names) for b in names[:i])
    met = met_pairs(spark.createDataFrame([(n,) for n in names], "key string"), 90)
    assert met.distinct().count() == pairs > 0 and met.count() <= 3 * pairs  # by equal segments 245,000 met


@pytest.mark.parametrize("threshold", [70, 80, 90, 97])
def test_fuzzy_pairs_of_short_and_long_names(spark, threshold):
    rng = random.Random(threshold)
    names = set()
    for n in (2, 5, 9, 14, 19, 22, 29, 31, 46, 60):
        for _ in range(3):
            name = [rng.choice("ab\u00e9\U0001f600 ") for _ in range(n)]
            for _ in range(7):
                names.add("".join(name))
                for _ in range(rng.randint(1, 4)):
                    at = rng.randrange(len(name) + 1)
                    name[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
    names = sorted(names - {""}, key=lambda x: (len(x), x))
    want = {(a, b) for j, b in enumerate(names) for a in names[:j] if 200 * lcs_length(a, b) >= threshold * (len(a) + len(b))}
    got = [(r["a"], r["b"]) for r in key_pairs(spark.createDataFrame([(n,) for n in names], "key string"), threshold).collect()]
    assert set(got) == want and len(got) == len(want)
    assert len({deletions(len(a), len(b), threshold) is None for a, b in want}) == 2  # both ways were used
