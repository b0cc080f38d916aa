"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tidemill.plans.oracle import ORACLE_SQL
from tidemill.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["accepted_sales", "norm_currency", "norm_date", "norm_email", "dedupe_status", "reference_products", "rejected_rows", "audit_log", "fuzzy_candidates", "norm_events", "rule_counts", "normalization_counts", "csv_scan", "xlsx_scan", "input_file_digests"])
def test_query(spark, views, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = views.sql(ORACLE_SQL[name]).select(*cols).fetchall() if hasattr(views.sql(ORACLE_SQL[name]), "fetchall") else []
    text = lambda rows: sorted([tuple("" if x is None else str(x) for x in r) for r in rows])
    assert text(got.select(*cols).collect()) == text(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_roles_and_texts(views):
    log = views.sql(ORACLE_SQL["audit_log"])
    assert {r[0] for r in log.select("record_type").fetchall()} == {"sales", "customers", "products"}
    assert {"FUZZY_CUSTOMER_CANDIDATE", "REFERENCE_KEY_CONFLICT", "REFERENCE_DUPLICATE_EXACT"} <= {r[0] for r in log.select("code").fetchall()}
    assert any(not x[0].isascii() for x in log.select("original_value").fetchall())  # NFC and case folding are at work
    assert {r[0] for r in views.sql(ORACLE_SQL["rejected_rows"]).select("record_type").fetchall()} == {"sales", "customers", "products"}
