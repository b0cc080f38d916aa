"""Messy sales, customers and products made by arithmetic from typed order tables.

The bridge between Parquet tables and the cleansing roles: defects are injected by fixed
rules on keys, in expressions that Spark and other SQL engines read alike (MESSY_SQL), so a
result can be checked elsewhere. Each order is a source file and its lines the rows, which
gives references that are unique without a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import FIELDS, PROVENANCE
from ..functions.rules import text_cell

#: The clock of these tables, inside the range of their dates.
AS_OF = "2001-01-01"
#: Fixed values.
_MONTHS = "CASE substr(d, 6, 2) " + " ".join(
    f"WHEN '{i:02d}' THEN '{m}'" for i, m in enumerate(("January", "Feb", "March", "April", "May", "Jun", "July", "August", "Sep", "October", "November", "December"), 1)
) + " END"
_GROUPED = "concat(CAST(CAST(floor(w / 1000) AS BIGINT) AS STRING), '{s}', lpad(CAST(w % 1000 AS STRING), 3, '0'), '{p}', f)"


def _money(big: str) -> str:
    """SQL for money texts from w (whole euro) and f (two digits), by the case number q."""
    forms = ["concat(CAST(w AS STRING), '.', f)", "concat(CAST(w AS STRING), ',', f)", "concat('EUR ', CAST(w AS STRING), '.', f)", "concat(' ', CAST(w AS STRING), '.', f, ' eur')"]
    grouped = [_GROUPED.format(s=s, p=p) for s, p in ((" ", ","), (".", ","), (",", "."))]
    cases = [f"WHEN q = {i} THEN {x}" for i, x in enumerate(forms)]
    cases += [f"WHEN q = {i} THEN CASE WHEN w >= 1000 AND w < 1000000 THEN {x} ELSE {forms[0]} END" for i, x in enumerate(grouped, 4)]
    cases += [f"WHEN q = 7 THEN CASE WHEN w >= 1000 AND w < 1000000 THEN concat(CAST(CAST(floor(w / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(w % 1000 AS STRING), 3, '0')) ELSE concat('USD ', CAST(w AS STRING)) END"]
    cases += [f"WHEN q = 8 THEN concat('-', {forms[0]})", f"WHEN q = 9 THEN concat({forms[0]}, '5')", f"WHEN q = 10 THEN '{big}'"]
    return "CASE " + " ".join(cases) + f" ELSE {forms[0]} END"


_SALES = f"""
SELECT concat(prefix, lpad(CAST(k AS STRING), 12, '0')) AS _source_file, '' AS _source_sheet,
  CAST(row_number() OVER (PARTITION BY prefix, k ORDER BY n, p, s, qty, w, f, d) + 1 AS INT) AS _source_row,
  CASE WHEN (k + n) % 17 = 0 THEN '' WHEN (k + n) % 23 = 0 THEN concat('bad id! ', CAST(k AS STRING))
       WHEN k % 5 = 0 THEN concat('  ord-', CAST(k AS STRING), '-', CAST(n AS STRING), ' ') ELSE concat('ORD-', CAST(k AS STRING), '-', CAST(n AS STRING)) END AS order_id,
  CASE WHEN k % 31 = 0 THEN ' ' WHEN k % 29 = 0 THEN concat('X', CAST(c AS STRING)) WHEN k % 7 = 0 THEN concat('c', CAST(c AS STRING)) ELSE concat('C', CAST(c AS STRING)) END AS customer_id,
  CASE WHEN s % 37 = 0 THEN concat('?', CAST(p AS STRING)) WHEN s % 41 = 0 THEN concat('Y', CAST(p AS STRING)) ELSE concat('P', CAST(p AS STRING)) END AS product_id,
  CASE WHEN p % 43 = 0 THEN '31/02/1997' WHEN p % 47 = 0 THEN ' ' WHEN p % 4 = 0 THEN d WHEN p % 4 = 1 THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
       WHEN p % 4 = 2 THEN concat(substr(d, 9, 2), ' ', {_MONTHS}, ' ', substr(d, 1, 4)) ELSE concat(' ', d) END AS order_date,
  CASE WHEN (p + k) % 53 = 0 THEN '' WHEN (p + k) % 19 = 0 THEN concat(CAST(qty AS STRING), '.5') WHEN (p + k) % 13 = 0 THEN concat('-', CAST(qty AS STRING))
       WHEN (p + k) % 7 = 0 THEN concat('+0', CAST(qty AS STRING)) ELSE CAST(qty AS STRING) END AS quantity,
  {_money("n/a")} AS unit_price_eur,
  CASE (p + s) % 7 WHEN 0 THEN 'FR' WHEN 1 THEN 'France' WHEN 2 THEN ' fra  ' WHEN 3 THEN 'fr' WHEN 4 THEN '  Saint   Pierre ' WHEN 5 THEN 'DE' ELSE '' END AS country
FROM (
  SELECT x.prefix, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, o_custkey AS c,
    CAST(CAST(l_shipdate AS DATE) AS STRING) AS d, CAST(l_quantity AS BIGINT) AS qty,
    CAST(floor(l_extendedprice) AS BIGINT) AS w, lpad(CAST(CAST(round((l_extendedprice - floor(l_extendedprice)) * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS f,
    (l_partkey + l_linenumber) % 16 AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (SELECT 'a-' AS prefix, 0 AS again UNION ALL SELECT 'b-' AS prefix, 1 AS again) x ON x.again = 0 OR l_orderkey % 61 = 0
) t
"""
# names from four independent parts of the key; a few repeat a neighbour's with one letter more
_FIRST = "Ada,Bruno,Carmen,Dieter,Elodie,Fabien,Greta,Hugo,Ingrid,Joana,Karim,Louise,Marek,Nadia,Oskar,Petra,Quentin,Rosa,Stefan,Ursula"
_PART = "bar,nel,sto,kim,dur,vix,ghu,pel,tor,lam,zen,qua,mis,fro,hyd,wel,jos,cri,ova,ebb"
_NAME = " || ".join(
    [f"split_part('{_FIRST}', ',', CAST(g % 20 AS INT) + 1)", "' '", *(f"split_part('{_PART}', ',', CAST(floor(g / {d}) % 20 AS INT) + 1)" for d in (20, 400, 8000)), "CASE WHEN k % 97 = 0 THEN 'e' ELSE '' END"]
)
_CUSTOMERS = f"""
SELECT concat('customers-', prefix) AS _source_file, 'customers' AS _source_sheet, CAST(k + 2 AS INT) AS _source_row,
  CASE WHEN k % 101 = 0 THEN '' WHEN k % 103 = 0 THEN concat('C ', CAST(k AS STRING)) WHEN k % 11 = 0 THEN concat(' c', CAST(k AS STRING)) ELSE concat('C', CAST(k AS STRING)) END AS customer_id,
  CASE WHEN k % 13 = 0 THEN concat(' ', c_name, '  ') WHEN k % 107 = 0 THEN '  ' WHEN k % 109 = 0 AND prefix = 'b' THEN concat(c_name, ' II')
       WHEN k % 23 = 0 THEN replace(c_name, 'e', 'e\u0301') WHEN k % 29 = 0 THEN concat(c_name, ' Stra\u00dfe') WHEN k % 31 = 0 THEN concat(c_name, ' STRASSE') ELSE c_name END AS customer_name,
  CASE WHEN k % 17 = 0 THEN concat('user', CAST(k AS STRING), '.example.test') WHEN k % 5 = 0 THEN concat(' User', CAST(k AS STRING), '@Mail.EXAMPLE.test') ELSE concat('user', CAST(k AS STRING), '@mail.example.test') END AS email,
  CASE k % 5 WHEN 0 THEN 'FR' WHEN 1 THEN 'france' WHEN 2 THEN ' FRA' WHEN 3 THEN 'Atlantis' ELSE '' END AS country
FROM (SELECT prefix, k, {_NAME} AS c_name FROM (SELECT x.prefix, c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 1 ELSE c_custkey END AS g FROM customer JOIN (SELECT 'a' AS prefix, 0 AS again UNION ALL SELECT 'b' AS prefix, 1 AS again) x ON x.again = 0 OR c_custkey % 59 = 0 OR c_custkey % 109 = 0) u) t
"""
_PRODUCTS = f"""
SELECT concat('products-', prefix) AS _source_file, '' AS _source_sheet, CAST(k + 2 AS INT) AS _source_row,
  CASE WHEN k % 113 = 0 THEN '' WHEN k % 127 = 0 THEN concat('#', CAST(k AS STRING)) ELSE concat('P', CAST(k AS STRING)) END AS product_id,
  CASE WHEN k % 7 = 0 THEN concat(p_name, '   x ') ELSE p_name END AS product_name,
  CASE k % 6 WHEN 0 THEN 'Tech' WHEN 1 THEN ' home  &  living ' WHEN 2 THEN 'OFFICE' WHEN 3 THEN 'Clothing' WHEN 4 THEN 'Garden' ELSE '' END AS category,
  {_money("10.00")} AS unit_price_eur
FROM (SELECT x.prefix, p_partkey AS k, p_name, CAST(floor(p_retailprice) AS BIGINT) + x.again AS w, '50' AS f, p_partkey % 12 AS q
      FROM part JOIN (SELECT 'a' AS prefix, 0 AS again UNION ALL SELECT 'b' AS prefix, 0 AS again UNION ALL SELECT 'c' AS prefix, 1 AS again) x
        ON x.prefix = 'a' OR (x.prefix = 'b' AND p_partkey % 67 = 0) OR (x.prefix = 'c' AND p_partkey % 71 = 0)) t
"""
MESSY_SQL = {"sales": _SALES, "customers": _CUSTOMERS, "products": _PRODUCTS}
_TABLES = {"sales": ("lineitem", "orders"), "customers": ("customer",), "products": ("part",)}


def raw(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The messy rows of a role as strings, with provenance."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[role]}
    sql = MESSY_SQL[role]
    for t in tables:
        sql = sql.replace(f" {t} JOIN", f" {{{t}}} JOIN").replace(f"JOIN {t} ON", f"JOIN {{{t}}} ON")
    return spark.sql(sql, **tables)


def cells(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The messy rows as cells; all texts but names are ASCII by construction."""
    rows = raw(spark, sf_dir, role)
    return rows.select(*PROVENANCE, *(text_cell(F.col(f), ascii_only=f != "customer_name").alias(f) for f in FIELDS[role]))
