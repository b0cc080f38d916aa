"""DuckDB SQL for the registered cleansing queries: written apart from the Spark expressions."""

from __future__ import annotations

from ..functions.contracts import CATEGORIES, CODES, COUNTRIES, FIELDS, FLAGS, FUZZY_THRESHOLD, KEY, RANK, REJECTED_VALUES
from ..functions.rules import month_numbers
from . import messy, scans

_IDENT = "[A-Z0-9][A-Z0-9_-]{0,63}"


def _identifier(x: str, field: str) -> tuple[str, str, str]:
    v = f"nullif(upper(trim({x})), '')"
    return v, f"CASE WHEN {v} <> {x} THEN 'NORMALIZE_IDENTIFIER' END", f"CASE WHEN {v} IS NULL THEN 'MISSING_{field.upper()}' WHEN NOT regexp_full_match({v}, '{_IDENT}') THEN 'INVALID_IDENTIFIER' END"


def _quantity(x: str) -> tuple[str, str, str]:
    ok = f"regexp_full_match(trim({x}), '[+-]?[0-9]+')"
    return f"CASE WHEN {ok} THEN CAST(CAST(replace(trim({x}), '+', '') AS HUGEINT) AS VARCHAR) ELSE nullif(trim({x}), '') END", "NULL", f"CASE WHEN NOT {ok} THEN 'INVALID_QUANTITY' END"


def _currency(x: str) -> tuple[str, str, str]:
    s = f"trim({x})"
    bare = f"CASE WHEN upper({s}) LIKE 'EUR%' AND upper({s}) LIKE '%EUR' THEN NULL WHEN upper({s}) LIKE 'EUR%' THEN trim(substr({s}, 4)) WHEN upper({s}) LIKE '%EUR' THEN trim(left({s}, length({s}) - 3)) ELSE {s} END"
    amount = f"regexp_replace(({bare}), '^[+-]', '')"
    plain = (
        f"CASE WHEN regexp_full_match({amount}, '[0-9]+([.][0-9]{{1,2}})?') THEN {amount}"
        f" WHEN regexp_full_match({amount}, '[0-9]+,[0-9]{{2}}') OR regexp_full_match({amount}, '[0-9]{{1,3}}( [0-9]{{3}})+,[0-9]{{2}}') THEN replace(replace({amount}, ' ', ''), ',', '.')"
        f" WHEN regexp_full_match({amount}, '[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]{{2}}') THEN replace(replace({amount}, '.', ''), ',', '.')"
        f" WHEN regexp_full_match({amount}, '[0-9]{{1,3}}(,[0-9]{{3}})+[.][0-9]{{1,2}}') THEN replace({amount}, ',', '') END"
    )
    number = f"CAST(({plain}) AS DECIMAL(30, 2))"
    exact = f"CASE WHEN left(({bare}), 1) = '-' THEN CAST(-{number} AS VARCHAR) ELSE CAST({number} AS VARCHAR) END"
    return f"coalesce({exact}, nullif({s}, ''))", f"CASE WHEN ({exact}) <> {x} THEN 'NORMALIZE_CURRENCY' END", f"CASE WHEN ({exact}) IS NULL THEN 'INVALID_UNIT_PRICE' END"


def _date(x: str) -> tuple[str, str, str]:
    s = f"trim({x})"
    month = "CASE lower(split_part({s}, ' ', 2)) ".format(s=s) + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in month_numbers().items()) + " END"
    iso = (
        f"CASE WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {s}"
        f" WHEN regexp_full_match({s}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN split_part({s}, '/', 3) || '-' || split_part({s}, '/', 2) || '-' || split_part({s}, '/', 1)"
        f" WHEN regexp_full_match({s}, '[0-9]{{2}} [A-Za-z]+ [0-9]{{4}}') THEN split_part({s}, ' ', 3) || '-' || ({month}) || '-' || split_part({s}, ' ', 1) END"
    )
    real = f"CASE WHEN try_cast(({iso}) AS DATE) IS NOT NULL THEN ({iso}) END"
    return f"coalesce({real}, nullif({s}, ''))", f"CASE WHEN ({real}) <> {x} THEN 'NORMALIZE_DATE' END", f"CASE WHEN ({real}) IS NULL THEN 'INVALID_ORDER_DATE' END"


def _clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _mapped(x: str, names: dict[str, str], event: str, issue: str) -> tuple[str, str, str]:
    kept = _clean(x)
    known = f"CASE lower({kept}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    value = f"coalesce({known}, {kept})"
    return value, f"CASE WHEN {value} <> {x} THEN CASE WHEN ({known}) IS NULL THEN 'NORMALIZE_WHITESPACE' ELSE '{event}' END END", f"CASE WHEN {kept} IS NOT NULL AND ({known}) IS NULL THEN '{issue}' END"


def _text(x: str) -> tuple[str, str, str]:
    v = _clean(f"nfc_normalize({x})")
    return v, f"CASE WHEN {v} <> {x} THEN 'NORMALIZE_WHITESPACE' END", "NULL"


def _email(x: str) -> tuple[str, str, str]:
    s = f"trim({x})"
    v = f"nullif(CASE WHEN length({s}) - length(replace({s}, '@', '')) = 1 THEN split_part({s}, '@', 1) || '@' || lower(split_part({s}, '@', 2)) ELSE {s} END, '')"
    label = "[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
    return v, f"CASE WHEN {v} <> {x} THEN 'NORMALIZE_EMAIL' END", f"CASE WHEN NOT regexp_full_match({v}, '[^@\\s]+@{label}([.]{label})+') THEN 'INVALID_EMAIL_FORMAT' END"


def _rule(field: str) -> tuple[str, str, str]:
    if field.endswith("_id"):
        return _identifier(field, field)
    return {
        "order_date": _date, "quantity": _quantity, "unit_price_eur": _currency, "email": _email,
        "country": lambda x: _mapped(x, COUNTRIES, "NORMALIZE_COUNTRY", "UNKNOWN_COUNTRY"),
        "category": lambda x: _mapped(x, CATEGORIES, "NORMALIZE_CATEGORY", "UNKNOWN_CATEGORY"),
    }.get(field, _text)(field)


def _norm(role: str) -> str:
    """CTEs raw_<role> and <role>: values, e_<field>, i_<field> and raw_<field>."""
    parts = []
    for f in FIELDS[role]:
        v, e, i = _rule(f)
        parts += [f"{v} AS {f}", f"{e} AS e_{f}", f"{i} AS i_{f}", f"{f} AS raw_{f}"]
    return f"raw_{role} AS ({messy.MESSY_SQL[role]}), {role} AS (SELECT _source_file, _source_sheet, _source_row, {', '.join(parts)} FROM raw_{role})"


_ENTRIES = [
    *((f"i_{f} = 'MISSING_{f.upper()}'", f"MISSING_{f.upper()}", f, f"'{f} is missing.'") for f in FIELDS["sales"][:3]),
    *((f"i_{f} = 'INVALID_IDENTIFIER'", "INVALID_IDENTIFIER", f, f"'{f} violates the bounded identifier pattern.'") for f in FIELDS["sales"][:3]),
    ("i_order_date IS NOT NULL", "INVALID_ORDER_DATE", "order_date", "'order_date is missing, unparseable, or impossible.'"),
    (f"i_order_date IS NULL AND CAST(order_date AS DATE) > DATE '{messy.AS_OF}'", "FUTURE_ORDER_DATE", "order_date", f"'order_date is later than the frozen demo date {messy.AS_OF}.'"),
    ("i_quantity IS NOT NULL OR CAST(quantity AS HUGEINT) <= 0", "INVALID_QUANTITY", "quantity", "'quantity is missing, non-integer, or not greater than zero.'"),
    (
        "i_unit_price_eur IS NOT NULL OR left(unit_price_eur, 1) = '-'", "INVALID_UNIT_PRICE", "unit_price_eur",
        "CASE WHEN try_cast(unit_price_eur AS DOUBLE) < 0 THEN 'unit_price_eur is negative (' || unit_price_eur || ').' ELSE 'unit_price_eur is missing, malformed, ambiguous, or over-precise.' END",
    ),
]
_FAIL = "list_filter([" + ", ".join(f"CASE WHEN {w} THEN {{'r': {RANK[c]}, 'f': '{f}', 'c': '{c}', 'v': coalesce({f}, ''), 'm': {m}}} END" for w, c, f, m in _ENTRIES) + "], lambda x: x IS NOT NULL)"
_REF_STRUCT = "{'f': _source_file, 's': _source_sheet, 'r': _source_row}"


def _resolved(source: str, key: str, fields: tuple[str, ...]) -> str:
    fact = "{" + ", ".join(f"'{f}': coalesce({f}, '<null>')" for f in fields) + "}"
    return f"""SELECT *, CASE WHEN mn <> mx THEN 'CONFLICT' WHEN rank_ = 1 THEN 'SURVIVOR' ELSE 'DUPLICATE' END AS status FROM (
      SELECT *, min({fact}) OVER (PARTITION BY {key}) AS mn, max({fact}) OVER (PARTITION BY {key}) AS mx,
        row_number() OVER (PARTITION BY {key} ORDER BY _source_file, _source_sheet, _source_row) AS rank_,
        first_value({_REF_STRUCT}) OVER (PARTITION BY {key} ORDER BY _source_file, _source_sheet, _source_row) AS head FROM {source})"""


def _prepared(role: str) -> str:
    key = FIELDS[role][0]
    shut = f"i_{key}" if role == "customers" else f"coalesce(i_{key}, CASE WHEN i_unit_price_eur IS NOT NULL OR left(unit_price_eur, 1) = '-' THEN 'INVALID_UNIT_PRICE' END)"
    name = f"ref_{role}"
    return f"""{_norm(role)}, shut_{role} AS (SELECT *, {shut} AS shut FROM {role}), open_{role} AS (SELECT * FROM shut_{role} WHERE shut IS NULL),
    done_{role} AS ({_resolved(f'open_{role}', key, FIELDS[role])}),
    {name} AS (SELECT _source_file, _source_row, 'REFERENCE_REJECTED' AS disposition, shut AS primary_rule_code, NULL AS survivor_file, CAST(NULL AS INT) AS survivor_row, NULL AS usable FROM shut_{role} WHERE shut IS NOT NULL
      UNION ALL SELECT _source_file, _source_row, CASE status WHEN 'SURVIVOR' THEN 'REFERENCE_VALID' WHEN 'DUPLICATE' THEN 'REFERENCE_DEDUPLICATED' ELSE 'REFERENCE_REJECTED' END,
        CASE status WHEN 'DUPLICATE' THEN 'REFERENCE_DUPLICATE_EXACT' WHEN 'CONFLICT' THEN 'REFERENCE_KEY_CONFLICT' END,
        CASE WHEN status = 'DUPLICATE' THEN head.f END, CASE WHEN status = 'DUPLICATE' THEN head.r END, CASE WHEN status = 'SURVIVOR' THEN {key} END FROM done_{role})"""


_SALES = f"{_norm('sales')}, failing AS (SELECT *, {_FAIL} AS failures FROM sales), valid AS (SELECT * FROM failing WHERE len(failures) = 0), resolved AS ({_resolved('valid', 'order_id', FIELDS['sales'])})"
_LINKED = f"""{_prepared('customers')}, {_prepared('products')}, {_SALES}, linked AS (SELECT s.*, c.usable IS NULL AS no_customer, p.usable IS NULL AS no_product FROM (SELECT * FROM resolved WHERE status = 'SURVIVOR') s
  LEFT JOIN (SELECT usable FROM ref_customers WHERE usable IS NOT NULL) c ON s.customer_id = c.usable LEFT JOIN (SELECT usable FROM ref_products WHERE usable IS NOT NULL) p ON s.product_id = p.usable)"""


def _message(code: str, field: str, said: str) -> str:
    return f"{{'r': {RANK[code]}, 'f': '{field}', 'c': '{code}', 'v': {'coalesce(' + field + ', $$$$)' if code.startswith('UNKNOWN') else chr(39) * 2}, 'm': {said}}}".replace("$$$$", "''")


_TWIN = _message("DUPLICATE_EXACT", "order_id", "'Identical transaction copy of ''' || order_id || '''; the first source-order row is retained.'")
_CLASH = _message("DUPLICATE_KEY_CONFLICT", "order_id", "'Conflicting business facts for ''' || order_id || '''; every group member is quarantined.'")
_NO_C = _message("UNKNOWN_CUSTOMER_REFERENCE", "customer_id", "'customer_id ''' || customer_id || ''' is absent from the usable customer reference.'")
_NO_P = _message("UNKNOWN_PRODUCT_REFERENCE", "product_id", "'product_id ''' || product_id || ''' is absent from the usable product reference.'")
_KEPT = "_source_file, _source_sheet, _source_row, " + ", ".join(f"{p}{f}" for f in FIELDS["sales"] for p in ("", "raw_", "e_", "i_"))
_DISPOSED = f"""{_LINKED}, disposed AS (
  SELECT {_KEPT}, 'QUARANTINED' AS disposition, failures AS found, NULL AS survivor_file, CAST(NULL AS INT) AS survivor_row FROM failing WHERE len(failures) > 0
  UNION ALL SELECT {_KEPT}, CASE status WHEN 'DUPLICATE' THEN 'DEDUPLICATED' ELSE 'QUARANTINED' END, [CASE status WHEN 'DUPLICATE' THEN {_TWIN} ELSE {_CLASH} END], CASE WHEN status = 'DUPLICATE' THEN head.f END, CASE WHEN status = 'DUPLICATE' THEN head.r END FROM resolved WHERE status <> 'SURVIVOR'
  UNION ALL SELECT {_KEPT}, CASE WHEN no_customer OR no_product THEN 'QUARANTINED' ELSE 'ACCEPTED' END, list_filter([CASE WHEN no_customer THEN {_NO_C} END, CASE WHEN no_product THEN {_NO_P} END], lambda x: x IS NOT NULL), NULL, NULL FROM linked)"""
_CODES = "array_to_string(list_transform(found, lambda x: x.c), '|')"


def _events(role: str, source: str | None = None) -> str:
    """Every normalization event of a role's CTE (or of another source) as rows."""
    return " UNION ALL ".join(f"SELECT _source_file, _source_row, '{f}' AS field, e_{f} AS code, raw_{f} AS original, coalesce({f}, '') AS cleaned, 'Normalized {f} using ' || e_{f} || '.' AS message FROM {source or role} WHERE e_{f} IS NOT NULL" for f in FIELDS[role])


def _issues(role: str) -> str:
    return " UNION ALL ".join(f"SELECT '{role}' AS record_type, i_{f} AS code FROM {role} WHERE i_{f} IS NOT NULL" for f in FIELDS[role])


def _bucket(disposition: str) -> str:
    return f"WITH {_DISPOSED} SELECT _source_file, _source_row, {_CODES} AS rule_codes, found[1].c AS primary_rule_code, survivor_file, survivor_row FROM disposed WHERE disposition = '{disposition}'"


def _scalar(role: str, field: str) -> str:
    return f"WITH {_norm(role)} SELECT _source_file, _source_row, {field} AS value, e_{field} AS event, i_{field} AS issue FROM {role}"


_SUMMED = "SELECT count(*) AS input, count(*) FILTER (disposition = 'ACCEPTED') AS accepted, count(*) FILTER (disposition = 'QUARANTINED') AS quarantined, count(*) FILTER (disposition = 'DEDUPLICATED') AS deduplicated FROM disposed"
_CODE_RANK = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CODES)) + " END"
_GROUPS = "('DUPLICATE_EXACT', 'DUPLICATE_KEY_CONFLICT')"
_AT = "_source_file, _source_sheet, _source_row"
#: What an audit row says; the last two are sort keys.
_SAID = "field, original, cleaned, code, action, rf, rs, rr, message, stage, tie"
_FLAG_REASONS = {"email": "email does not match the bounded syntax", "country": "country is outside the bounded alias map", "category": "category is outside the bounded alias map"}


def _reference_reason(role: str) -> str:
    """The sentence of a refused reference row, from `shut`."""
    key = FIELDS[role][0]
    price = "CASE WHEN try_cast(unit_price_eur AS DOUBLE) < 0 THEN 'unit_price_eur is negative (' || unit_price_eur || ').' ELSE 'unit_price_eur is missing, malformed, ambiguous, or over-precise.' END" if role == "products" else "''"
    return f"'Reference row excluded: ' || CASE WHEN shut LIKE 'MISSING%' THEN '{key} is missing.' WHEN shut = 'INVALID_IDENTIFIER' THEN '{key} violates the bounded identifier pattern.' ELSE {price} END"


def _twin_said(role: str) -> str:
    return f"'Identical reference copy of ''' || {KEY[role]} || '''; the first source-order row is retained.'"


def _clash_said(role: str) -> str:
    return f"'Conflicting reference facts for ''' || {KEY[role]} || '''; the key is unavailable.'"


def _changes(role: str, source: str) -> str:
    """Normalization events and flags of a source with values, raw_, e_ and i_ columns, as audit rows."""
    rows = [f"SELECT '{role}' AS record_type, {_AT}, '{f}' AS field, raw_{f} AS original, coalesce({f}, '') AS cleaned, e_{f} AS code, 'NORMALIZATION' AS action, '' AS rf, '' AS rs, '' AS rr, 'Normalized {f} using ' || e_{f} || '.' AS message, 0 AS stage, '' AS tie FROM {source} WHERE e_{f} IS NOT NULL" for f in FIELDS[role]]
    flags = ", ".join(f"'{x}'" for x in FLAGS)
    rows += [f"SELECT '{role}', {_AT}, '{f}', raw_{f}, coalesce({f}, ''), i_{f}, 'FLAG', '', '', '', i_{f} || ' for {f}: {_FLAG_REASONS[f]}.', 0, '' FROM {source} WHERE i_{f} IN ({flags})" for f in FIELDS[role] if f in _FLAG_REASONS]
    return " UNION ALL ".join(rows)


def _reference_said(role: str) -> str:
    """Audit rows of a reference table."""
    key, price = KEY[role], "shut = 'INVALID_UNIT_PRICE'"
    where = f"CASE WHEN {price} THEN 'unit_price_eur' ELSE '{key}' END" if role == "products" else f"'{key}'"
    value = f"coalesce(CASE WHEN {price} THEN unit_price_eur ELSE {key} END, '')" if role == "products" else f"coalesce({key}, '')"
    return f"""{_changes(role, f'shut_{role}')}
  UNION ALL SELECT '{role}', {_AT}, {where}, {value}, '', shut, 'VALIDATION_FAILURE', '', '', '', {_reference_reason(role)}, 3, '' FROM shut_{role} WHERE shut IS NOT NULL
  UNION ALL SELECT '{role}', {_AT}, '', '', '', 'REFERENCE_DUPLICATE_EXACT', 'DEDUPLICATION', head.f, head.s, CAST(head.r AS VARCHAR), {_twin_said(role)}, 3, '' FROM done_{role} WHERE status = 'DUPLICATE'
  UNION ALL SELECT '{role}', {_AT}, '', '', '', 'REFERENCE_KEY_CONFLICT', 'REFERENCE_FAILURE', '', '', '', {_clash_said(role)}, 3, '' FROM done_{role} WHERE status = 'CONFLICT'"""


#: Pairs of usable customers whose names score at least the threshold. Bytes bound the edits of all pairs;
#: the longest common subsequence of the rest is a fold over the shorter name's rows of lengths.
_FUZZY = f"""names AS (SELECT customer_id AS id, {_REF_STRUCT} AS at, replace(lower({_clean('nfc_normalize(customer_name)')}), 'ß', 'ss') AS name FROM done_customers WHERE status = 'SURVIVOR' AND customer_name IS NOT NULL),
  near AS (SELECT a.id AS left_id, b.id AS right_id, a.at AS l, b.at AS r, a.name AS x, string_split(b.name, '') AS y, length(a.name) + length(b.name) AS total FROM names a JOIN names b ON a.id < b.id
    WHERE levenshtein(a.name, b.name) <= 2 * floor((length(a.name) + length(b.name)) * {100 - FUZZY_THRESHOLD} / 100)),
  folded AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, len(y) + 1), lambda j: CAST(0 AS BIGINT)), list_transform(string_split(x, ''), lambda c: [CAST(unicode(c) AS BIGINT)])),
    lambda row, c: list_transform(range(0, len(row)), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN unicode(y[i]) = c[1] THEN row[i] + 1 ELSE row[i + 1] END)) END)) AS lengths FROM near),
  pairs AS (SELECT left_id, right_id, l, r, CAST(lengths[-1] AS INT) AS common, CAST(total AS INT) AS total FROM folded WHERE 200 * lengths[-1] >= {FUZZY_THRESHOLD} * total)"""
_FUZZY_SAID = f"SELECT 'customers', l.f, l.s, l.r, '', '', '', 'FUZZY_CUSTOMER_CANDIDATE', 'FLAG', r.f, r.s, CAST(r.r AS VARCHAR), 'Customer names ''' || left_id || ''' and ''' || right_id || ''' score ' || printf('%.4f', 200.0 * common / total) || ' at or above {FUZZY_THRESHOLD:.1f}; evidence only, no merge.', 3, right_id FROM pairs"
_FIELD_RANK = "CASE " + " ".join(f"WHEN record_type = '{role}' AND field = '{f}' THEN {i}" for role, fs in FIELDS.items() for i, f in enumerate(fs, 1)) + " " + " ".join(f"WHEN record_type = '{role}' THEN {len(fs) + 1}" for role, fs in FIELDS.items()) + " END"
_AUDIT = f"""{_DISPOSED}, {_FUZZY}, said AS ({_changes('sales', 'disposed')}
  UNION ALL SELECT 'sales', {_AT}, CASE WHEN x.c IN {_GROUPS} THEN '' ELSE x.f END, x.v, '', x.c, CASE WHEN x.c = 'DUPLICATE_EXACT' THEN 'DEDUPLICATION' WHEN x.c LIKE 'UNKNOWN%' THEN 'REFERENCE_FAILURE' ELSE 'VALIDATION_FAILURE' END,
    CASE WHEN x.c = 'DUPLICATE_EXACT' THEN survivor_file ELSE '' END, '', CASE WHEN x.c = 'DUPLICATE_EXACT' THEN CAST(survivor_row AS VARCHAR) ELSE '' END, x.m, CASE WHEN x.c IN {_GROUPS} THEN 2 WHEN x.c LIKE 'UNKNOWN%' THEN 3 ELSE 1 END, ''
    FROM (SELECT *, unnest(found) AS x FROM disposed)
  UNION ALL {_reference_said('customers')} UNION ALL {_reference_said('products')} UNION ALL {_FUZZY_SAID}),
  ranked AS (SELECT *, {_FIELD_RANK} AS fr, {_CODE_RANK} AS cr FROM said)"""
_LOG = "row_number() OVER (ORDER BY _source_file, _source_sheet, _source_row, stage, cr, fr, field, code, tie, original, message) AS event_index, record_type, _source_file AS source_file, _source_sheet AS source_sheet, _source_row AS source_row, field AS field_name, original AS original_value, cleaned AS cleaned_value, code, action AS action_type, rf AS related_source_file, rs AS related_source_sheet, rr AS related_source_row, message"


def _rejected(role: str) -> str:
    """Rows of a role that were not accepted, with raw values."""
    values = ", ".join(f"raw_{f} AS {f}" if f in FIELDS[role] else f"'' AS {f}" for f in REJECTED_VALUES)
    head = f"SELECT '{role}' AS record_type, _source_file AS source_file, _source_sheet AS source_sheet, _source_row AS source_row"
    if role == "sales":
        reason = "array_to_string(list_transform(list_sort(list_transform(found, lambda x: {'r': x.r, 'f': x.f, 'm': x.m})), lambda x: x.m), '; ')"
        return f"{head}, disposition AS terminal_disposition, found[1].c AS primary_rule_code, {_CODES} AS rule_codes, {reason} AS reason, {values} FROM disposed WHERE disposition <> 'ACCEPTED'"
    return f"""{head}, 'REFERENCE_REJECTED' AS terminal_disposition, shut AS primary_rule_code, shut AS rule_codes, {_reference_reason(role)} AS reason, {values} FROM shut_{role} WHERE shut IS NOT NULL
  UNION ALL {head}, 'REFERENCE_DEDUPLICATED', 'REFERENCE_DUPLICATE_EXACT', 'REFERENCE_DUPLICATE_EXACT', {_twin_said(role)}, {values} FROM done_{role} WHERE status = 'DUPLICATE'
  UNION ALL {head}, 'REFERENCE_REJECTED', 'REFERENCE_KEY_CONFLICT', 'REFERENCE_KEY_CONFLICT', {_clash_said(role)}, {values} FROM done_{role} WHERE status = 'CONFLICT'"""


def _all_events() -> str:
    """Normalization events of all roles."""
    each = " UNION ALL ".join(f"SELECT '{r}' AS record_type, _source_sheet, * EXCLUDE (_source_sheet) FROM ({_events(r).replace('SELECT _source_file,', 'SELECT _source_sheet, _source_file,')})" for r in FIELDS)
    return f"WITH {', '.join(map(_norm, FIELDS))} SELECT record_type, _source_file, _source_row, field, code, original, cleaned, message FROM ({each})"


def _scan(kind: str) -> str:
    """The files' cells from the rows that were written to them."""
    fields = FIELDS["sales"]
    rows = scans.FILED_SQL.format(suffix=".xlsx" if kind == "xlsx" else ".csv", rows="raw_sales")
    head = f"WITH raw_sales AS ({messy.MESSY_SQL['sales']}), filed AS ({rows})"
    if kind == "csv":
        return f"{head} SELECT * FROM filed"
    if kind == "xlsx":
        cells = ", ".join(f"nullif({f}, '') AS {f}" for f in fields)
        return f"{head} SELECT source_file, 'sales' AS source_sheet, source_row, {cells}, CASE WHEN quantity = '' THEN 'null' WHEN regexp_full_match(quantity, '0|[1-9][0-9]*') THEN 'int' ELSE 'str' END AS quantity_kind FROM filed"
    quoted = " || ',' || ".join(f"CASE WHEN contains({f}, ',') OR contains({f}, '\"') THEN '\"' || replace({f}, '\"', '\"\"') || '\"' ELSE {f} END" for f in fields)
    aliases = sum(h != f for h, f in zip(scans.HEADER, fields))
    return f"""{head} SELECT source_file, 'sales' AS record_type, CAST(count(*) AS INT) AS row_count, {aliases} AS aliases_applied, 1 AS unexpected_columns,
      sha256('{','.join(scans.HEADER)}' || chr(10) || string_agg({quoted} || ',x' || chr(10), '' ORDER BY source_row)) AS sha256 FROM filed GROUP BY source_file"""


ORACLE_SQL: dict[str, str] = {
    "csv_scan": _scan("csv"),
    "xlsx_scan": _scan("xlsx"),
    "input_file_digests": _scan("digests"),
    "accepted_sales": f"WITH {_DISPOSED} SELECT order_id, customer_id, product_id, order_date, quantity, unit_price_eur, coalesce(country, '') AS country, _source_file, _source_sheet, _source_row FROM disposed WHERE disposition = 'ACCEPTED'",
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
    "norm_events": _all_events(),
    "norm_issue_counts": f"WITH {', '.join(map(_norm, FIELDS))} SELECT record_type, code, count(*) AS n FROM ({' UNION ALL '.join(map(_issues, FIELDS))}) GROUP BY ALL",
    "hard_failures": f"WITH {_SALES} SELECT _source_file, _source_row, array_to_string(list_transform(failures, lambda x: x.c), '|') AS codes, failures[1].c AS primary_code FROM failing WHERE len(failures) > 0",
    "dedupe_status": f"WITH {_SALES} SELECT _source_file, _source_row, status, CASE WHEN status <> 'CONFLICT' THEN head.f END AS survivor_file, CASE WHEN status <> 'CONFLICT' THEN head.r END AS survivor_row FROM resolved",
    "dedupe_conflicts": f"WITH {_SALES} SELECT order_id, count(*) AS n FROM resolved WHERE status = 'CONFLICT' GROUP BY order_id",
    "reference_customers": f"WITH {_prepared('customers')} SELECT * EXCLUDE (usable) FROM ref_customers",
    "reference_products": f"WITH {_prepared('products')} SELECT * EXCLUDE (usable) FROM ref_products",
    "fk_codes": f"WITH {_LINKED} SELECT _source_file, _source_row, no_customer, no_product FROM linked WHERE no_customer OR no_product",
    "reconciliation": f"WITH {_DISPOSED} SELECT *, input = accepted + quarantined + deduplicated AS reconciled FROM ({_SUMMED})",
    "reference_counts": f"WITH {_prepared('customers')}, {_prepared('products')} SELECT record_type, count(*) AS input, count(*) FILTER (disposition = 'REFERENCE_VALID') AS valid, count(*) FILTER (disposition = 'REFERENCE_REJECTED') AS rejected, count(*) FILTER (disposition = 'REFERENCE_DEDUPLICATED') AS deduplicated, true AS reconciled FROM (SELECT 'customers' AS record_type, * FROM ref_customers UNION ALL SELECT 'products', * FROM ref_products) GROUP BY record_type",
    "fuzzy_candidates": f"WITH {_prepared('customers')}, {_FUZZY} SELECT left_id, right_id, common, total FROM pairs",
    "audit_log": f"WITH {_AUDIT} SELECT {_LOG} FROM ranked",
    "rejected_rows": f"WITH {_DISPOSED} {' UNION ALL '.join(map(_rejected, FIELDS))}",
    "rule_counts": f"WITH {_AUDIT} SELECT code, count(*) AS n FROM ranked WHERE code NOT LIKE 'NORMALIZE%' GROUP BY code",
    "normalization_counts": f"WITH {_AUDIT} SELECT code, count(*) AS n FROM ranked WHERE code LIKE 'NORMALIZE%' GROUP BY code",
    "disposition_counts": f"WITH {_DISPOSED} SELECT disposition AS terminal_disposition, count(*) AS n FROM (SELECT disposition FROM disposed WHERE disposition <> 'ACCEPTED' UNION ALL SELECT disposition FROM ref_customers WHERE disposition <> 'REFERENCE_VALID' UNION ALL SELECT disposition FROM ref_products WHERE disposition <> 'REFERENCE_VALID') GROUP BY disposition",
    "summary_shares": f"WITH {_DISPOSED}, t AS ({_SUMMED}) SELECT disposition, n, printf('%.1f%%', 100.0 * n / input) AS share FROM (SELECT input, 'accepted' AS disposition, accepted AS n FROM t UNION ALL SELECT input, 'quarantined', quarantined FROM t UNION ALL SELECT input, 'deduplicated', deduplicated FROM t)",
    "invariant_violations": f"WITH {_norm('sales')} SELECT 'rows_checked' AS invariant, count(*) AS n FROM sales",
}
