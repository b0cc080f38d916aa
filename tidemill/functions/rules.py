"""Normalization rules as Column expressions over cells.

A cell is STRUCT<kind, text, norm, whole, plain>: kind is one of null, str, int, float, bool,
date, datetime, other; text prints the value; norm is text in NFC; whole is the exact integer
that a number equals, plain its decimal form without exponent (null if it has none). Every
rule gives STRUCT<value, event, issue, reason> and never drops a row. Digits are ASCII digits.

A rule keeps what it uses more than once as columns of its own (Steps), layer upon layer:
written as one expression it would repeat itself at every level, and Spark would plan and
evaluate each repetition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import CATEGORIES, COUNTRIES, MONTH_NAMES

CELL = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "text", "norm", "whole", "plain")])
#: White space as Python sees it: Unicode's, and U+001C to U+001F.
_WS = r"[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
IDENTIFIER = r"\A[A-Z0-9][A-Z0-9_-]{0,63}\z"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = rf"(?U)\A[^@\s\x1c-\x1f]+@{_LABEL}(?:\.{_LABEL})+\z"


def _null() -> Column:
    return F.lit(None).cast("string")


class Steps:
    """Columns that one rule keeps, in the order in which they build on each other."""

    def __init__(self, prefix: str):
        self.prefix, self.kept = prefix, []

    def keep(self, x: Column) -> Column:
        """x as a column of the next layer."""
        name = f"{self.prefix}_{len(self.kept)}"
        self.kept.append(x.alias(name))
        return F.col(name)


def layered(frame: DataFrame, steps: Sequence[Steps]) -> DataFrame:
    """frame with every rule's columns, the first of each in one layer, and so on."""
    for level in range(max((len(s.kept) for s in steps), default=0)):
        frame = frame.select("*", *(s.kept[level] for s in steps if len(s.kept) > level))
    return frame


def fenced(frame: DataFrame, *columns: str) -> DataFrame:
    """frame, with `columns` by expressions that Spark may not evaluate twice.

    So a filter on them is not rewritten into the expressions below, which would repeat them
    at every layer.
    """
    once = F.monotonically_increasing_id() >= 0  # always true, but not to be moved
    return frame.select(*(F.when(once, F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def fuzzy_key(names: pd.Series) -> pd.Series:
    """NFC, collapsed white space, full case folding."""
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()).casefold())


def text_cell(c: Column, ascii_only: bool = False) -> Column:
    """A string column as cells. ascii_only: the caller knows that NFC changes nothing."""
    kind = F.when(c.isNull(), "null").otherwise("str")
    norm = c if ascii_only else F.when(c.rlike(r"\A[\x00-\x7F]*\z"), c).otherwise(nfc(c))
    return F.struct(kind.alias("kind"), c.alias("text"), norm.alias("norm"), _null().alias("whole"), _null().alias("plain"))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(x, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Stripped, runs of white space one space, empty as null."""
    x = c["norm"]
    # most texts need no pattern: no space after a space, and nothing but printable ASCII
    plain = ~x.contains("  ") & ~x.rlike(r"[^ -~]")
    x = F.when(plain, F.trim(x)).otherwise(F.trim(F.regexp_replace(x, rf"(?U){_WS}+", " ")))
    return F.nullif(x, F.lit(""))


def _result(value: Column, event: Column | None = None, issue: Column | None = None, reason: Column | None = None) -> Column:
    event, issue, reason = (_null() if x is None else x for x in (event, issue, reason))
    return F.struct(value.alias("value"), event.alias("event"), issue.alias("issue"), F.when(issue.isNotNull(), reason).alias("reason"))


def _changed(c: Column, value: Column, code: str) -> Column:
    return F.when(value.isNotNull() & (value != c["text"]), code)


def text(c: Column, t: Steps) -> Column:
    """Descriptive text; case is kept, blank becomes null without an event."""
    value = t.keep(clean(c))
    return _result(value, _changed(c, value, "NORMALIZE_WHITESPACE"))


def identifier(c: Column, missing: str, t: Steps) -> Column:
    """Upper-cased identifiers; numbers only if they are whole."""
    kind = c["kind"]
    shown = t.keep(F.upper(strip(c["norm"])))
    value = t.keep(F.when(kind == "bool", c["text"]).when(kind == "float", F.coalesce(c["whole"], c["text"])).otherwise(F.when(shown != "", shown)))
    fractional = (kind == "float") & c["whole"].isNull()
    refused = (kind == "bool") | fractional
    issue = F.when(value.isNull(), missing).when(refused | ~value.rlike(IDENTIFIER), "INVALID_IDENTIFIER")
    reason = (
        F.when(value.isNull(), "identifier is missing")
        .when(kind == "bool", "boolean is not an identifier")
        .when(fractional, "numeric identifier is not an integer")
        .otherwise("identifier violates the bounded canonical pattern")
    )
    return _result(value, F.when(~refused, _changed(c, value, "NORMALIZE_IDENTIFIER")), issue, reason)


def _integer(signed: Column) -> Column:
    digits = F.regexp_replace(signed, r"\A[+-]?0*(?=[0-9])", "")
    return F.when(signed.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def integer(c: Column, t: Steps) -> Column:
    """Exact integers of any length, without sign rules; changes make no event."""
    kind, shown = c["kind"], t.keep(strip(c["norm"]))
    number = kind.isin("int", "float")
    fits = F.when(number, c["whole"].isNotNull()).when(kind == "bool", False).otherwise(shown.rlike(r"\A[+-]?[0-9]+\z"))
    fits = t.keep(fits)
    value = t.keep(F.when(fits, F.when(number, c["whole"]).otherwise(_integer(shown))).otherwise(F.when(kind.isin("bool", "float"), c["text"]).otherwise(F.when(shown != "", shown))))
    reason = (
        F.when(value.isNull(), "quantity is missing")
        .when(kind == "bool", "boolean is not an integer")
        .when(kind == "float", "quantity is fractional or non-finite")
        .otherwise("quantity is not an exact integer")
    )
    return _result(value, issue=F.when(~fits | value.isNull(), "INVALID_QUANTITY"), reason=reason)


#: The accepted amounts after the sign, each with what turns it into a plain decimal.
_AMOUNTS = (
    (r"[0-9]+(?:\.[0-9]{1,2})?", "", ""),
    (r"[0-9]+,[0-9]{2}", "", ","),
    (r"[0-9]{1,3}(?:[ \u00a0][0-9]{3})+,[0-9]{2}", " \u00a0", ","),
    (r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{2}", ".", ","),
    (r"[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{1,2}", ",", ""),
)


def currency(c: Column, t: Steps) -> Column:
    """Money in euro with two digits, exact at any length; ambiguous forms are refused."""
    kind, shown = c["kind"], t.keep(strip(c["norm"]))
    number = kind.isin("int", "float")
    before, after = shown.rlike(r"(?i)\AEUR"), shown.rlike(r"(?i)EUR\z")
    bare = t.keep(F.when(before & after, _null()).when(before, strip(F.substr(shown, F.lit(4)))).when(after, strip(F.regexp_replace(shown, r"(?i)EUR\z", ""))).otherwise(shown))
    amount = t.keep(F.regexp_replace(bare, r"\A[+-]", ""))
    plain = F.lit(None).cast("string")
    for form, drop, point in reversed(_AMOUNTS):
        turned = F.translate(amount, drop, "") if drop else amount
        turned = F.replace(turned, F.lit(point), F.lit(".")) if point else turned
        plain = F.when(amount.rlike(rf"\A(?:{form})\z"), turned).otherwise(plain)
    unsigned = t.keep(F.when(number, F.regexp_replace(c["plain"], r"\A-", "")).when(kind == "bool", _null()).otherwise(plain))
    negative = F.when(number, c["plain"].startswith("-")).otherwise(bare.startswith("-"))
    whole = F.regexp_replace(F.substring_index(unsigned, ".", 1), r"\A0+(?=[0-9])", "")
    part = t.keep(F.when(F.instr(unsigned, ".") > 0, F.substring_index(unsigned, ".", -1)).otherwise(""))
    precise = F.length(part) <= 2
    digits = t.keep(F.concat(whole, F.lit("."), F.rpad(part, 2, "0")))
    canonical = t.keep(F.when(unsigned.isNotNull() & precise, F.when(negative & digits.rlike("[1-9]"), F.concat(F.lit("-"), digits)).otherwise(digits)))
    missing = (kind == "null") | ((kind == "str") & (shown == ""))
    value = F.coalesce(canonical, F.when(~missing, F.when(kind == "str", shown).otherwise(c["text"])))
    reason = (
        F.when(missing, "unit price is missing")
        .when(kind == "bool", "boolean is not money")
        .when(unsigned.isNotNull() & ~precise, "unit price has more than two decimal places")
        .otherwise("unit price is malformed or ambiguous")
    )
    return _result(value, F.when(canonical.isNotNull(), _changed(c, canonical, "NORMALIZE_CURRENCY")), F.when(canonical.isNull(), "INVALID_UNIT_PRICE"), reason)


def _map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def month_numbers() -> dict[str, str]:
    """Full and three-letter English month names, as two digits."""
    return {name: f"{i:02d}" for i, full in enumerate(MONTH_NAMES, 1) for name in (full, full[:3])}


def date(c: Column, t: Steps) -> Column:
    """ISO dates from three bounded forms, dates, and midnight timestamps."""
    kind, shown = c["kind"], t.keep(strip(c["norm"]))
    slashed, worded = r"\A([0-9]{2})/([0-9]{2})/([0-9]{4})\z", r"\A([0-9]{2}) ([A-Za-z]+) ([0-9]{4})\z"
    at = lambda form, i: F.regexp_extract(shown, form, i)
    iso = t.keep(
        F.when(shown.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), shown)
        .when(shown.rlike(slashed), F.concat_ws("-", at(slashed, 3), at(slashed, 2), at(slashed, 1)))
        .when(shown.rlike(worded), F.concat(at(worded, 3), F.lit("-"), F.try_element_at(_map(month_numbers()), F.lower(at(worded, 2))), F.lit("-"), at(worded, 1)))
    )
    real = F.when((iso >= "0001") & F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso)
    midnight = F.when(c["text"].rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} 00:00:00\z"), F.substring(c["text"], 1, 10))
    canonical = t.keep(F.when(kind == "str", real).when(kind == "date", c["text"]).when(kind == "datetime", midnight))
    missing = (kind == "null") | ((kind == "str") & (shown == ""))
    value = F.coalesce(canonical, F.when(~missing, F.when(kind == "str", shown).otherwise(c["text"])))
    reason = (
        F.when(missing, "order date is missing")
        .when(kind == "datetime", "timestamp is not a bounded date")
        .when(kind == "str", "order date is malformed or impossible")
        .otherwise("order date has an unsupported type")
    )
    return _result(value, F.when(canonical.isNotNull(), _changed(c, canonical, "NORMALIZE_DATE")), F.when(canonical.isNull(), "INVALID_ORDER_DATE"), reason)


def _mapped(c: Column, t: Steps, names: Mapping[str, str], event: str, issue: str, reason: str) -> Column:
    kept = t.keep(clean(c))
    # case folding for map keys; a dotless i has no upper case that leads back to it
    folded = F.when(~kept.contains("ı"), F.lower(F.upper(kept)))
    canonical = t.keep(F.try_element_at(_map(names), folded))
    value = F.coalesce(canonical, kept)
    code = F.when(canonical.isNotNull(), _changed(c, value, event)).otherwise(_changed(c, value, "NORMALIZE_WHITESPACE"))
    return _result(value, code, F.when(kept.isNotNull() & canonical.isNull(), issue), F.lit(reason))


def country(c: Column, t: Steps) -> Column:
    """Known countries; others are kept and flagged."""
    return _mapped(c, t, COUNTRIES, "NORMALIZE_COUNTRY", "UNKNOWN_COUNTRY", "country is outside the bounded alias map")


def category(c: Column, t: Steps) -> Column:
    """Known categories; others are kept and flagged."""
    return _mapped(c, t, CATEGORIES, "NORMALIZE_CATEGORY", "UNKNOWN_CATEGORY", "category is outside the bounded alias map")


def email(c: Column, t: Steps) -> Column:
    """Stripped; the domain is lower-cased if there is exactly one @; validity only flags."""
    shown = t.keep(strip(c["norm"]))
    one = F.length(shown) - F.length(F.replace(shown, F.lit("@"), F.lit(""))) == 1
    value = t.keep(F.when(shown != "", F.when(one, F.concat(F.substring_index(shown, "@", 1), F.lit("@"), F.lower(F.substring_index(shown, "@", -1)))).otherwise(shown)))
    return _result(value, _changed(c, value, "NORMALIZE_EMAIL"), F.when(~value.rlike(EMAIL), "INVALID_EMAIL_FORMAT"), F.lit("email does not match the bounded syntax"))


def field_rule(field: str, c: Column, t: Steps) -> Column:
    """The rule that belongs to a field; its value is the rule's last step."""
    if field.endswith("_id"):
        return t.keep(identifier(c, f"MISSING_{field.upper()}", t))
    rule = {"order_date": date, "quantity": integer, "unit_price_eur": currency, "country": country, "email": email, "category": category}.get(field, text)
    return t.keep(rule(c, t))


def shown_original(c: Column) -> Column:
    """A raw cell as evidence prints it: null as empty, a midnight timestamp as its date."""
    midnight = (c["kind"] == "datetime") & c["text"].endswith(" 00:00:00")
    moment = (c["kind"] == "datetime") & ~midnight
    return F.coalesce(F.when(midnight, F.substring(c["text"], 1, 10)).when(moment, F.replace(c["text"], F.lit(" "), F.lit("T"))).otherwise(c["text"]), F.lit(""))
