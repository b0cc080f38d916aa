"""Fixed contracts: roles, fields, header aliases, value maps, codes and their order."""

from __future__ import annotations

# Fixed values throughout this module: they are the contract's, stated in its order.

FIELDS = {
    "sales": ("order_id", "customer_id", "product_id", "order_date", "quantity", "unit_price_eur", "country"),
    "customers": ("customer_id", "customer_name", "email", "country"),
    "products": ("product_id", "product_name", "category", "unit_price_eur"),
}
KEY = {"sales": "order_id", "customers": "customer_id", "products": "product_id"}
PROVENANCE = ("_source_file", "_source_sheet", "_source_row")

HEADERS = {
    "sales": {
        "order_id": ("Order ID", "OrderID", "order id"),
        "customer_id": ("Customer ID", "CustomerID", "customer id"),
        "product_id": ("Product ID", "ProductID", "product id"),
        "order_date": ("Order Date", "OrderDate", "order date", "Date"),
        "quantity": ("Quantity", "Qty", "qty"),
        "unit_price_eur": ("Unit Price", "UnitPrice", "unit price", "Price EUR", "price"),
        "country": ("Country", "Country Code", "country code"),
    },
    "customers": {
        "customer_id": ("Customer ID", "CustomerID", "customer id"),
        "customer_name": ("Customer Name", "CustomerName", "customer name", "Name"),
        "email": ("Email", "Email Address", "email address"),
        "country": ("Country", "Country Code", "country code"),
    },
    "products": {
        "product_id": ("Product ID", "ProductID", "product id", "SKU", "sku"),
        "product_name": ("Product Name", "ProductName", "product name"),
        "category": ("Category", "Product Category", "product category"),
        "unit_price_eur": ("Unit Price", "UnitPrice", "unit price", "Price EUR", "price"),
    },
}

COUNTRIES = {"france": "FR", "fr": "FR", "fra": "FR"}
CATEGORIES = {
    "electronics": "ELECTRONICS", "tech": "ELECTRONICS",
    "home": "HOME", "home & living": "HOME", "home and living": "HOME",
    "office": "OFFICE", "office supplies": "OFFICE",
    "apparel": "APPAREL", "clothing": "APPAREL",
}
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Every code in catalogue order; its place is a sort key of the audit log.
CODES = (
    "UNEXPECTED_INPUT", "UNEXPECTED_SHEET", "UNEXPECTED_COLUMN", "MISSING_REQUIRED_COLUMN", "ALIAS_COLLISION",
    "NORMALIZE_WHITESPACE", "NORMALIZE_IDENTIFIER", "NORMALIZE_COUNTRY", "NORMALIZE_CURRENCY", "NORMALIZE_DATE", "NORMALIZE_EMAIL", "NORMALIZE_CATEGORY",
    "MISSING_ORDER_ID", "MISSING_CUSTOMER_ID", "MISSING_PRODUCT_ID", "INVALID_IDENTIFIER", "INVALID_ORDER_DATE", "FUTURE_ORDER_DATE", "INVALID_QUANTITY", "INVALID_UNIT_PRICE",
    "DUPLICATE_EXACT", "DUPLICATE_KEY_CONFLICT", "REFERENCE_DUPLICATE_EXACT", "REFERENCE_KEY_CONFLICT",
    "UNKNOWN_CUSTOMER_REFERENCE", "UNKNOWN_PRODUCT_REFERENCE",
    "INVALID_EMAIL_FORMAT", "UNKNOWN_COUNTRY", "UNKNOWN_CATEGORY", "FUZZY_CUSTOMER_CANDIDATE",
)
RANK = {code: i for i, code in enumerate(CODES)}
HARD = CODES[RANK["MISSING_ORDER_ID"] : RANK["INVALID_UNIT_PRICE"] + 1]
FLAGS = ("INVALID_EMAIL_FORMAT", "UNKNOWN_COUNTRY", "UNKNOWN_CATEGORY", "FUZZY_CUSTOMER_CANDIDATE")

AS_OF = "2026-10-07"
TIMEZONE = "Europe/Paris"
FUZZY_THRESHOLD = 90
SPECIFICATION_VERSION, PIPELINE_VERSION, DEMO_SEED = "1.0.1", "1.0.0", 1007

CLEANED_COLUMNS = (*FIELDS["sales"], *PROVENANCE)
REJECTED_VALUES = ("order_id", "customer_id", "product_id", "order_date", "quantity", "unit_price_eur", "country", "customer_name", "email", "product_name", "category")
REJECTED_COLUMNS = ("record_type", "source_file", "source_sheet", "source_row", "terminal_disposition", "primary_rule_code", "rule_codes", "reason", *REJECTED_VALUES)
AUDIT_COLUMNS = ("event_index", "record_type", "source_file", "source_sheet", "source_row", "field_name", "original_value", "cleaned_value", "code", "action_type", "related_source_file", "related_source_sheet", "related_source_row", "message")
OUTPUTS = ("cleaned_sales.xlsx", "cleaned_sales.csv", "rejected_rows.csv", "audit_log.csv", "cleaning_summary.json", "data_quality_report.html")


def alias_map(role: str) -> dict[str, str]:
    """Accepted header -> field of one role; raises if a header names two fields."""
    out: dict[str, str] = {}
    for field, names in HEADERS[role].items():
        for name in (field, *names):
            if out.setdefault(name, field) != field:
                raise ValueError(f"header {name!r} is listed twice for {role}")
    return out
