"""Closed vocabularies and constants. These are fixed values: stored hashes, findings and plans depend on them."""

from __future__ import annotations

CANON_VERSION = "gos-canon-2"

# Token tags.
NULL, TEXT, NUMBER, BOOL, DATE, DATETIME, RELATION, SELECTION, ERROR = "z:", "s:", "n:", "b:", "d:", "t:", "r:", "k:", "e:"

# Hash prefixes.
SPEC_PREFIX, ROW_PREFIX, FOLDED_PREFIX, EXTRA_PREFIX = b"gos1/spec\0", b"gos1/row\0", b"gos1/rowf\0", b"gos1/extra\0"
BUCKET_PREFIX, DATASET_PREFIX, HEADER_PREFIX, QUARANTINE_PREFIX = b"gos1/bkt\0", b"gos1/ds\0", b"gos1/hdr\0", b"gos1/quar\0"
BUCKETS = 256

ERROR_CODES = (
    "NOT_A_NUMBER", "NOT_FINITE", "BAD_DATE", "BAD_BOOL", "CELL_ERROR", "IDENTIFIER_NUMERIC", "UNRESOLVED_SELECTION",
    "ORPHAN_REFERENCE", "NONEXISTENT_LOCAL_TIME", "TIME_COMPONENT_PRESENT", "MULTI_MATCH", "CURRENCY_MISMATCH",
)
QUARANTINE_REASONS = {
    "NOT_A_NUMBER": "not_a_number", "NOT_FINITE": "not_a_number", "BAD_DATE": "bad_date", "BAD_BOOL": "bad_bool", "CELL_ERROR": "error_cell",
    "IDENTIFIER_NUMERIC": "identifier_numeric", "UNRESOLVED_SELECTION": "type_coercion", "ORPHAN_REFERENCE": "orphan_reference",
    "NONEXISTENT_LOCAL_TIME": "nonexistent_local_time", "TIME_COMPONENT_PRESENT": "type_coercion", "MULTI_MATCH": "multi_match",
    "CURRENCY_MISMATCH": "currency_mismatch",
}
WARNING_CODES = ("TIME_COMPONENT_PRESENT", "AMBIGUOUS_LOCAL_TIME", "TEXT_COLUMN_RECEIVED_NUMBER", "ROUNDING_BOUNDARY", "GUESSED_SEPARATOR")
CELL_ERRORS = ("#N/A", "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NUM!", "#NULL!", "#ERROR!", "#GETTING_DATA", "#SPILL!", "#CALC!")

#: type -> (category, default severity). Sides are named source and target.
FINDINGS = {
    "missing_in_target": ("drift", "warning"), "missing_in_source": ("drift", "warning"), "field_mismatch": ("drift", "warning"),
    "currency_mismatch": ("drift", "critical"), "unmanaged_record": ("drift", "info"), "non_convergent": ("drift", "critical"),
    "type_coercion": ("data_quality", "warning"), "identifier_numeric": ("data_quality", "warning"), "orphan_reference": ("data_quality", "warning"),
    "multi_match": ("data_quality", "warning"), "duplicate_identity": ("data_quality", "critical"),
    "header_change": ("structural", "blocking"), "tab_missing": ("structural", "blocking"), "empty_tab": ("structural", "blocking"),
    "access_lost": ("structural", "blocking"), "schema_growth": ("structural", "info"), "read_incomplete": ("structural", "blocking"),
}
SEVERITIES = ("info", "warning", "critical", "blocking")

ACTION_SEQUENCE = {"writeback_sync_id": 10, "create": 20, "update": 30, "soft_delete": 40, "quarantine": 50}
ACTION_BATCH = 200
BREAKERS = ("read_incomplete", "empty_tab", "header_blocked", "duplicate_identity", "deletes_exceed_threshold", "creates_exceed_threshold")
DELETE_GUARDS = (
    "delete_policy", "no_sync_id", "no_promotion_link", "read_incomplete", "dataset_blocked", "natural_key_identity", "row_identity_not_sync_id",
    "quarantine_runs", "never_observed_missing", "quarantine_hours",
)
RESOLUTIONS = ("open", "planned", "applied", "ignored", "resolved_externally")
ROW_STATES = ("staged", "quarantined", "promoted", "missing", "obsolete")
LINK_STATES = ("linked", "missing", "quarantined", "soft_deleted", "unmanaged", "non_convergent")

TRUTHY, FALSY = ("true", "yes", "y", "1", "x", "✓"), ("false", "no", "n", "0")
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "CHF", "JPY", "$", "€", "£", "¥", "₹")
ERROR_TEXT = r"^#.*[!?A0]$"
DATE_FORMATS = ("%Y-%m-%d", "%m/%d/%Y")
STRICT_IDENTITY_SLUGS = (
    "id", "sku", "barcode", "upc", "ean", "isbn", "code", "ref", "reference", "part_number", "item_id", "item_number", "product_id", "product_code",
    "serial", "serial_number",
)
# Types of target fields that a column's type may be written to (fixed values), and Spark's types for them.
FIELD_TYPES = {
    "text": ("char", "text", "html"), "number": ("integer", "float", "monetary"), "money": ("float", "monetary"), "bool": ("boolean",), "date": ("date",),
    "datetime": ("datetime",), "selection": ("selection",), "many2one": ("many2one",), "m2m": ("many2many", "one2many"),
}

NODE_TYPES = ("folder", "spreadsheet", "document", "presentation", "drawing", "blob", "shortcut", "other")
CLIP = 500


def category_of(finding: str) -> str:
    return FINDINGS[finding][0]


def severity_of(finding: str) -> str:
    return FINDINGS[finding][1]
