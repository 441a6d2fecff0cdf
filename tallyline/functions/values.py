"""Tokens of booleans, dates, datetimes, selections and relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions.text import casefold, collapse, prepare, text_token
from tallyline.plans.contract import Contract, spark_pattern

BASE_DATE = "1899-12-30"


def bool_token(v: Column, c: Contract, dtype: str = "string") -> Column:
    empty = F.lit({"false": "b:0", "null": tx.NULL, "error": "e:BAD_BOOL"}[c.empty_means])
    if dtype == "boolean":
        return F.when(v.isNull(), empty).when(v, F.lit("b:1")).otherwise(F.lit("b:0"))
    if dtype != "string":
        s = F.when(v == 1, F.lit("1")).when(v == 0, F.lit("0")).otherwise(v.cast("string"))
    else:
        s = casefold(collapse(prepare(v, c.ascii_only)), c.ascii_only)
        s = F.when(s.isin("1.0", "0.0"), F.substring(s, 1, 1)).otherwise(s)
    yes, no = ([x.casefold() for x in words] for words in (c.truthy, c.falsy))
    return F.when(v.isNull() | (s == ""), empty).when(s.isin(yes), F.lit("b:1")).when(s.isin(no), F.lit("b:0")).otherwise(F.lit("e:BAD_BOOL"))


def serial_seconds(serial: Column) -> Column:
    """Seconds from the serial base of a spreadsheet date; the day's part rounds half up to whole seconds."""
    d = serial.cast("string").try_cast("decimal(38,18)")
    days = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    return days.cast("bigint") * 86400 + F.round((d - days) * 86400, 0).cast("bigint")


def serial_timestamp(serial: Column) -> Column:
    """The local date and time of a serial (a timestamp without time zone)."""
    return F.lit(BASE_DATE).cast("timestamp_ntz") + F.make_dt_interval(secs=serial_seconds(serial).cast("decimal(18,6)"))


def strict_parse(s: Column, formats: tuple[str, ...]) -> Column:
    """The first format that matches the whole text, as a timestamp without time zone; null if none does."""
    found = [F.try_to_timestamp(s, F.lit(spark_pattern(f))).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp_ntz")


def date_token(v: Column, c: Contract, side: str = "source", dtype: str = "string") -> Column:
    """A date's token. Dates never meet a time zone; a time of day is dropped."""
    if dtype in ("date", "timestamp_ntz", "timestamp"):
        out = F.date_format(v.cast("date"), "yyyy-MM-dd")
        return F.when(v.isNull(), F.lit(tx.NULL)).otherwise(F.concat(F.lit(tx.DATE), out))
    if dtype == "boolean":
        return F.when(v.isNull(), F.lit(tx.NULL)).otherwise(F.lit("e:BAD_DATE"))
    if dtype != "string":
        at = serial_timestamp(v)
        return F.when(v.isNull(), F.lit(tx.NULL)).when(at.isNull(), F.lit("e:BAD_DATE")).otherwise(F.concat(F.lit(tx.DATE), F.date_format(at.cast("date"), "yyyy-MM-dd")))
    s = prepare(v, ascii_only=True)
    at = strict_parse(s, c.date_formats)
    return F.when(v.isNull() | (s == ""), F.lit(tx.NULL)).when(at.isNull(), F.lit("e:BAD_DATE")).otherwise(F.concat(F.lit(tx.DATE), F.date_format(at.cast("date"), "yyyy-MM-dd")))


def has_time(v: Column, dtype: str) -> Column:
    """Whether a date cell carries a time of day (warning TIME_COMPONENT_PRESENT)."""
    at = serial_timestamp(v) if dtype not in ("timestamp", "timestamp_ntz") else v.cast("timestamp_ntz")
    return at != F.date_trunc("day", at)


def _utc(local: Column, timezone: str) -> tuple[Column, Column]:
    """A local time as UTC (the first of two), and whether it never existed."""
    utc = F.to_utc_timestamp(local.cast("timestamp_ntz").cast("string").cast("timestamp_ntz"), timezone)
    back = F.from_utc_timestamp(utc, timezone)
    return utc, back.cast("timestamp_ntz") != local.cast("timestamp_ntz")


def datetime_token(v: Column, c: Contract, side: str = "source", dtype: str = "string") -> Column:
    """A datetime's token, in UTC. The source is local to the contract's time zone, the target is UTC already.

    The session's time zone must be UTC.
    """
    null = v.isNull()
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        at = v.cast("timestamp_ntz")
    elif dtype == "string":
        s = prepare(v, ascii_only=True)
        null = null | (s == "")
        at = strict_parse(s, c.datetime_formats or ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", *c.date_formats))
    elif dtype == "boolean":
        at = F.lit(None).cast("timestamp_ntz")
    else:
        at = serial_timestamp(v)
    form = lambda t: F.concat(F.lit(tx.DATETIME), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    out = F.when(null, F.lit(tx.NULL)).when(at.isNull(), F.lit("e:BAD_DATE"))
    if side == "target":
        return out.otherwise(form(at))
    utc, gap = _utc(at, c.timezone)
    return out.when(gap, F.lit("e:NONEXISTENT_LOCAL_TIME")).otherwise(form(utc))


def selection_token(v: Column, c: Contract, side: str = "source") -> Column:
    """The target holds technical keys, the source labels that the contract maps without regard to case."""
    if side == "target":
        t = text_token(v, ascii_only=c.ascii_only)
        return F.when(t == tx.NULL, t).otherwise(F.concat(F.lit(tx.SELECTION), F.substring(t, F.lit(3), F.length(t))))
    t = text_token(v, collapse_ws=c.collapse_ws, fold=True, ascii_only=c.ascii_only)
    label = F.substring(t, F.lit(3), F.length(t))
    pairs = [F.lit(x) for k, k2 in {k.casefold(): k2 for k, k2 in c.value_map.items()}.items() for x in (k, k2)]
    key = F.try_element_at(F.create_map(*pairs), label) if pairs else F.lit(None).cast("string")
    return F.when(t == tx.NULL, t).when(key.isNull(), F.lit("e:UNRESOLVED_SELECTION")).otherwise(F.concat(F.lit(tx.SELECTION), key))


def relation_token(v: Column, c: Contract, dtype: str = "string") -> Column:
    """A reference by id or business key. A display name is never a key: resolve it first (``resolve_references``)."""
    if c.compare_by == "id":
        s = F.trim(v.cast("string"))
        n = s.try_cast("bigint")
        return F.when(v.isNull() | (s == ""), F.lit(tx.NULL)).when(n.isNull(), F.lit("e:ORPHAN_REFERENCE")).otherwise(F.concat(F.lit(tx.RELATION), n.cast("string")))
    t = text_token(v.cast("string"), ascii_only=c.ascii_only)
    return F.when(t == tx.NULL, t).otherwise(F.concat(F.lit(tx.RELATION), F.substring(t, F.lit(3), F.length(t))))


def relations_token(v: Column, c: Contract, dtype: str = "string") -> Column:
    """Many references, sorted: as numbers if all are, else by bytes. Repeated members stay."""
    parts = v if dtype.startswith("array") else F.split(prepare(v, c.ascii_only), ",")
    texts = F.filter(F.transform(parts, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    numbers = F.transform(texts, lambda x: x.try_cast("bigint"))
    whole = F.forall(numbers, lambda x: x.isNotNull())
    by_bytes = F.transform(F.array_sort(F.transform(texts, lambda x: x.cast("binary"))), lambda x: x.cast("string"))
    members = F.when(whole, F.transform(F.array_sort(numbers), lambda x: x.cast("string"))).otherwise(by_bytes)
    return F.when(v.isNull() | (F.size(texts) == 0), F.lit(tx.NULL)).otherwise(F.concat(F.lit(tx.RELATION + "["), F.array_join(members, ","), F.lit("]")))
