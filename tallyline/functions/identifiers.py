"""Identifiers, references and small text helpers."""

from __future__ import annotations

import re
import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_SECRET = r"(?i)\b(password|passwd|secret|token|api[_-]?key|private[_-]?key|authorization)(\"?\s*[:=]\s*\"?)([^\s\",;]+)"


def new_ulid(ms: int | None = None, randomness: bytes | None = None) -> str:
    """48 bits of milliseconds and 80 random bits."""
    n = (int(time.time() * 1000) if ms is None else ms) << 80 | int.from_bytes(secrets.token_bytes(10) if randomness is None else randomness, "big")
    return "".join(CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def is_ulid(s: Column) -> Column:
    return F.coalesce(F.rlike(F.upper(F.trim(s)), F.lit("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")), F.lit(False))


def derived_ulid(ms: int, *parts: Column) -> Column:
    """A ULID whose random part is a digest of ``parts``: the same plan gives the same identifiers."""
    head = new_ulid(ms, bytes(10))[:10]
    digest = F.sha2(F.concat_ws("\u001f", *parts), 256)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(4)]
    return F.concat(F.lit(head), F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", CROCKFORD))


def column_letters(index: Column) -> Column:
    """A zero-based column index as letters (to ZZZ)."""
    letter = lambda n: F.char(F.pmod(n, F.lit(26)) + 65)
    one, two = index, F.floor(index / 26).cast("int") - 1
    three = F.floor(two / 26).cast("int") - 1
    return F.when(index < 26, letter(one)).when(index < 702, F.concat(letter(two), letter(one))).otherwise(F.concat(letter(three), letter(two), letter(one)))


def cell_ref(tab: Column, column: Column, row: Column) -> Column:
    """``'tab'!B7``; quotes in the title are doubled; row and column count from 0 and 1."""
    return F.concat(F.lit("'"), F.replace(tab, F.lit("'"), F.lit("''")), F.lit("'!"), column_letters(column), row.cast("string"))


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def surrogate_gid(index: Column) -> Column:
    """The id of the i-th tab of a workbook that has no ids of its own."""
    return -(index + 1)


def duration_seconds(s: Column) -> Column:
    """``15m``, ``2h``, ``1d``, ``30s`` or plain seconds; null for others."""
    n = F.regexp_extract(F.trim(s), r"^([0-9]+)\s*([smhd]?)$", 1).try_cast("bigint")
    unit = F.regexp_extract(F.trim(s), r"^([0-9]+)\s*([smhd]?)$", 2)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), F.lit("never")).when(seconds < 60, F.concat(seconds.cast("bigint").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


def redacted(s: Column) -> Column:
    """Values of secret-looking settings replaced."""
    return F.regexp_replace(s, _SECRET, "$1$2***")


def redact(text: str) -> str:
    return re.sub(_SECRET, r"\1\2***", text)


def json_map(s: Column) -> Column:
    """A JSON object as a map of strings; anything else as an empty map."""
    return F.coalesce(F.from_json(s, "map<string,string>"), F.create_map().cast("map<string,string>"))


def clipped(s: Column, limit: int = 500) -> Column:
    over = F.length(s) - limit
    return F.when(over > 0, F.concat(F.substring(s, 1, limit), F.lit("... (+"), over.cast("string"), F.lit(")"))).otherwise(s)
