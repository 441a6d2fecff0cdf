"""Row hashes, identity keys and buckets as binary expressions over built-in functions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline import taxonomy as tx


def lit(b: bytes) -> Column:
    return F.lit(bytearray(b))


def sha(b: Column, hex_digits: int = 64) -> Column:
    """Lower-case hex of the leading part of a SHA-256."""
    return F.substring(F.sha2(b, 256), 1, hex_digits)


def escaped(s: Column) -> Column:
    """A JSON string's content: backslash and quote first, then the control characters."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for raw, short in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(short))
    code = F.ascii
    hexed = lambda c: F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(code(c))), 2, "0"))
    rare = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(F.rlike(c, F.lit(r"[\x00-\x1F]")), hexed(c)).otherwise(c)), "")
    out = F.when(F.rlike(out, F.lit(r"[\x00-\x1F]")), rare).otherwise(out)
    return F.when(F.rlike(s, F.lit(r'[\x00-\x1F"\\]')), out).otherwise(s)


def jcs(tokens: Mapping[str, Column]) -> Column:
    """Canonical JSON of tokens; keys are known, so their order is too."""
    parts: list[Column] = []
    for i, k in enumerate(sorted(tokens)):
        parts += [F.lit(("," if i else "{") + f'"{k}":"'), escaped(tokens[k]), F.lit('"')]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _row(prefix: bytes, spec: str, tokens: Mapping[str, Column]) -> Column:
    return sha(F.concat(lit(prefix + spec.encode() + b"\0"), jcs(tokens).cast("binary")), 32)


def row_hash(tokens: Mapping[str, Column], spec: str) -> Column:
    return _row(tx.ROW_PREFIX, spec, tokens)


def folded_row_hash(tokens: Mapping[str, Column], spec: str, ascii_only: bool = False) -> Column:
    from tallyline.functions.canon import folded

    return _row(tx.FOLDED_PREFIX, spec, {k: folded(t, ascii_only) for k, t in tokens.items()})


def extra_hash(tokens: Mapping[str, Column], spec: str) -> Column:
    return _row(tx.EXTRA_PREFIX, spec, tokens)


def binary_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def header_fingerprint(headers: Sequence[str]) -> str:
    """Of canonical headers in any order."""
    return hashlib.sha256(tx.HEADER_PREFIX + b"\0".join(sorted(h.encode() for h in headers))).hexdigest()[:32]


def header_fingerprints(headers: Column) -> Column:
    """``header_fingerprint`` of an array of canonical headers; nulls don't count."""
    joined = F.array_join(F.array_sort(F.array_compact(headers)), "\0")
    return sha(F.concat(lit(tx.HEADER_PREFIX), joined.cast("binary")), 32)


def identity_key(*parts: Column) -> Column:
    """Length-prefixed parts as one binary key; null if a part is null."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p.cast("binary")) for p in parts]
    return F.concat(*framed)


def bucket_of(key: Column) -> Column:
    """0 to 255: the second byte of the key's digest."""
    return F.conv(F.substring(F.sha2(F.concat(lit(tx.BUCKET_PREFIX), key), 256), 3, 2), 16, 10).cast("int")


def quarantine_hash(key: Column) -> Column:
    """What an unreadable row puts in place of its row hash."""
    return sha(F.concat(lit(tx.QUARANTINE_PREFIX), key), 32)


def varint(n: Column) -> Column:
    """Unsigned LEB128 of a number below 2**35."""

    def byte(shift: int, more: bool) -> Column:
        low = F.shiftright(n.cast("bigint"), shift).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(low + 128 if more else low), 2, "0")

    out = None
    for size in range(1, 6):
        text = F.concat(*(byte(7 * i, i < size - 1) for i in range(size)))
        fits = n < (1 << 7 * size)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.unhex(out)
