"""Text canonicalization.

All steps are JVM expressions. Spark has no built-in for NFC and full case folding: a pattern finds the texts that either could
change otherwise than ``lower`` does, few in most corpora, and an Arrow UDF sees these alone. ``ascii_only`` leaves it out.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INVISIBLE = r"[\p{Cf}\u200B-\u200D\u2060\uFEFF\u00AD\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_SPACES = r"[\p{Zs}\t]"
#: Typographic characters and their plain forms (fixed values).
PUNCTUATION_FROM = "‘’‚‛′“”„‟″‐‑‒–—―−"
PUNCTUATION_TO = "'''''\"\"\"\"\"-------"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value bound once, so that chains of tests on a value don't repeat its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class(members: list[int], more: str) -> str:
    """A character class of some code points, as ranges, and of named classes."""
    runs: list[list[int]] = []
    for c in members:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + more + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _characters() -> list[str]:
    return [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]


@cache
def not_normal() -> str:
    """A pattern that fits every text that isn't in normal form C (and some that are).

    A text is in it if none of its characters changes alone, none is a mark and none a Hangul vowel or final, which join what
    stands before them. Code points that the JVM doesn't know count as doubtful.
    """
    return _class([ord(c) for c in _characters() if not unicodedata.is_normalized("NFC", c)], r"\p{M}\p{Cn}\x{1161}-\x{1175}\x{11a8}-\x{11c2}")


@cache
def not_lower() -> str:
    """A pattern that fits every text whose case folding isn't its lower case: characters that fold to others, and sigmas, whose lower case depends on their place."""
    return _class([ord(c) for c in _characters() if c.casefold() != c.lower() or c in "Σς"], r"\p{Cn}")


def nfc(s: Column, raw: Column | None = None, ascii_only: bool = False) -> Column:
    """Normal form C. ``raw`` is a cheaper text that has all characters of ``s`` outside ASCII: it is what is tested."""
    if ascii_only:
        return s
    doubtful = F.rlike(s if raw is None else raw, F.lit(not_normal()))
    return F.when(doubtful, _nfc(F.when(doubtful, s))).otherwise(s)


def casefold(s: Column, ascii_only: bool = False) -> Column:
    if ascii_only:
        return F.lower(s)
    doubtful = F.rlike(s, F.lit(not_lower()))
    return F.when(doubtful, _folded(F.when(doubtful, s))).otherwise(F.lower(s))


def strip_invisible(s: Column) -> Column:
    return F.regexp_replace(s, _INVISIBLE, "")


def unify_whitespace(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), _SPACES, " ")


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \n]+|[ \n]+\z", "")


def collapse(s: Column) -> Column:
    """Runs of spaces as one; lines stay."""
    return F.regexp_replace(s, " +", " ")


def prepare(s: Column, ascii_only: bool = False) -> Column:
    """Invisible characters out, white space unified, NFC, trimmed."""
    return trim(nfc(unify_whitespace(strip_invisible(s)), s, ascii_only))


def fold_punctuation(s: Column) -> Column:
    return F.replace(F.translate(s, PUNCTUATION_FROM, PUNCTUATION_TO), F.lit("…"), F.lit("..."))


def cosmetic(s: Column, ascii_only: bool = False) -> Column:
    """The form in which only cosmetic differences vanish: punctuation, case and spaces folded."""
    return F.trim(collapse(casefold(fold_punctuation(s), ascii_only)))


def text_token(s: Column, *, collapse_ws: bool = True, fold: bool = False, empty_is_null: bool = True, ascii_only: bool = False) -> Column:
    out = prepare(s, ascii_only)
    if collapse_ws:
        out = collapse(out)
    if fold:
        out = casefold(out, ascii_only)
    # ``nullif`` binds its argument: the chain of steps is computed once.
    return F.coalesce(F.concat(F.lit("s:"), F.nullif(out, F.lit(""))), F.lit("z:") if empty_is_null else F.lit("s:"))


def join_key(s: Column, ascii_only: bool = False) -> Column:
    """The folded key under which two sides meet; empty texts have none."""
    token = text_token(s, fold=True, ascii_only=ascii_only)
    return F.when(token != "z:", token)
