"""Numbers: declared separators, exact decimals, half-up rounding to the declared scale."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions.text import let, prepare
from tallyline.plans.contract import Contract

_NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
WIDE = "decimal(38,18)"


def currency_pattern(extras: tuple[str, ...] = ()) -> str:
    """A leading sign or bracket, then a currency affix, longest first."""
    words = sorted({*extras, *tx.CURRENCIES}, key=lambda w: (-len(w), w))
    return r"^([(+-]?\s*)(?:" + "|".join(map(re.escape, words)) + r")\s*"


def _fixed(d: Column, scale: int) -> Column:
    """``d`` rounded half away from zero, with exactly ``scale`` digits; never a negative zero."""
    return F.round(d, scale).cast(f"decimal(38,{scale})").cast("string")


def decimal_of(v: Column, dtype: str) -> Column:
    """A native numeric column as an exact decimal (doubles through their shortest literal); null if it doesn't fit."""
    if dtype in ("double", "float"):
        v = v.cast("string")
    return v.try_cast(WIDE)


def number_token(v: Column, c: Contract, dtype: str = "string") -> Column:
    """A number's token. Beyond 38 digits (20 before the point) a value is ``e:NOT_FINITE``, never silently null."""
    empty = F.lit(tx.NULL) if c.empty_is_null else F.concat(F.lit(tx.NUMBER), F.lit(f"{0:.{c.scale}f}"))
    if dtype != "string":
        d = decimal_of(v.cast("int") if dtype == "boolean" else v, "int" if dtype == "boolean" else dtype)
        return F.when(v.isNull(), empty).when(d.isNull(), F.lit("e:NOT_FINITE")).otherwise(F.concat(F.lit(tx.NUMBER), _fixed(d, c.scale)))
    return let(prepare(v, ascii_only=True), lambda s: F.when(s.isNull() | (s == ""), empty).otherwise(_written(s, c)))


def _written(s: Column, c: Contract) -> Column:
    """The token of a written number that isn't blank. Each step is bound once for the next."""

    def signed(x: Column) -> Column:
        """Accounting negatives as a leading minus."""
        if not c.accounting_negatives:
            return x
        bracketed = F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")"))
        inner = F.when(bracketed, F.trim(F.substring(x, F.lit(2), F.length(x) - 2))).when(F.endswith(x, F.lit("-")), F.trim(F.substring(x, F.lit(1), F.length(x) - 1)))
        plus = lambda y: F.when(F.startswith(y, F.lit("+")), F.trim(F.substring(y, F.lit(2), F.length(y)))).otherwise(y)
        minus = lambda y: F.when((y != "") & ~F.startswith(y, F.lit("-")), F.concat(F.lit("-"), y)).otherwise(y)
        return let(inner, lambda y: F.when(y.isNull(), plus(x)).otherwise(minus(bare(plus(y)))))

    def bare(x: Column) -> Column:
        if c.group_sep:
            x = F.replace(x, F.lit(c.group_sep), F.lit(""))
        if c.decimal_sep != ".":
            x = F.replace(x, F.lit(c.decimal_sep), F.lit("."))
        return F.replace(x, F.lit(" "), F.lit(""))

    def token(x: Column, percent: Column) -> Column:
        d = x.try_cast(WIDE)
        if c.percent == "divide_100":
            d = F.when(percent, (d * F.lit("0.01").cast("decimal(3,2)")).cast(WIDE)).otherwise(d)
        fixed = F.concat(F.lit(tx.NUMBER), _fixed(d, c.scale))
        bad = ~F.rlike(x, F.lit(_NUMERIC)) | (F.lit(c.percent != "divide_100") & percent)
        return F.when(bad, F.lit("e:NOT_A_NUMBER")).otherwise(F.coalesce(fixed, F.lit("e:NOT_FINITE")))

    def stripped(x: Column) -> Column:
        percent = F.endswith(x, F.lit("%"))
        cut = F.when(percent, F.rtrim(F.substring(x, F.lit(1), F.length(x) - 1))).otherwise(x)
        return let(bare(signed(cut)) if not c.accounting_negatives else let(cut, lambda y: bare(signed(y))), lambda y: token(y, percent))

    return let(F.trim(F.regexp_replace(s, currency_pattern(c.currency_symbols), "$1")), stripped)


def near_boundary(d: Column, scale: int) -> Column:
    """Whether a decimal lies within 1e-9 of a step of a half step, where rounding may flip between runs."""
    steps = F.abs(d) * F.lit(10**scale)
    return F.abs(steps - F.floor(steps) - F.lit("0.5").cast("decimal(2,1)")) < F.lit("0.000000001").cast("decimal(10,9)")


def raw_decimal(v: Column) -> Column:
    """A raw value as an exact decimal, without any canonicalization; null if it isn't one. For control totals."""
    s = F.trim(v.cast("string"))
    return F.when(F.rlike(s, F.lit(_NUMERIC)), s.try_cast(WIDE))
