"""One token for each cell: guards first, then the declared type's function. Types are declared, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions import numbers, values
from tallyline.functions.text import cosmetic, text_token
from tallyline.plans.contract import Contract, ContractError

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def canon(v: Column, c: Contract, side: str = "source", dtype: str = "string") -> Column:
    """The token of a cell of Spark type ``dtype``, on the ``source`` or ``target`` side. Data never raises."""
    if side not in ("source", "target"):
        raise ContractError(f"side must be source or target, not {side}")
    if c.ctype == "ignore":
        raise ContractError(f"{c.key} is ignored and has no token")
    numeric = dtype in NUMERIC or dtype.startswith("decimal")
    if c.ctype == "text":
        s = v.cast("string") if dtype != "string" else v
        out = text_token(s, collapse_ws=c.collapse_ws, fold=c.case == "fold", empty_is_null=c.empty_is_null, ascii_only=c.ascii_only or dtype != "string")
    elif c.ctype in ("number", "money"):
        out = numbers.number_token(v, c, dtype)
    elif c.ctype == "bool":
        out = values.bool_token(v, c, dtype)
    elif c.ctype == "date":
        out = values.date_token(v, c, side, dtype)
    elif c.ctype == "datetime":
        out = values.datetime_token(v, c, side, dtype)
    elif c.ctype == "selection":
        out = values.selection_token(v.cast("string"), c, side)
    elif c.ctype == "many2one":
        out = values.relation_token(v, c, dtype)
    else:
        out = values.relations_token(v, c, dtype)
    if side == "source" and c.identifier and numeric:
        out = F.when(v.isNotNull(), F.lit("e:IDENTIFIER_NUMERIC")).otherwise(out)
    if side == "source" and c.error_literals and dtype == "string":
        out = F.when(F.trim(v).isin(*tx.CELL_ERRORS), F.lit("e:CELL_ERROR")).otherwise(out)
    return out


def canon_columns(df: DataFrame, columns: Sequence[Contract], side: str = "source") -> dict[str, Column]:
    """Tokens by key, for the contracts' columns of ``df``."""
    types = dict(df.dtypes)
    return {c.key: canon(F.col(f"`{c.source_column}`"), c, side, types[c.source_column]) for c in columns if c.ctype != "ignore"}


def is_error(token: Column) -> Column:
    return F.startswith(token, F.lit(tx.ERROR))


def tag(token: Column) -> Column:
    return F.substring(token, 1, 2)


def payload(token: Column) -> Column:
    return F.substring(token, F.lit(3), F.length(token))


def error_code(token: Column) -> Column:
    return F.when(is_error(token), payload(token))


def equal(a: Column, b: Column) -> Column:
    """Tokens are equal if the same and no error; an error equals nothing, itself included."""
    return (a == b) & ~is_error(a)


def folded(token: Column, ascii_only: bool = False) -> Column:
    """A text token in its cosmetic form; others as they are."""
    return F.when(tag(token) == tx.TEXT, F.concat(F.lit(tx.TEXT), cosmetic(payload(token), ascii_only))).otherwise(token)


def shadow_contract(key: str, token_tag: str, scale: int = 2) -> Contract:
    """A contract for a column of which only the tokens' tag on the other side is known."""
    kinds = {tx.NUMBER: "number", tx.BOOL: "bool", tx.DATE: "date", tx.DATETIME: "datetime", tx.SELECTION: "selection", tx.RELATION: "many2one"}
    return Contract(key, kinds.get(token_tag, "text"), scale=scale, timezone="UTC")
