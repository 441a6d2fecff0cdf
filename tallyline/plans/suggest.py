"""Suggestions for undeclared columns: types, key columns and target fields, over tables of headers, words and fields.

Advisory only; contracts are declared. Headers, fields and vocabulary are DataFrames, so a catalogue of any number of tables is
one job: words meet words in equi-joins, candidates are ranked by a struct.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline import taxonomy as tx
from tallyline.plans.contract import slugify

#: A small vocabulary for the start; callers bring their own table (term, ctype, identifier). A term is a word or two neighbouring words.
TERMS = {
    "identifier": ("id", "sku", "barcode", "isbn", "code", "key", "serial number", "invoice number", "order number", "tax id", "phone", "zip"),
    "datetime": ("timestamp", "time"),
    "date": ("date", "birthday", "deadline", "due"),
    "bool": ("is", "has", "active", "flag", "enabled"),
    "money": ("price", "amount", "total", "cost", "balance", "fee", "salary"),
    "number": ("qty", "quantity", "count", "number", "age", "size", "weight", "percent"),
}
#: What observed values say about a column whose header says nothing.
KIND_TYPES = {"number": "number", "date_serial": "number", "bool": "bool", "text": "text", "mixed": "text", "error": "text", "empty": "text"}
#: A field fits by its words if it shares at least this part of all words of both.
LEAST_SHARE = 0.5


@F.pandas_udf(T.StringType())
def _slug(s: pd.Series) -> pd.Series:
    return s.map(slugify, na_action="ignore")


def slug(header: Column) -> Column:
    """An identifier for a header, as ``contract.slugify`` makes it; headers of ASCII letters don't go to Python."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = F.when((plain == "") | F.rlike(plain, F.lit("^[0-9]")), F.concat(F.lit("_"), plain)).otherwise(plain)
    other = F.rlike(header, F.lit(r"[^\x00-\x7F]")) | F.startswith(header, F.lit(tx.TEXT))
    return F.when(other, _slug(F.when(other, header))).otherwise(named)


def words(slug: Column) -> Column:
    return F.filter(F.split(slug, "_"), lambda w: w != "")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(term, ctype, identifier, rank) of ``TERMS``; of several fitting terms the least rank decides."""
    rows = [(t, "text" if kind == "identifier" else kind, kind == "identifier", i) for i, (kind, terms) in enumerate(TERMS.items()) for t in terms]
    return spark.createDataFrame(rows, "term string, ctype string, identifier boolean, rank int")


def types(headers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``headers`` (dataset, header, kind) with slug, ctype, identifier and is_key.

    The type is that of the fitting vocabulary term of least rank; if none fits, what the observed ``kind`` (``profile``; null:
    unknown) says. ``is_key``: the only column of its dataset whose slug is a strict identity.
    """
    named = headers.withColumn("slug", slug(F.col("header")))
    distinct = named.select("slug").distinct().withColumn("w", words(F.col("slug")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    terms = distinct.select("slug", F.explode(F.concat(F.col("w"), F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))
    best = terms.join(vocabulary, "term").groupBy("slug").agg(F.min(F.struct("rank", "ctype", "identifier")).alias("b"))
    observed = F.create_map(*(F.lit(x) for pair in KIND_TYPES.items() for x in pair))
    out = named.join(best, "slug", "left")
    out = out.select(*headers.columns, "slug", F.coalesce("b.ctype", F.try_element_at(observed, F.col("kind")), F.lit("text")).alias("ctype"), F.coalesce("b.identifier", F.lit(False)).alias("identifier"))
    keys = out.where(F.col("slug").isin(*tx.STRICT_IDENTITY_SLUGS)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.first("slug").alias("key_slug")).where("n = 1").drop("n")
    return out.join(keys, "dataset", "left").select(*headers.columns, "slug", "ctype", "identifier", F.coalesce(F.col("slug") == F.col("key_slug"), F.lit(False)).alias("is_key"))


def fields(headers: DataFrame, targets: DataFrame, fits: dict[str, tuple[str, ...]] = tx.FIELD_TYPES) -> DataFrame:
    """(slug, ctype, field): the target field for each different (slug, ctype) of ``headers``, null if none fits.

    ``targets`` are (field, ftype, label); only fields whose ``ftype`` can hold the type are offered (a null ``ftype`` holds any). Candidates share a word with
    the slug, in their name or label. An equal name comes first, then an equal label, then one whose words contain the slug's or
    are contained in them, then the largest share of common words, at least ``LEAST_SHARE``; then the shorter name, then the first by name.
    """
    wanted = headers.select("slug", "ctype").distinct().withColumn("w", F.array_distinct(words(F.col("slug"))))
    names = targets.select("field", "ftype", F.explode(F.array(F.struct(F.lit(True).alias("own"), slug(F.col("field")).alias("s")), F.struct(F.lit(False).alias("own"), slug(F.coalesce("label", F.lit(""))).alias("s")))).alias("n"))
    names = names.select("field", "ftype", "n.own", F.col("n.s").alias("named"), F.array_distinct(words(F.col("n.s"))).alias("v")).distinct()
    met = wanted.select("slug", "ctype", "w", F.explode("w").alias("word")).join(names.select("*", F.explode("v").alias("word")), "word")
    kinds = F.create_map(*(x for k, v in fits.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    holds = F.col("ftype").isNull() | F.array_contains(F.coalesce(F.try_element_at(kinds, F.col("ctype")), F.array(F.col("ftype"))), F.col("ftype"))
    shared = met.where(holds).groupBy("slug", "ctype", "field", "own", "named").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("w")).alias("a"), F.first(F.size("v")).alias("b"))
    share = F.col("n") / (F.col("a") + F.col("b") - F.col("n"))
    same, inside = F.col("slug") == F.col("named"), F.col("n") == F.least("a", "b")
    rank = F.struct(~(same & F.col("own")), ~same, ~inside, F.when(inside, F.lit(0.0)).otherwise(-share).alias("share"), F.length("field").alias("length"), "field")
    best = shared.where(inside | (share >= LEAST_SHARE)).groupBy("slug", "ctype").agg(F.min(rank)["field"].alias("field"))
    return wanted.select("slug", "ctype").join(best, ["slug", "ctype"], "left")


def bindings(columns: DataFrame, targets: DataFrame) -> DataFrame:
    """(dataset, key, problem) of declared columns that can't be written to the fields that they are bound to.

    ``columns``: dataset, key, ctype, field, decimal_sep, group_sep, scale; ``targets``: field, ftype. no_field, unknown_field, type_mismatch,
    separators (not one character, or both the same) and scale (outside 0 to 12); ignored columns have none.
    """
    known = targets.select(F.col("field").alias("t_field"), "ftype").distinct()
    bound = columns.where(F.col("ctype") != "ignore").join(known, F.nullif(F.col("field"), F.lit("")) == F.col("t_field"), "left")
    kinds = F.create_map(*(x for k, v in tx.FIELD_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    numeric = F.col("ctype").isin("number", "money")
    problems = F.array_compact(F.array(
        F.when(F.coalesce("field", F.lit("")) == "", F.lit("no_field")).when(F.col("t_field").isNull(), F.lit("unknown_field"))
        .when(~F.array_contains(F.element_at(kinds, F.col("ctype")), F.col("ftype")), F.lit("type_mismatch")),
        F.when(numeric & ((F.length("decimal_sep") != 1) | (F.col("decimal_sep") == F.col("group_sep"))), F.lit("separators")),
        F.when(numeric & ~F.col("scale").between(0, 12), F.lit("scale")),
    ))
    return bound.select("dataset", "key", F.explode(problems).alias("problem"))
