"""URL filters [native]: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Every URL is expanded into (host suffix, directory prefix) expressions, but only of the shapes that occur among
the rules (so many labels, so many slashes), which keeps the expansion of odd URLs bounded; for rules of more than
``MAX_SHAPES`` shapes, of all shapes up to their most labels and slashes. Expressions meet rules
in an equi-join on the first 32 bits of a SHA-256 digest; the full digest and the rule's whole path confirm.
Distinct (id, url) rows are expanded once and carry their number of copies.

A rule list of at most ``BROADCAST_RULES`` rows (counted first) is broadcast; a longer one is joined by a shuffle in
which the URL side is salted and the rules are repeated for each salt, so that a hot host spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 50_000
MAX_SHAPES = 4096
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path from there up to ``? #`` or the end.

    A null URL and one without ``://`` have both empty.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("|"), directory), 256)


def _directory(path: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), depth), F.lit("/")))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with digests. Rules without host or verdict go; of equal ones, block stays."""
    host, path = F.translate(F.col("host"), _UPPER, _LOWER), F.coalesce(F.col("path"), F.lit(""))
    out = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isin("allow", "block"))
    out = out.select(host.alias("r_host"), path.alias("r_path"), (F.col("verdict") == "block").alias("r_block"))
    out = out.groupBy("r_host", "r_path").agg(F.max("r_block").alias("r_block"))
    out = out.withColumn("r_depth", _slashes(F.col("r_path"))).withColumn("r_labels", _labels(F.col("r_host")))
    out = out.withColumn("r_digest", _digest(F.col("r_host"), _directory(F.col("r_path"), F.col("r_depth"))))
    return out.withColumn("r_prefix", F.substring("r_digest", 1, 8))


def url_filter(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """Judge every row's URL: (id, host, path, rule, verdict), one row for each input row.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (``host``
    plus ``path``) wins; at equal length the one with the longer host, then block. Without a rule: ``rule`` null and
    the default verdict. Null, empty and malformed URLs get empty host and path; repeated rows stay repeated; an
    empty table or rule list gives its natural result. Other columns of ``pages`` are not read.
    """
    prepared = prepare_rules(rules)
    shapes = [(r[0], r[1]) for r in prepared.select("r_labels", "r_depth").distinct().limit(MAX_SHAPES + 1).collect()]
    urls = pages.select(F.col(id_col).alias("u_id"), F.col(url_col).alias("u_url"))
    urls = urls.groupBy("u_id", "u_url").agg(F.count(F.lit(1)).alias("u_copies"))
    host, path = host_and_path(F.col("u_url"))
    urls = urls.withColumn("u_host", host).withColumn("u_path", path)

    def expression(labels: int, depth: int) -> Column:
        fits = (_labels(F.col("u_host")) >= labels) & (_slashes(F.col("u_path")) >= depth)
        return F.when(fits, _digest(F.call_function("substring_index", F.col("u_host"), F.lit("."), F.lit(-labels)), _directory(F.col("u_path"), depth)))

    if len(shapes) <= MAX_SHAPES:
        expressions = F.array_compact(F.array(*(expression(*s) for s in sorted(shapes)))) if shapes else F.array().cast("array<string>")
    else:
        most = prepared.agg(F.max("r_labels").alias("labels"), F.max("r_depth").alias("depth")).first()
        labels = F.sequence(F.lit(1), F.least(_labels(F.col("u_host")), F.lit(most["labels"])))
        depths = F.sequence(F.lit(0), F.least(_slashes(F.col("u_path")), F.lit(most["depth"])))
        suffix = lambda n: F.call_function("substring_index", F.col("u_host"), F.lit("."), -n)
        expressions = F.flatten(F.transform(labels, lambda n: F.transform(depths, lambda d: _digest(suffix(n), _directory(F.col("u_path"), d)))))
    wide = urls.withColumn("u_digest", F.explode_outer(expressions)).withColumn("u_prefix", F.substring("u_digest", 1, 8))
    confirmed = (
        (F.col("u_prefix") == F.col("r_prefix"))
        & (F.col("u_digest") == F.col("r_digest"))
        & F.startswith(F.col("u_path"), F.col("r_path"))
    )
    right = prepared.select("r_prefix", "r_digest", "r_host", "r_path", "r_block")
    if prepared.limit(broadcast_rules + 1).count() <= broadcast_rules:
        joined = wide.join(F.broadcast(right), confirmed, "left")
    else:
        wide = wide.withColumn("u_salt", F.pmod(F.xxhash64("u_id", "u_url"), F.lit(SALTS)))
        right = right.withColumn("r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = wide.join(right, confirmed & (F.col("u_salt") == F.col("r_salt")), "left")
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.col("r_block"), F.concat("r_host", "r_path").alias("rule"))
    best = joined.groupBy("u_id", "u_url", "u_copies", "u_host", "u_path").agg(F.max(F.when(F.col("r_host").isNotNull(), rank)).alias("best"))
    # Copies come back in blocks, so that no single array holds them all.
    block = 10_000
    best = best.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("u_copies") - 1) / block))))
    best = best.withColumn("c", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("u_copies") - F.col("b") * block))))
    return best.select(
        F.col("u_id").alias(id_col),
        F.col("u_host").alias("host"),
        F.col("u_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.r_block"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
