"""Staging: typed tokens, hashes, identity, duplicates and quarantine for each row of a dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline import taxonomy as tx
from tallyline.functions.canon import canon_columns, error_code, is_error
from tallyline.functions.hashing import bucket_of, extra_hash, folded_row_hash, identity_key, row_hash
from tallyline.functions.identifiers import is_ulid
from tallyline.functions.text import text_token
from tallyline.operators import scan
from tallyline.plans.contract import Contract, default_contract, slugify_all, spec_version, validate
from tallyline.sources.scratch import store


@dataclass
class Snapshot:
    """A staged side. ``read_complete`` travels with the rows: an incomplete read proves no absence."""

    rows: DataFrame
    columns: tuple[Contract, ...]
    uid: str = ""
    read_complete: bool = True
    blocking: bool = False
    row_count: int | None = None
    max_write_date: str | None = None

    @property
    def spec_version(self) -> str:
        return spec_version(self.columns)

    def count(self) -> int:
        if self.row_count is None:
            self.row_count = self.rows.count()
        return self.row_count


def pad_rows(df: DataFrame, cells: str, width: int | None = None, fill: str = "") -> DataFrame:
    """Ragged rows (an array column) padded on the right to the widest, or to ``width``."""
    if width is None:
        width = df.agg(F.max(F.size(cells))).first()[0] or 0
    return df.withColumn(cells, F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: F.coalesce(F.get(F.col(cells), i), F.lit(fill)))) if width else df


def is_blank_row(cells: Column) -> Column:
    """All cells null or white space; zero and false are not blank."""
    return F.forall(cells, lambda c: c.isNull() | (F.trim(c.cast("string")) == ""))


def named_rows(df: DataFrame, cells: str, headers: Sequence[str]) -> DataFrame:
    """An array of cells as one string column for each header's slug."""
    return df.select(*[c for c in df.columns if c != cells], *(F.get(F.col(cells), i).alias(s) for i, s in enumerate(slugify_all(headers))))


def token_map(tokens: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, t in tokens.items() for x in (F.lit(k), t))) if tokens else F.create_map().cast("map<string,string>")


def stage(
    df: DataFrame, columns: Sequence[Contract], *, side: str = "source", sync_id: str | None = None, extra: bool = True, keep: Sequence[str] = (), ascii_only: bool = False
) -> DataFrame:
    """Rows with ``canon`` (key to token), hashes, identity and quarantine; nothing is shuffled.

    identity_source: sync_id if the row has a valid one, else natural_key if all key tokens are present and readable,
    else none. ``quarantine_field`` is the first unreadable key in contract order; a missing required value quarantines
    too. Columns in ``keep`` pass through.
    """
    columns = [c for c in columns if c.ctype != "ignore"]
    validate(columns)
    spec = spec_version(columns)
    tokens = canon_columns(df, columns, side)
    names = {k: f"__t_{k}" for k in tokens}
    mapped = {c.source_column for c in columns} | {sync_id, *keep}
    others = [n for n in df.columns if n not in mapped] if extra else []
    typed = df.select(
        *(F.col(f"`{k}`") for k in keep),
        (F.when(is_ulid(F.col(sync_id)), F.upper(F.trim(sync_id))) if sync_id else F.lit(None).cast("string")).alias("sync_id"),
        *(t.alias(names[k]) for k, t in tokens.items()),
        *(text_token(F.col(f"`{o}`").cast("string"), ascii_only=ascii_only).alias(f"__x_{i}") for i, o in enumerate(others)),
    )
    cols = {k: F.col(n) for k, n in names.items()}
    keys = [cols[c.key] for c in sorted((c for c in columns if c.is_key), key=lambda c: (c.sequence, c.key))]
    usable = F.lit(bool(keys))
    for k in keys:
        usable = usable & (k != tx.NULL) & ~is_error(k)
    natural = identity_key(*keys) if keys else F.lit(None).cast("binary")
    first_bad = F.coalesce(*(F.when(is_error(cols[c.key]), F.lit(c.key)) for c in columns), F.lit(None).cast("string"))
    missing = F.coalesce(*(F.when(cols[c.key] == tx.NULL, F.lit(c.key)) for c in columns if c.required), F.lit(None).cast("string"))
    reasons = F.create_map(*(F.lit(x) for p in tx.QUARANTINE_REASONS.items() for x in p))
    extras = {s: F.col(f"__x_{i}") for i, s in enumerate(slugify_all(others))}
    out = typed.select(
        *(F.col(f"`{k}`") for k in keep),
        "sync_id",
        token_map(cols).alias("canon"),
        row_hash(cols, spec).alias("h_row"),
        folded_row_hash(cols, spec, ascii_only).alias("h_row_folded"),
        extra_hash(extras, spec).alias("h_extra"),
        F.when(usable, F.lower(F.hex(natural))).alias("natural_key"),
        F.coalesce(first_bad, missing).alias("quarantine_field"),
        F.when(first_bad.isNotNull(), F.try_element_at(reasons, error_code(F.element_at(token_map(cols), first_bad)))).when(missing.isNotNull(), F.lit("missing_required")).alias("quarantine_reason"),
    )
    source = F.when(F.col("sync_id").isNotNull(), F.lit("sync_id")).when(F.col("natural_key").isNotNull(), F.lit("natural_key")).otherwise(F.lit("none"))
    out = out.withColumn("identity_source", source)
    key = (
        F.when(F.col("identity_source") == "sync_id", identity_key(F.col("sync_id"))).when(F.col("identity_source") == "natural_key", F.unhex("natural_key"))
        .otherwise(identity_key(F.lit("h"), F.col("h_row")))
    )
    out = out.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key")))
    return out.withColumn("state", F.when(F.col("quarantine_reason").isNotNull(), F.lit("quarantined")).otherwise(F.lit("staged")))


def flag_duplicates(staged: DataFrame) -> DataFrame:
    """``n_identity`` and ``n_natural``: rows that share the identity and the natural key (0 without one).

    The staged rows are stored once. Counts are partial sums before their shuffle; those over 1 come back by ``join_counts``,
    which keeps the rows of a frequent key apart.
    """
    columns = staged.columns
    out = rows = store(staged, "staged")
    for key, name in (("key", "n_identity"), ("natural_key", "n_natural")):
        n = store(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where((F.col(name) > 1) & F.col(key).isNotNull()), "counts")
        out = join_counts(out, n, key, name).withColumn(name, F.coalesce(name, F.when(F.col(key).isNotNull(), 1).otherwise(0)).cast("bigint"))
    return out.select(*columns, "n_identity", "n_natural")


#: Keys of more than 1/HOT of the counted rows, so fewer than HOT, reach their rows by a broadcast.
HOT = 500


def join_counts(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` left-joined with the stored ``counts`` (key, name = rows of the key): frequent keys by broadcast, the others by shuffle.

    Rows of frequent keys and rows without a key take no part in the shuffle's key: they are dealt by a hash of the row.
    """
    total = counts.agg(F.sum(name)).first()[0] or 0
    hot = counts.where(F.col(name) > total / HOT).select(F.col(key).alias("__hot"), F.col(name).alias("__hot_n"))
    cold = counts.where(F.col(name) <= total / HOT).select(F.col(key).alias("__cold"), F.lit(0).cast("bigint").alias("__zero"), F.col(name).alias("__cold_n"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    away = F.col("__hot").isNotNull() | F.col(key).isNull()
    simple = [c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct"))]
    out = out.withColumn("__salt", F.when(away, F.pmod(F.xxhash64(*simple), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("bigint")))
    out = out.join(cold, (F.coalesce(F.col(key), F.lit("").cast(dict(rows.dtypes)[key])) == F.col("__cold")) & (F.col("__salt") == F.col("__zero")), "left")
    return out.select(*rows.columns, F.coalesce("__hot_n", "__cold_n").alias(name))


def quarantine_duplicates(flagged: DataFrame) -> DataFrame:
    """Duplicate identities outrank unreadable cells, these a missing required value."""
    twice = (F.col("n_identity") > 1) | (F.col("n_natural") > 1)
    return flagged.withColumn("quarantine_reason", F.when(twice, F.lit("duplicate_identity")).otherwise(F.col("quarantine_reason"))).withColumn(
        "state", F.when(twice, F.lit("quarantined")).otherwise(F.col("state"))
    )


def first_unreadable(canon: Column) -> Column:
    """The alphabetically first key whose token is an error."""
    return F.array_min(F.map_keys(F.map_filter(canon, lambda k, t: is_error(t))))


def persist_rows(stored: DataFrame, staged: DataFrame, *, run_complete: bool, tab_complete: bool, least: int = scan.LEAST) -> DataFrame:
    """Match staged rows with stored ones by their own identity only; say what happens to each.

    Columns: id (stored, null if new), key, h_row, change (new / changed / same / missing / kept). Each stored row is
    claimed once: equal keys pair up in row order, the rows of a frequent one over several tasks. Vanished rows become missing only if the run and tab were complete.
    """
    nth = lambda df, order: scan.numbered(df, ["identity_source", "key"], [order], "nth", least)
    old = nth(stored.select("id", "identity_source", "key", F.col("h_row").alias("old_hash")), "id")
    new = nth(staged.select("identity_source", "key", "h_row", "row_number"), "row_number").drop("row_number")
    both = old.join(new, ["identity_source", "key", "nth"], "full_outer")
    gone = F.lit("missing" if run_complete and tab_complete else "kept")
    change = F.when(F.col("id").isNull(), F.lit("new")).when(F.col("h_row").isNull(), gone).when(F.col("h_row") == F.col("old_hash"), F.lit("same")).otherwise(F.lit("changed"))
    return both.select("id", "identity_source", "key", F.coalesce("h_row", "old_hash").alias("h_row"), change.alias("change"))


FINDING_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("finding", "category", "severity", "key", "field", "delta_class", "source_token", "target_token", "message")]
)
