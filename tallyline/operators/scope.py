"""Scope rules, owners, removals, classification and dispatch of files: all compiled to one expression each."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.taxonomy import NODE_TYPES

#: Node types by exact media type (fixed values); prefixes and the rest follow in ``classify``.
APPS = "application/vnd.google-apps."
EXACT = {"folder": "folder", "spreadsheet": "spreadsheet", "document": "document", "presentation": "presentation", "drawing": "drawing", "shortcut": "shortcut"}
OFFICE = "application/vnd.openxmlformats-officedocument."
#: Node type -> (media type to export to, extension).
EXPORTS = {
    "spreadsheet": (OFFICE + "spreadsheetml.sheet", ".xlsx"),
    "document": (OFFICE + "wordprocessingml.document", ".docx"),
    "presentation": (OFFICE + "presentationml.presentation", ".pptx"),
    "drawing": ("image/png", ".png"),
}


@dataclass(frozen=True)
class Rule:
    """effect include or exclude; kind: subtree, drive, owner, mime, name, path; ``applies_to`` limits it to a node type."""

    effect: str
    kind: str
    value: str
    applies_to: str = ""


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression for the whole text."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def _matches(r: Rule) -> Column:
    if r.kind == "subtree":
        hit = F.array_contains("ancestors", r.value) | (F.col("id") == r.value)
    elif r.kind == "drive":
        hit = F.col("drive_id") == r.value
    elif r.kind == "owner":
        hit = F.exists("owners", lambda o: F.lower(o) == r.value.casefold())
    elif r.kind in ("mime", "name", "path"):
        c = F.col(r.kind)
        hit = c.rlike(glob_pattern(r.value)) if any(x in r.value for x in "*?[") else c == r.value
    else:
        raise ValueError(f"unknown rule kind {r.kind}")
    if r.applies_to:
        hit = hit & (F.col("node_type") == r.applies_to)
    return F.coalesce(hit, F.lit(False))


def in_scope(rules: Sequence[Rule]) -> Column:
    """Default: in. Any include that concerns a node's type makes its default out. Excludes always win."""
    included, wanted, excluded = F.lit(False), F.lit(False), F.lit(False)
    for r in rules:
        if r.effect == "include":
            wanted = wanted | (F.col("node_type") == r.applies_to if r.applies_to else F.lit(True))
            included = included | _matches(r)
        else:
            excluded = excluded | _matches(r)
    return ~excluded & (~wanted | included)


#: Rules up to which their table is broadcast (it is counted), and glob patterns in one expression.
BROADCAST_RULES, PATTERNS = 50_000, 500


def judge(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``nodes`` with ``in_scope`` by a table of rules (effect, kind, value, applies_to), as ``in_scope`` says it for a list.

    ``id`` is unique; a null or empty ``applies_to`` concerns all node types. Rules of equal values meet the nodes in one equi-join on (kind, value):
    a node has a key for its drive, owners, media type, name and path, and one for each ancestor and itself. Globs, which
    no equi-join can find, become alternations of up to ``PATTERNS`` patterns for each effect, kind and node type.
    """
    glob = F.col("kind").isin("mime", "name", "path") & F.rlike("value", F.lit(r"[*?\[]"))
    known = ("subtree", "drive", "owner", "mime", "name", "path")
    plain = rules.select("effect", "kind", F.when(F.col("kind") == "owner", F.lower("value")).otherwise(F.col("value")).alias("value"), F.coalesce("applies_to", F.lit("")).alias("applies_to"))
    plain = plain.distinct()
    if bad := [r["kind"] for r in plain.where(~F.col("kind").isin(*known)).select("kind").distinct().limit(3).collect()]:
        raise ValueError(f"unknown rule kinds {bad}")
    wanted = [r["applies_to"] for r in plain.where("effect = 'include'").select("applies_to").distinct().limit(len(NODE_TYPES) + 1).collect()]
    default_out = F.lit(True) if "" in wanted else F.coalesce(F.col("node_type").isin(*wanted), F.lit(False)) if wanted else F.lit(False)
    patterns: dict[tuple, list[str]] = {}
    for r in plain.where(glob).collect():  # they become expressions
        patterns.setdefault((r["effect"], r["kind"], r["applies_to"]), []).append(glob_pattern(r["value"]))
    hits = {"include": F.lit(False), "exclude": F.lit(False)}
    for (effect, kind, applies), found in patterns.items():
        for at in range(0, len(found), PATTERNS):
            hit = F.rlike(F.col(kind), F.lit("|".join(found[at : at + PATTERNS])))
            hits[effect] = hits[effect] | F.coalesce(hit & (F.col("node_type") == applies if applies else F.lit(True)), F.lit(False))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    keys = F.concat(
        F.transform(lists("ancestors"), lambda a: key("subtree", a)), F.transform(lists("owners"), lambda o: key("owner", F.lower(o))),
        F.array(key("subtree", F.col("id")), key("drive", F.col("drive_id")), *(key(k, F.col(k)) for k in ("mime", "name", "path"))),
    )
    exact = plain.where(~glob)
    exact = F.broadcast(exact) if exact.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else exact
    met = nodes.select("id", "node_type", F.explode(F.array_distinct(keys)).alias("k")).select("id", "node_type", "k.*").join(exact, ["kind", "value"])
    met = met.where((F.col("applies_to") == "") | (F.col("applies_to") == F.col("node_type")))
    verdicts = met.groupBy("id").agg(F.max(F.col("effect") == "include").alias("__in"), F.max(F.col("effect") != "include").alias("__out"))
    out = nodes.join(verdicts, "id", "left")
    included, excluded = (F.coalesce(c, F.lit(False)) | hits[e] for c, e in (("__in", "include"), ("__out", "exclude")))
    return out.withColumn("in_scope", ~excluded & (~default_out | included)).drop("__in", "__out")


def owned_by(emails: Sequence[str], owners: str = "owners") -> Column:
    """No owners, or one of the wanted."""
    wanted = F.array(*(F.lit(e.casefold()) for e in emails)) if emails else F.array().cast("array<string>")
    o = F.coalesce(F.col(owners), F.array().cast("array<string>"))
    return (F.size(o) == 0) | F.arrays_overlap(F.transform(o, F.lower), wanted)


def is_removal(removed: Column, trashed: Column) -> Column:
    return F.coalesce(removed, F.lit(False)) | F.coalesce(trashed, F.lit(False))


def changed_id(file_id: Column, nested_id: Column) -> Column:
    return F.coalesce(file_id, nested_id)


def classify(mime: Column, shortcut_target: Column | None = None) -> Column:
    """The node type of a media type; a shortcut's details outrank it."""
    out = F.when(shortcut_target.isNotNull(), F.lit("shortcut")) if shortcut_target is not None else F.when(F.lit(False), F.lit(""))
    for name, kind in EXACT.items():
        out = out.when(mime == APPS + name, F.lit(kind))
    return out.when(F.startswith(mime, F.lit(APPS)), F.lit("other")).otherwise(F.lit("blob"))


def is_workbook(mime: Column) -> Column:
    """Spreadsheets in the native or the office format."""
    return mime.isin(APPS + "spreadsheet", OFFICE + "spreadsheetml.sheet")


def export_media_type(node_type: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in EXPORTS.items() for x in (k, v[0]))), node_type)


def export_name(name: Column, node_type: Column) -> Column:
    """The name with the export's extension, once and without regard to case."""
    extension = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in EXPORTS.items() for x in (k, v[1]))), node_type), F.lit(""))
    return F.when(F.endswith(F.lower(name), extension), name).otherwise(F.concat(name, extension))


def dispatch(*, size_limit: int, allow_types: Sequence[str] = ()) -> tuple[Column, Column]:
    """(state, skip_reason) of a node: folders, shortcuts, unsupported, out of scope, forbidden and too large ones are skipped."""
    reason = (
        F.when(F.col("node_type") == "folder", F.lit("folder")).when(F.col("node_type") == "shortcut", F.lit("shortcut"))
        .when(~F.coalesce(F.col("scoped"), F.lit(True)), F.lit("out_of_scope"))
        .when(~F.col("node_type").isin(*(allow_types or ("spreadsheet", "document", "presentation", "drawing", "blob"))), F.lit("unsupported_mime"))
        .when(~F.coalesce(F.col("can_download"), F.lit(True)), F.lit("no_download_permission"))
        .when((F.col("node_type") == "blob") & (F.coalesce(F.col("size"), F.lit(0)) > size_limit), F.lit("too_large"))
    )
    return F.when(reason.isNull(), F.lit("ingested")).otherwise(F.lit("skipped")), reason


def blob_unchanged(md5: Column, ingested_md5: Column, stored: Column) -> Column:
    """Skip a download only if both checksums are known and equal and the content is there."""
    return F.coalesce(md5.isNotNull() & (md5 == ingested_md5) & stored, F.lit(False))
