"""Schema registry rules: compatibility, fingerprints, lookups, widening."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a type may widen to, in order.
WIDER = {"int": ("long", "float", "double"), "long": ("double",), "float": ("double",)}


def compatibility(old: DataFrame, new: DataFrame, by: str | Sequence[str] = "subject") -> DataFrame:
    """Per subject whether the new fields (field, type, required) may follow the old ones, backward, forward and fully.

    Backward fails on a field required now that wasn't, and on a changed type of a shared field; a removal is allowed. Forward fails if a
    field required before is gone; types aren't compared. One full outer join on (subject, field).
    """
    by = [by] if isinstance(by, str) else list(by)
    o = old.select(*by, "field", F.col("type").alias("old_type"), F.col("required").alias("old_required"), F.lit(True).alias("in_old"))
    n = new.select(*by, "field", F.col("type").alias("new_type"), F.col("required").alias("new_required"), F.lit(True).alias("in_new"))
    j = o.join(n, [*by, "field"], "full_outer")
    newly = F.col("in_new") & F.col("new_required") & ~F.coalesce("old_required", F.lit(False))
    changed = F.col("in_old") & F.col("in_new") & (F.col("old_type") != F.col("new_type"))
    lost = F.col("in_old") & F.col("old_required") & F.col("in_new").isNull()
    no = lambda c: ~F.bool_or(F.coalesce(c, F.lit(False)))
    return j.groupBy(*by).agg(no(newly | changed).alias("backward"), no(lost).alias("forward")).withColumn("full", F.col("backward") & F.col("forward"))


def compatibility_steps(fields: DataFrame, steps: DataFrame) -> DataFrame:
    """(subject, version, previous, backward, forward, full): every step against the version before it.

    fields has the fields of every version (subject, version, field, type, required), steps (subject, version, previous) without nulls. A step
    between two versions without fields is compatible.
    """
    cols = ("subject", "version", "field", "type", "required")
    new = fields.join(steps, ["subject", "version"]).select(*cols)
    old = fields.withColumnRenamed("version", "previous").join(steps, ["subject", "previous"]).select(*cols)
    found = compatibility(old, new, ("subject", "version"))
    yes = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    return steps.join(found, ["subject", "version"], "left").select("subject", "version", "previous", yes("backward"), yes("forward"), yes("full"))


def latest(entries: DataFrame) -> DataFrame:
    """Each subject's latest version: the greatest version, then the lowest id."""
    per = entries.where("version IS NOT NULL").groupBy("subject").agg(F.max(F.struct("version", (-F.col("schema_id")).alias("neg"))).alias("m"), F.count_distinct("version").alias("n_versions"))
    return per.select("subject", F.col("m.version").alias("version"), (-F.col("m.neg")).alias("schema_id"), "n_versions")


def fingerprint(definition: Column) -> Column:
    """SHA-256 of a definition's canonical form: its fields by path, with canonical type and whether required, in order. Layout, order and spelling of a
    definition make no difference; NULL for what isn't one."""
    return F.sha2(canonical(definition), 256)


def canonical(definition: Column) -> Column:
    from .drift import _parsed

    required = F.coalesce(F.from_json(F.get_json_object(definition, "$.required_fields"), "array<string>"), F.array().cast("array<string>"))
    line = lambda f: F.concat(f["path"], F.lit(":"), f["type"], F.when(F.array_contains(required, f["path"]), F.lit("!")).otherwise(F.lit("")))
    return F.array_join(F.array_sort(F.transform(_parsed(definition), line)), "\n")


LEVELS = ("NONE", "BACKWARD", "FORWARD", "FULL")


def register(entries: DataFrame, levels: DataFrame | None = None, default: str = "BACKWARD") -> DataFrame:
    """Each submission (subject, definition, registered_at, schema_id) with outcome and assigned_version, as a registry would take them in their order.

    One that is the same as the latest registered (by fingerprint) gives that version again (``same``); else it must be compatible with the latest, and the latest only,
    at the subject's level (levels: subject, level; ``default`` without), and becomes the next version (``registered``) or not (``incompatible``); ``unreadable``
    is no definition. Whether a submission counts depends on those before it, so a subject's submissions are one task's, streamed in order with one state.
    """
    from .drift import parse_definition

    level = F.lit(default) if levels is None else F.coalesce("level", F.lit(default))
    own = entries if levels is None else entries.join(levels.where("subject IS NOT NULL").groupBy("subject").agg(F.min("level").alias("level")), "subject", "left")
    rows = own.where("subject IS NOT NULL").select("subject", "schema_id", "registered_at", "definition", F.upper(level).alias("level"), fingerprint(F.col("definition")).alias("fingerprint"))
    ordered = rows.repartition("subject").sortWithinPartitions("subject", "registered_at", "schema_id")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject, version, held, latest = None, 0, None, None
        for b in batches:
            outcomes, assigned = [], []
            for s, text, lev, mark in zip(*[b.column(c).to_pylist() for c in ("subject", "definition", "level", "fingerprint")], strict=True):
                if s != subject:
                    subject, version, held, latest = s, 0, None, None
                if mark is None:
                    outcome = "unreadable"
                elif mark == held:
                    outcome = "same"
                else:
                    new = _top_fields(text, parse_definition(text))
                    outcome = "registered" if latest is None or may_follow(latest, new, lev) else "incompatible"
                    if outcome == "registered":
                        version, held, latest = version + 1, mark, new
                outcomes.append(outcome)
                assigned.append(version if outcome in ("registered", "same") else None)
            yield pa.RecordBatch.from_arrays([b.column("subject"), b.column("schema_id"), b.column("fingerprint"), pa.array(outcomes, pa.string()), pa.array(assigned, pa.int32())], names=["subject", "schema_id", "fingerprint", "outcome", "assigned_version"])

    return ordered.mapInArrow(fold, "subject string, schema_id bigint, fingerprint string, outcome string, assigned_version int")


def _top_fields(text: str, fields: list[dict]) -> dict[str, tuple[str, bool]]:
    required = json.loads(text).get("required_fields")
    names = {n for n in required if isinstance(n, str)} if isinstance(required, list) else set()
    return {f["path"]: (f["type"], f["path"] in names) for f in fields if f["top"]}


def may_follow(old: dict[str, tuple[str, bool]], new: dict[str, tuple[str, bool]], level: str) -> bool:
    """The rules of ``compatibility`` for two definitions (name -> type, required)."""
    backward = all((n in old and old[n][1]) or not required for n, (_, required) in new.items()) and all(old[n][0] == new[n][0] for n in old.keys() & new.keys())
    forward = all(n in new for n, (_, required) in old.items() if required)
    return {"NONE": True, "BACKWARD": backward, "FORWARD": forward}.get(level, backward and forward)


def resolve(entries: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, subject, version, schema_id): the lowest version and id of each subject with a fingerprint."""
    known = entries.select("subject", "version", "schema_id", fingerprint(F.col("definition")).alias("fingerprint")).where("fingerprint IS NOT NULL AND version IS NOT NULL")
    first = known.join(fingerprints.select("fingerprint").distinct(), "fingerprint").groupBy("fingerprint", "subject").agg(F.min(F.struct("version", "schema_id")).alias("m"))
    return first.select("fingerprint", "subject", "m.version", "m.schema_id")


def usable(entries: DataFrame, deprecated: DataFrame) -> DataFrame:
    """The entries of versions that aren't deprecated (subject, version)."""
    return entries.join(deprecated.select("subject", "version").distinct(), ["subject", "version"], "left_anti")


def widened(a: str, b: str) -> str | None:
    """The type that holds both, or None."""
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if y in WIDER.get(x, ()):
            return y
    return "double" if {a, b} == {"long", "float"} else None


def widened_type(a: Column, b: Column) -> Column:
    """widened as an expression."""
    pairs = [(x, y, w) for x in _NUMBERS for y in _NUMBERS if (w := widened(x, y)) is not None]
    out = F.when(a == b, a)
    for x, y, w in pairs:
        out = out.when((a == x) & (b == y), w)
    return out


_NUMBERS = ("int", "long", "float", "double")


def evolve(*tables: DataFrame) -> DataFrame:
    """One table from files of several schema versions; what a version lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
