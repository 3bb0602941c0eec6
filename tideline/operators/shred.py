"""Adaptive shredding: JSON records to columns, the most useful fields promoted, the rest kept as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERFLOW = "_unstructured_payload"
MAX_FIELDS, MAX_SCHEMA, METADATA = 64, 64, ("_offset", "_timestamp_ns")
_OPTIONS = {"mode": "FAILFAST"}


def is_object(payload: Column) -> Column:
    """Whether the text is a valid JSON object."""
    v = F.try_parse_json(payload)
    return v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")


def fields(payload: Column) -> Column:
    """The members as text: strings as they are, everything else as JSON; NULL for what isn't an object."""
    return F.when(is_object(payload), F.from_json(payload, "map<string,string>"))


def field_observations(rows: DataFrame, position: str, payload: str) -> DataFrame:
    """(field, n_seen, first_at): how many records have a member, and where it came first. Partial aggregates are made map-side."""
    seen = rows.select(F.col(position).alias("at"), F.explode(F.map_keys(fields(F.col(payload)))).alias("field")).where(F.col("field") != OVERFLOW)
    return seen.groupBy("field").agg(F.count(F.lit(1)).alias("n_seen"), F.min("at").alias("first_at"))


def first_come(observed: DataFrame, cap: int = MAX_FIELDS, promoted: Sequence[str] = ()) -> DataFrame:
    """The promoted fields: those promoted before, then new ones in the order of (record, name) up to the cap."""
    free = max(0, cap - len(promoted))
    new = observed.where(~F.col("field").isin(list(promoted))) if promoted else observed
    return new.orderBy("first_at", "field").limit(free).select("field")


def ranked_schema(observed: DataFrame, cap: int = MAX_SCHEMA - len(METADATA) - 1) -> DataFrame:
    """(rank, field): the most frequent fields, ties by name; the schema is metadata, these, overflow."""
    top = observed.orderBy(F.col("n_seen").desc(), "field").limit(cap)
    return top.select(F.row_number().over(Window.orderBy(F.col("n_seen").desc(), F.col("field"))).alias("rank"), "field", "n_seen")


def shred(rows: DataFrame, payload: str, promoted: Sequence[str], keep: Sequence[str] = (), null_mode: str = "literal") -> DataFrame:
    """One text column per promoted field in name order, then the overflow column.

    A member of another name goes to the overflow as part of a JSON object (NULL if there is none); a record that is no object has no
    columns and ``{"raw": value}`` as overflow, text that is no JSON {"raw": text}. JSON null is the text ``null`` or,
    with null_mode='missing', no value.
    """
    names = sorted(set(promoted) - {OVERFLOW})
    m, v = F.col("m_"), F.try_parse_json(F.col(payload))
    base = rows.withColumn("m_", fields(F.col(payload))).withColumn("v_", v)
    cols = []
    for n in names:
        text = F.try_element_at(m, F.lit(n))
        if null_mode == "literal":
            text = F.when(F.map_contains_key(m, n), F.coalesce(text, F.lit("null")))
        cols.append(text.alias(n))
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    rest = F.map_filter(F.col("v_").cast("map<string,variant>"), lambda k, _: ~F.array_contains(known, k))
    extra = F.when(m.isNotNull(), F.when(F.size(rest) > 0, F.to_json(rest)))
    raw = F.when(F.col("v_").isNotNull(), F.concat(F.lit('{"raw":'), F.to_json("v_"), F.lit("}"))).when(F.col(payload).isNotNull(), F.to_json(F.struct(F.col(payload).alias("raw"))))
    return base.select(*keep, *cols, F.when(m.isNotNull(), extra).otherwise(raw).alias(OVERFLOW))


def split_report(rows: DataFrame, key: str, payload: str, promoted: Sequence[str]) -> DataFrame:
    """Per record: whether it is an object, and how many members are columns and overflow."""
    keys = F.map_keys(F.coalesce(fields(F.col(payload)), F.create_map().cast("map<string,string>")))
    known = F.array(*[F.lit(p) for p in promoted])
    return rows.select(key, F.coalesce(is_object(F.col(payload)), F.lit(False)).alias("is_object"), F.size(F.array_intersect(keys, known)).cast("bigint").alias("n_columns"), F.size(F.array_except(keys, known)).cast("bigint").alias("n_overflow"))


def promotion_scores(rows: DataFrame, payload: str, part: str) -> DataFrame:
    """(field, n_seen, score, promote): how often a field is seen x how consistent its type is x how steadily it is there, and whether that passes 0.70.

    Consistency is the share of the commonest kind of value (string, number, boolean, object, array) among those that aren't null, stability the share of the
    ``part``s (files) with any record in which the field is seen. Kinds and parts fold map-side.
    """
    m = rows.select(part, F.try_parse_json(F.col(payload)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).select(part, F.col("v").cast("map<string,variant>").alias("m"))
    totals = m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(part).alias("parts"))
    of = F.schema_of_variant("value")
    kind = F.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of != "VOID", "number")
    seen = m.select(part, F.explode("m").alias("field", "value")).select(part, "field", kind.alias("kind"))
    kinds = seen.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("kind").isNotNull()
    per = kinds.groupBy("field").agg(F.sum("n").alias("n_seen"), F.coalesce(F.max(F.when(known, F.col("n"))) / F.sum(F.when(known, F.col("n"))), F.lit(0.0)).alias("consistency"))
    parts = seen.select("field", part).distinct().groupBy("field").agg(F.count(part).alias("n_parts"))
    score = F.col("n_seen") / totals.select("n").scalar() * F.col("consistency") * (F.col("n_parts") / totals.select("parts").scalar())
    return per.join(parts, "field").select("field", "n_seen", F.round(score, 6).alias("score"), (score >= 0.70).alias("promote"))


def mode_outcome(mode: str) -> Column:
    """What a schema mode makes of a record, from its split_report: strict rejects what doesn't fit, permissive keeps it as overflow or raw."""
    if mode == "strict":
        return F.when(~F.col("is_object") | (F.col("n_overflow") > 0), "rejected").otherwise("accepted")
    return F.when(~F.col("is_object"), "raw").when(F.col("n_overflow") > 0, "overflow").otherwise("accepted")
