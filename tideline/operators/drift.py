"""Schemas that drift: rescue-column ingestion.

One rule does all the work here. A record, a set of named values, is *enforced* on a target schema: what the target knows and can take is
kept, what it doesn't know or can't take is rescued, what it has and doesn't get is missing. Rescued fields that are approved are *promoted* to
columns, and their values *replayed* into them.

* Of payloads the values are JSON and the target is the subject's latest definition. What can't be promoted stays as JSON beside the typed columns.
* Of a definition the values are its fields' types, and the target is the version before. A rescued unknown field is an addition; one that is tied to a
  missing field is promoted to that field's column, a rename, and its type replayed into it; what can't be taken is a change of type; the rest of the missing is removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: The spellings of the registry's types.
TYPE_NAMES = {
    "boolean": "bool", "bool": "bool",
    "int32": "int", "int": "int", "integer": "int",
    "int64": "long", "long": "long", "bigint": "long",
    "float32": "float", "float": "float", "real": "float",
    "float64": "double", "double": "double",
    "utf8": "string", "string": "string", "text": "string",
    "binary": "binary", "bytes": "binary",
    "struct": "struct", "record": "struct",
}

FIELD = "struct<path:string,top:boolean,type:string,field_id:string,former:array<string>>"
CHANGES = "array<struct<field_name:string,change_kind:string,former_name:string>>"


def type_name(raw: object) -> str:
    t = str(raw).strip().lower()
    return TYPE_NAMES.get(t, t)


def parse_definition(text: str | None) -> list[dict] | None:
    """The fields of a definition in either form, structs flattened to dotted paths; None if it isn't one."""
    try:
        root = json.loads(text)
        fields = root["fields"]
    except (TypeError, ValueError, KeyError, RecursionError):
        return None
    renamed = root.get("renamed_from")
    renamed = renamed if isinstance(renamed, dict) else {}
    if not isinstance(fields, (dict, list)):
        return None
    out: dict[str, dict] = {}
    todo = [("", fields)]
    while todo:
        prefix, fs = todo.pop()
        for name, raw, item in ((n, t, {}) for n, t in fs.items()) if isinstance(fs, dict) else ((f.get("name"), f.get("type"), f) for f in fs if isinstance(f, dict)):
            if not isinstance(name, str):
                continue
            inner = None
            if isinstance(raw, dict):  # {"Struct": {...}}
                raw, inner = next(iter(raw.items()), ("struct", {}))
            kind = type_name(raw)
            if kind == "struct":
                inner = item.get("fields") if inner is None else inner
            former = [a for a in item.get("aliases") or [] if isinstance(a, str)] if isinstance(item.get("aliases"), list) else []
            if not prefix and isinstance(renamed.get(name), str):
                former.append(renamed[name])
            no = item.get("field_id")
            out[prefix + name] = {"path": prefix + name, "top": not prefix, "type": kind, "field_id": None if no is None else str(no), "former": former}
            if kind == "struct" and isinstance(inner, (dict, list)):
                todo.append((f"{prefix}{name}.", inner))
    return list(out.values())


def enforce(target: Mapping[str, str], record: Iterable[tuple[str, Any]], take: Callable[[Any, str], tuple[bool, Any]]) -> tuple[dict[str, Any], list[tuple[str, Any]], list[str]]:
    """(kept, rescued, missing) of a record on a target of names and types. ``take`` says whether a type takes a value, and as what. Of two values for one name the first is kept."""
    kept: dict[str, Any] = {}
    rescued = []
    for name, value in record:
        fits, taken = take(value, target[name]) if name in target and name not in kept else (False, None)
        if fits:
            kept[name] = taken
        else:
            rescued.append((name, value))
    got = {name for name, _ in rescued}
    return kept, rescued, [name for name in target if name not in kept and name not in got]


def _take_type(incoming: str, kind: str) -> tuple[bool, str]:
    return incoming == kind, kind


def ties(unknown: list[dict], missing: list[dict]) -> list[tuple[dict, dict]]:
    """(former, renamed) for every unknown top-level field that a field id or a former name ties to a missing one."""
    by_id = {f["field_id"]: f for f in missing if f["top"] and f["field_id"] is not None}
    by_name = {f["path"]: f for f in missing if f["top"]}
    out = []
    for f in unknown:
        if f["top"]:
            was = by_id.get(f["field_id"]) if f["field_id"] is not None else None
            was = was or next((by_name[a] for a in f["former"] if a in by_name), None)
            if was:
                out.append((was, f))
    return out


def changes_between(target: list[dict], incoming: list[dict]) -> list[tuple[str, str, str | None]]:
    """(field_name, change_kind, former_name) of every change: what rescue ingestion does with the incoming definition on the target."""
    old, new = {f["path"]: f for f in target}, {f["path"]: f for f in incoming}
    types = {p: f["type"] for p, f in old.items()}
    _, rescued, missing = enforce(types, ((p, f["type"]) for p, f in new.items()), _take_type)
    unknown = [new[p] for p, _ in rescued if p not in old]
    out: list[tuple[str, str, str | None]] = [(p, "type_changed", None) for p, _ in rescued if p in old]
    promoted = {f["path"]: was["path"] for was, f in ties(unknown, [old[p] for p in missing])}
    for f in unknown:
        out.append((f["path"], "renamed" if f["path"] in promoted else "added", promoted.get(f["path"])))
    # replay: the promoted field's type into the column it had before
    _, again, _ = enforce({now: types[was] for now, was in promoted.items()}, ((now, new[now]["type"]) for now in promoted), _take_type)
    out += [(p, "type_changed", None) for p, _ in again]
    gone = set(promoted.values())
    return out + [(p, "removed", None) for p in missing if p not in gone]


def _parsed(column: Column) -> Column:
    @F.pandas_udf(f"array<{FIELD}>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(parse_definition)

    return parse(column)


def versions(entries: DataFrame) -> DataFrame:
    """(subject, version, fields): each version of a subject once, by its entry of the lowest schema_id.

    Entries without subject or version, or whose definition can't be read, are no versions; if another entry of the version
    can be read, that one stands for it.
    """
    read = entries.where("subject IS NOT NULL AND version IS NOT NULL").select("subject", "version", "schema_id", _parsed(F.col("definition")).alias("fields"))
    return read.where("fields IS NOT NULL").groupBy("subject", "version").agg(F.min_by("fields", F.struct(F.col("schema_id").isNull(), F.col("schema_id"), F.to_json("fields"))).alias("fields"))


def with_previous(of: DataFrame, key: str = "subject", order: str = "version", span: int = 512) -> DataFrame:
    """(key, order, previous): the next lower value of ``order`` present in the key.

    In two levels, so that no task orders all values of a hot key: inside spans of ``span`` values, and over the spans.
    """
    from pyspark.sql import Window as W

    at = of.select(key, order, F.floor(F.col(order) / span).alias("span")).distinct()
    inside = at.withColumn("near", F.lag(order).over(W.partitionBy(key, "span").orderBy(order)))
    spans = at.groupBy(key, "span").agg(F.max(order).alias("top"))
    before = spans.select(key, "span", F.lag("top").over(W.partitionBy(key).orderBy("span")).alias("far"))
    return inside.join(before, [key, "span"]).select(key, order, F.coalesce("near", "far").alias("previous"))


def version_changes(vs: DataFrame) -> DataFrame:
    """(subject, version, field_name, change_kind, former_name) of the versions made by ``versions``."""
    pairs = with_previous(vs).where("previous IS NOT NULL")
    old = vs.select("subject", F.col("version").alias("previous"), F.col("fields").alias("target"))
    both = vs.join(pairs, ["subject", "version"]).join(old, ["subject", "previous"])

    @F.pandas_udf(CHANGES)
    def diff(target: pd.Series, incoming: pd.Series) -> pd.Series:
        keys = ("field_name", "change_kind", "former_name")
        return pd.Series([[dict(zip(keys, c, strict=True)) for c in changes_between(list(a), list(b))] for a, b in zip(target, incoming, strict=True)], dtype=object)

    return both.select("subject", "version", F.explode(diff("target", "fields")).alias("c")).select("subject", "version", "c.*")


def schema_changes(entries: DataFrame) -> DataFrame:
    """(subject, version, field_name, change_kind): each change of a version against the next lower one of its subject.

    Method: the fields of the higher version are ingested on the lower one as target, by rescue, promotion and replay; see the module's text. A change
    of order, layout, spelling or required fields changes no field, so it isn't reported. A first version has no changes.
    A version registered several times counts once; an empty table gives an empty result. Each definition is read once and written as fields.
    """
    vs, _ = settle(versions(entries), "versions")
    return version_changes(vs).drop("former_name")


# --- payloads ---------------------------------------------------------------------------------------------------------


#: Which typed column holds a type's values, and the type a subject's own table gives it.
COLUMNS = {"bool": "bools", "int": "longs", "long": "longs", "float": "doubles", "double": "doubles", "string": "texts", "binary": "texts", "text": "texts"}
SPARK_TYPES = {"bool": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "binary": "string", "text": "string"}
TYPED = "struct<bools:map<string,boolean>,longs:map<string,bigint>,doubles:map<string,double>,texts:map<string,string>>"


def cast_value(value: object, kind: str) -> tuple[bool, bool | int | float | str | None]:
    """(fits, value): a JSON value as the type. A null fits every type but a struct. Widening fits, narrowing doesn't."""
    if kind not in COLUMNS:
        return False, None
    if value is None:
        return True, None
    if kind == "bool":
        return (True, value) if isinstance(value, bool) else (False, None)
    if kind in ("int", "long"):
        bits = 31 if kind == "int" else 63
        ok = isinstance(value, int) and not isinstance(value, bool) and -(1 << bits) <= value < 1 << bits
        return (True, value) if ok else (False, None)
    if kind in ("float", "double"):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool)
        try:
            return (True, float(value)) if ok else (False, None)
        except OverflowError:
            return False, None
    return (True, value) if isinstance(value, str) else (False, None)


def flatten(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of the members; objects are entered, so that a struct's fields are fields of their own."""
    todo = [(prefix, obj)]
    while todo:
        at, o = todo.pop()
        for k, v in o.items():
            if isinstance(v, dict) and v:
                todo.append((f"{at}{k}.", v))
            else:
                yield f"{at}{k}", v


def latest_name(path: str, version: int | None, renames: list[dict]) -> str:
    """The name at the latest version of a field that is called ``path`` at ``version`` (of unknown age: None)."""
    top, dot, rest = path.partition(".")
    for r in renames:
        if (version is None or r["version"] > version) and r["was"] == top:
            top = r["now"]
    return top + dot + rest


def _no_json(constant: str) -> None:
    raise ValueError(constant)


def route(payload: str | None, version: int | None, renames: list[dict], target: dict[str, str]) -> tuple[str, dict[str, Any], dict[str, object]]:
    """(status, typed, rescued) of one payload: its fields get their latest names and are enforced on the target. Rescued fields keep the names they came with."""
    try:
        obj = json.loads(payload, parse_constant=_no_json) if payload is not None else None
    except (ValueError, RecursionError):
        return "broken", {}, {"_raw": payload}
    if payload is None:
        return "null", {}, {}
    if not isinstance(obj, dict):
        return "not_object", {}, {"_raw": obj}
    fields = [(p, p if p in target else latest_name(p, version, renames), v) for p, v in flatten(obj)]
    fields = [f for f in fields if not (f[2] == {} and target.get(f[1]) == "struct")]
    kept, rescued, _ = enforce(target, ((name, (path, v)) for path, name, v in fields), lambda x, kind: cast_value(x[1], kind))
    rest = {path: v for _, (path, v) in rescued}
    return ("rescued" if rest else "clean"), kept, rest


def target_tables(entries: DataFrame) -> DataFrame:
    """(subject, target, renames): the types of each subject's latest version by path, and every rename on the way there."""
    vs, _ = settle(versions(entries), "versions")
    last = vs.groupBy("subject").agg(F.max_by("fields", "version").alias("fields"))
    target = last.select("subject", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["path"], f["type"]))).alias("target"))
    renames = version_changes(vs).where("change_kind = 'renamed'").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("version", F.col("former_name").alias("was"), F.col("field_name").alias("now")))).alias("renames"))
    return target.join(renames, "subject", "left")


def ingest(payloads: DataFrame, files: DataFrame, entries: DataFrame, promote: str = "approved") -> DataFrame:
    """One consistent, typed row per payload: (subject, payload_id, file_id, status, typed, rescued).

    ``typed`` has the values of the subject's columns by name, in the map of their type: bools, longs (int, long), doubles (float, double), texts (string,
    binary, and mixed scalars as text); null where the value is JSON null, absent where there is none. ``rescued`` is a JSON object of
    the fields the target doesn't know or can't take, null if there are none. ``subject_table`` gives a subject's own table with a column per field.
    ``status``: clean, rescued, null, broken (no JSON, or nested or long beyond what the parser takes), not_object, or no_schema
    where the file or its subject isn't known; the last four keep the payload as ``_raw``.

    A file without a version is read with the names of all versions. Repeated payloads (one
    payload_id) fold to one. With ``promote='approved'`` undeclared fields that a file of the subject lists in promoted_fields
    become columns: their type is the narrowest that holds all their rescued values (text for mixed scalars, none for arrays), and those values are replayed into it.

    A subject's plan (target and renames) reaches the tasks that need it as a row of its own ahead of the subject's payloads, not beside each of them. The
    payloads of a subject are spread over slices, so one with a third of all rows isn't one task's.
    """
    spark = payloads.sparkSession
    p = payloads.where("payload_id IS NOT NULL").groupBy("payload_id").agg(F.min(F.struct("file_id", "payload")).alias("p")).select("payload_id", "p.file_id", "p.payload")
    f = files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min(F.struct("subject", F.col("schema_version").alias("version"))).alias("f")).select("file_id", "f.subject", "f.version")
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    tables, _ = settle(target_tables(entries).coalesce(1), "targets")
    plans = tables.select("subject", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), none("payload_id", "bigint"), none("file_id", "bigint"), none("version", "int"), none("payload", "string"), F.to_json(F.struct("target", "renames")).alias("plan"))
    rows = p.join(f, "file_id", "left").select("subject", F.pmod(F.xxhash64("payload_id"), F.lit(slices)).cast("int").alias("slice"), "payload_id", "file_id", "version", "payload", none("plan", "string"))
    both = plans.unionByName(rows).repartition("subject", "slice").sortWithinPartitions("subject", "slice", F.col("plan").isNull())
    done, _ = settle(both.select("subject", "payload_id", "file_id", "version", "plan", "payload").mapInArrow(_enforce_batches, ROUTED), "routed")
    if promote == "approved":
        # a subject's promoted fields are a line; written, so that Spark knows how small they are
        promoted, _ = settle(approved_fields(done, files, tables).coalesce(1), "promoted")
        done = replay(done, promoted)
    return done.withColumn("rescued", F.when(F.size("rescued") > 0, _object("rescued")))


ROUTED = f"subject string, payload_id bigint, file_id bigint, status string, typed {TYPED}, rescued map<string,string>"
_TYPES = {"bools": pa.bool_(), "longs": pa.int64(), "doubles": pa.float64(), "texts": pa.string()}


def _map_array(rows: list[dict], kind: pa.DataType) -> pa.Array:
    offsets, keys, items = [0], [], []
    for r in rows:
        keys.extend(r)
        items.extend(r.values())
        offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(items, kind))


def _enforce_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """route() over rows of which a subject's plan comes first, then its payloads."""
    of, target, renames = None, None, []
    for b in batches:
        at, status, rescued = [], [], []
        typed: dict[str, list[dict]] = {c: [] for c in _TYPES}
        for i, (subject, version, plan, text) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
            if plan is not None:
                root = json.loads(plan)
                of, target, renames = subject, root["target"], root.get("renames") or []
                continue
            if subject is None or subject != of:
                s, good, bad = "no_schema", {}, {"_raw": text}
            else:
                s, good, bad = route(text, version, renames, target)
            try:
                texts = {_utf8(k): json.dumps(v) for k, v in bad.items()}
            except RecursionError:  # nested too deeply to be written again: kept as it came
                s, good, texts = "broken", {}, {"_raw": json.dumps(text)}
            at.append(i)
            status.append(s)
            rescued.append(texts)
            per: dict[str, dict] = {c: {} for c in _TYPES}
            for k, v in good.items():
                per[COLUMNS[target[k]]][_utf8(k)] = _utf8(v) if isinstance(v, str) else v
            for c in _TYPES:
                typed[c].append(per[c])
        kept = b.take(pa.array(at, pa.int64()))
        maps = pa.StructArray.from_arrays([_map_array(typed[c], t) for c, t in _TYPES.items()], names=list(_TYPES))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(status, pa.string()), maps, _map_array(rescued, pa.string())], names=["subject", "payload_id", "file_id", "status", "typed", "rescued"])


def _utf8(text: str) -> str:
    """Lone surrogates, which JSON allows and UTF-8 doesn't, as question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _object(column: str) -> Column:
    """A JSON object text from a map of JSON texts, keys in order."""
    items = F.array_sort(F.map_entries(column))
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(":"), e["value"])), ","), F.lit("}"))


def _kind(value: Column) -> Column:
    """The narrowest type of a JSON text; NULL for null, 'json' for an array or object."""
    first = F.substring(value, 1, 1)
    number = F.when(value.rlike("[.eE]") | F.expr("try_cast(value AS bigint)").isNull(), "double").otherwise("long")
    return F.when(first == '"', "string").when(first.isin("t", "f"), "bool").when(first.isin("[", "{"), "json").when(first != "n", number)


def approved_fields(done: DataFrame, files: DataFrame, tables: DataFrame) -> DataFrame:
    """(subject, promoted): the undeclared fields any file of the subject promoted, with the type that holds their values.

    Long and double make double, other mixtures of scalars text; a field with arrays or objects isn't promoted. One subject's promoted
    fields are a part of its schema, as many as its files name.
    """
    wanted = files.where("subject IS NOT NULL").select("subject", F.explode("promoted_fields").alias("path")).where("path IS NOT NULL").distinct()
    seen = done.where("subject IS NOT NULL").select("subject", F.explode("rescued").alias("path", "value")).select("subject", "path", _kind(F.col("value")).alias("kind")).where("kind IS NOT NULL")
    per = seen.groupBy("subject", "path").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("bool", "long", "double", "string", "json")])
    n = sum((F.col(k).cast("int") for k in ("bool", "long", "double", "string", "json")), F.lit(0))
    one = F.when(F.col("json"), "json").when((n == 2) & F.col("long") & F.col("double"), "double").when(n > 1, "text")
    for k in ("bool", "long", "double", "string"):
        one = one.when(F.col(k), k)
    # a declared field isn't promoted anew: its rescued values are mismatches, not missing columns
    typed = tables.select("subject", F.explode(F.map_keys("target")).alias("path"))
    return wanted.join(per, ["subject", "path"]).join(typed, ["subject", "path"], "left_anti").withColumn("kind", one).where("kind <> 'json'").groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "kind")))).alias("promoted"))


def replay(done: DataFrame, promoted: DataFrame) -> DataFrame:
    """Move the rescued values of promoted fields into typed columns; their types hold every value, so none is left behind."""
    rows = done.join(promoted, "subject", "left")
    kind = lambda k: F.try_element_at(F.col("promoted"), k)
    plain = lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    has = F.col("promoted").isNotNull() & (F.size("rescued") > 0)

    def added(column: str, kinds: tuple[str, ...], to: str) -> Column:
        mine = F.map_filter("rescued", lambda k, _: F.coalesce(kind(k).isin(*kinds), F.lit(False)))
        return F.when(has, F.map_concat(f"typed.{column}", F.transform_values(mine, lambda _, v: plain(v).cast(to)))).otherwise(F.col(f"typed.{column}")).alias(column)

    typed = F.struct(added("bools", ("bool",), "boolean"), added("longs", ("long",), "bigint"), added("doubles", ("double",), "double"), added("texts", ("string", "text"), "string"))
    rest = F.when(has, F.map_filter("rescued", lambda k, _: kind(k).isNull())).otherwise(F.col("rescued"))
    out = rows.select("subject", "payload_id", "file_id", "status", typed.alias("typed"), rest.alias("rescued"))
    return out.withColumn("status", F.when((F.col("status") == "rescued") & (F.size("rescued") == 0), "clean").otherwise(F.col("status")))


def subject_table(ingested: DataFrame, subject: str, target: Mapping[str, str]) -> DataFrame:
    """The table of one subject: a column of its own type per field of the target, a struct's fields by their dotted path. On a written table (write_tables) only its folder is read."""
    own = ingested.where(F.col("subject") == subject)
    cols = [F.try_element_at(F.col("typed")[COLUMNS[kind]], F.lit(path)).cast(SPARK_TYPES[kind]).alias(path) for path, kind in sorted(target.items()) if kind in COLUMNS]
    return own.select("payload_id", *cols, F.col("rescued").alias("_rescued"))


def write_tables(ingested: DataFrame, path: str) -> None:
    """All subjects' tables in one job, a folder per subject. A subject's rows are written by as many tasks as hold some."""
    ingested.write.partitionBy("subject").parquet(path)


def cells(ingested: DataFrame) -> DataFrame:
    """(subject, payload_id, field_name, bool_value, long_value, double_value, text_value): one row per value, in the column of its type."""
    names = {"bools": "bool_value", "longs": "long_value", "doubles": "double_value", "texts": "text_value"}
    kinds = {"bools": "boolean", "longs": "bigint", "doubles": "double", "texts": "string"}
    one = lambda c: F.transform(F.map_entries(f"typed.{c}"), lambda e: F.struct(e["key"].alias("field_name"), *[(e["value"] if o == c else F.lit(None).cast(kinds[o])).alias(names[o]) for o in names]))
    return ingested.select("subject", "payload_id", F.explode(F.concat(*[one(c) for c in names])).alias("v")).select("subject", "payload_id", "v.*")
