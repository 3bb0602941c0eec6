"""Frequency of every distinct term by recursive radix spilling.

Terms are partitioned by bits of their hash to files in the shared folder; partitions too large are split by further bits, as
often as it takes; each partition is then aggregated by one task, out of core, with DuckDB.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch, shared_dir

#: Hash bits per level, and the bytes (of compressed spill files) beyond which a partition is split further.
RADIX_BITS, MOST_BYTES = 4, 64 << 20
MEMORY = "256MB"
RARE_BELOW, COMMON_OVER = 5, 0.4

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def _reject(_: str) -> None:
    raise ValueError


def _names_deep(text: str) -> Counter | None:
    """member_names for a text nested too deeply for the parser, without recursion."""
    names: Counter = Counter()
    stack: list[str] = []
    at, end = 0, len(text.rstrip(" \t\n\r"))
    want = "value"  # value, first_key, key, colon, after, first_item, end
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        mark, string, scalar = m.groups()
        if want in ("value", "first_item"):
            if mark == "]" and want == "first_item":
                stack.pop()
            elif mark in ("{", "["):
                if not stack and mark != "{":
                    return None
                stack.append(mark)
                want = "first_key" if mark == "{" else "first_item"
                continue
            elif (mark or not (string or scalar)) or not stack:
                return None
        elif want in ("first_key", "key"):
            if string:
                names[json.loads(string)] += 1
                want = "colon"
                continue
            if mark != "}" or want == "key":
                return None
            stack.pop()
        elif want == "colon":
            if mark != ":":
                return None
            want = "value"
            continue
        elif want == "after":
            if mark == "," and stack:
                want = "key" if stack[-1] == "{" else "value"
                continue
            if mark != ("}" if stack and stack[-1] == "{" else "]") or not stack:
                return None
            stack.pop()
        else:
            return None
        want = "after" if stack else "end"
    return names if want == "end" else None


def member_names(text: str | None) -> Counter | None:
    """How often each member name occurs in a JSON object, at any depth; None if the text isn't a valid JSON object."""
    if not text:
        return None
    names: Counter = Counter()

    def pairs(p: list[tuple[str, object]]) -> bool:
        for k, _ in p:
            names[k] += 1
        return True

    try:
        top = json.loads(text, object_pairs_hook=pairs, parse_constant=_reject, parse_int=len, parse_float=len)
    except RecursionError:
        return _names_deep(text)
    except ValueError:
        return None
    # an object comes back as True; so does the text "true"
    return names if top is True and text.lstrip(" \t\n\r")[:1] == "{" else None


def _clean(name: str) -> str:
    return name if name.isascii() else name.encode("utf-8", "replace").decode("utf-8")


def record_terms(df: DataFrame, record_id: str, payload: str) -> DataFrame:
    """(id, terms, ns): for each record id its member names and their counts; null terms for what isn't a JSON object."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, ns = [], []
            for text in b.column(1).to_pylist():
                c = member_names(text)
                if c is None:
                    terms.append(None)
                    ns.append(None)
                else:
                    merged: Counter = Counter()
                    for k, n in c.items():
                        merged[_clean(k)] += n
                    ks = sorted(merged)
                    terms.append(ks)
                    ns.append([merged[k] for k in ks])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int64()))], names=["id", "terms", "ns"])

    rows = df.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("bigint").alias("id"), F.col(payload).cast("string").alias("payload"))
    parsed = rows.mapInArrow(parse, "id bigint, terms array<string>, ns array<bigint>")
    return parsed.where("terms IS NOT NULL").groupBy("id").agg(F.min(F.struct("terms", "ns")).alias("t")).select("id", "t.terms", "t.ns")


def _bits(level: int) -> int:
    return RADIX_BITS * (level + 1)


def _spill(rows: DataFrame, at: str, level: int) -> None:
    """Write rows (radix, term, occurrences, records) to one folder per radix, by so many writers each as there are shuffle partitions for it, whatever the number of tasks before."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = F.pmod(F.xxhash64(F.lit("writer"), "term"), F.lit(max(1, parts >> RADIX_BITS))).cast("int")
    rows.withColumn("writer", writer).repartition(parts, "radix", "writer").drop("writer").write.partitionBy("radix").parquet(at)


def _folders(spark, at: str) -> list[tuple[str, int]]:
    """(path, bytes) of every radix partition under a spill."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(at)
    fs = root.getFileSystem(conf)
    found = [d.getPath() for d in fs.listStatus(root) if d.isDirectory() and d.getPath().getName().startswith("radix=")]
    return [(d.toString(), fs.getContentSummary(d).getLength()) for d in found]


def radix_aggregate(partial: DataFrame, most_bytes: int = MOST_BYTES, memory: str = MEMORY) -> DataFrame:
    """(term, occurrences, records) from partial (term, occurrences, records), whatever the number of distinct terms. A null term is a term.

    Rows are spilled by the first RADIX_BITS bits of their term's hash; all partitions over ``most_bytes`` are split by the next bits, in one job a level, and
    so on until all bits are used. Each task combines its rows before they are spilled again, so a hot term has one row a task. A partition that can't
    be split further has terms of one hash; like any other it is summed out of core by one task with DuckDB. The driver gets the size of each folder;
    files are listed by the tasks that read them. Spilled folders are dropped once aggregated.
    """
    spark = partial.sparkSession
    shared = shared_dir(spark)
    posix = re.sub(r"^file:/+", "/", shared) if re.match(r"^(file:|/)", shared) else None
    # DuckDB spills to the shared folder; where that is no POSIX path it doesn't spill but sums in several passes
    spill_to = f"{posix.rstrip('/')}/tideline" if posix else None

    def aggregate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                yield from sum_folder(folder, memory, spill_to)

    combined = partial.select("term", "occurrences", "records")
    level, at = 0, scratch(spark, "radix0")
    _spill(combined.withColumn("radix", F.shiftrightunsigned(F.xxhash64("term"), 64 - _bits(0))), at, 0)
    used, ready = [at], []
    while True:
        folders = _folders(spark, at)
        large = [p for p, n in folders if n > most_bytes] if _bits(level) < 64 else []
        ready += [p for p, _ in folders if p not in set(large)]
        if not large:
            break
        level += 1
        rows = spark.read.schema("term string, occurrences bigint, records bigint").parquet(*large)
        at = scratch(spark, f"radix{level}")
        used.append(at)
        _spill(_combine_counts(rows).withColumn("radix", F.shiftrightunsigned(F.xxhash64("term"), 64 - _bits(level))), at, level)
    tasks = spark.createDataFrame([(p,) for p in ready], "folder string")
    tasks = tasks.repartition(max(1, min(len(ready), 100_000)), "folder") if ready else tasks
    out = scratch(spark, "terms")
    tasks.mapInArrow(aggregate, "term string, occurrences bigint, records bigint").write.parquet(out)
    for a in used:
        drop_path(spark, a)
    return spark.read.schema("term string, occurrences bigint, records bigint").parquet(out)


def sum_folder(folder: str, memory: str = MEMORY, spill_to: str | None = None) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, records) of one spilled folder, summed with DuckDB under a memory limit.

    With ``spill_to`` DuckDB spills there. Without, what doesn't fit is read again in two passes, each over the terms of another remainder of the hash, and so on.
    """
    import duckdb
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else re.sub(r"^file:/+", "file:///", folder))
    dataset = ds.dataset(path, filesystem=fs, format="parquet", partitioning=None)
    own = f"{spill_to}/duck-{uuid.uuid4().hex}" if spill_to else ""
    if own:
        os.makedirs(own, exist_ok=True)
    todo = [(1, 0)]  # (passes, remainder)
    try:
        while todo:
            passes, mine = todo.pop()
            con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": own})
            try:
                con.register("spilled", dataset.scanner(columns=["term", "occurrences", "records"], batch_size=8192, use_threads=False).to_reader())
                some = f"WHERE hash(term) % {passes} = {mine}" if passes > 1 else ""
                got = con.sql(f"SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM spilled {some} GROUP BY term")
                # what can't spill is held until the pass has fitted, so that nothing is given twice
                yield from got.to_arrow_reader(8192) if own else got.to_arrow_table().to_batches(8192)
            except duckdb.OutOfMemoryException:
                if own or passes >= 1 << 20:
                    raise
                todo += [(2 * passes, mine), (2 * passes, mine + passes)]
            finally:
                con.close()
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)


def term_frequencies(
    payloads: DataFrame, record_id: str = "payload_id", payload: str = "payload", rare_below: int = RARE_BELOW, common_over: float = COMMON_OVER, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(field_name, n_occurrences, n_records, mark) of every member name in the payloads.

    A field name is a member name, as decoded, of an object at any depth; each ``record_id`` is one record; payloads that aren't
    a valid JSON object are no records. ``mark`` is ``rare`` below ``rare_below`` records, ``common`` in more than the share
    ``common_over`` of all records, else null; a name that is both is rare.

    Defined cases: a null record id is no record; rows of one record id fold to one (the least valid one, should they differ);
    names that differ only in case or form are different; a lone surrogate counts as a question mark; a member named twice in an
    object occurs twice; an empty table gives an empty result; other columns are never read.
    """
    counts = radix_aggregate(_count_terms(record_terms(payloads, record_id, payload)), most_bytes)
    n = counts.where("term IS NULL").agg(F.sum("records")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_over * n, "common")
    return counts.where("term IS NOT NULL").select(F.col("term").alias("field_name"), F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_records"), mark.alias("mark"))


_COUNTS = "term string, occurrences bigint, records bigint"
#: Entries a task holds before it passes them on.
HELD = 200_000


class _Held:
    """Counts per term inside one task."""

    def __init__(self) -> None:
        self.occurrences: Counter = Counter()
        self.records: Counter = Counter()

    def take(self) -> pa.RecordBatch:
        keys = list(self.occurrences)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([self.occurrences[k] for k in keys], pa.int64()), pa.array([self.records[k] for k in keys], pa.int64())], names=["term", "occurrences", "records"])
        self.occurrences.clear()
        self.records.clear()
        return out


def _count_terms(records: DataFrame) -> DataFrame:
    """(term, occurrences, records) of (terms, ns), combined inside each task. The null term counts the records, so that their number comes with the terms, without a pass of its own."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            terms, ns = b.column(0), b.column(1)
            g = pa.table([terms.flatten(), ns.flatten()], names=["term", "n"]).group_by("term").aggregate([("n", "sum"), ("n", "count")])
            for k, s, c in zip(g["term"].to_pylist(), g["n_sum"].to_pylist(), g["n_count"].to_pylist(), strict=True):
                held.occurrences[k] += s
                held.records[k] += c
            held.occurrences[None] += b.num_rows
            held.records[None] += b.num_rows
            if len(held.occurrences) > HELD:
                yield held.take()
        if held.occurrences:
            yield held.take()

    return records.select("terms", "ns").mapInArrow(count, _COUNTS)


def _combine_counts(rows: DataFrame) -> DataFrame:
    """Sum (term, occurrences, records) inside each task."""

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            g = pa.Table.from_batches([b]).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
            for k, o, r in zip(g["term"].to_pylist(), g["occurrences_sum"].to_pylist(), g["records_sum"].to_pylist(), strict=True):
                held.occurrences[k] += o
                held.records[k] += r
            if len(held.occurrences) > HELD:
                yield held.take()
        if held.occurrences:
            yield held.take()

    return rows.select("term", "occurrences", "records").mapInArrow(combine, _COUNTS)
