"""Queries of the log, overlay, lakehouse and governance operators, and the SQL that checks them.

``events`` stands for the log: its streams are the event types, arrival is (ts, event_id), and the payload a JSON object of its
columns. Journals are derived from it by a fixed rule, so that SQL can tell their outcome: an offset whose event_id divides by 11 fails
three times and is given up; else it fails event_id mod 3 times and is then acknowledged, or still leased if event_id divides by 13.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import govern, lookup, metrics, overlay, producer, quota, regions, registry, shred, transactions
from ..session import kept, scratch, settle
from ..session import table as t
from ..sources import ledger, log

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NTZ = "timestamp_ntz"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- the log -------------------------------------------------------------------------------------------------------------

LOG = "WITH log AS (SELECT event_type AS stream_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS log_offset, * FROM events)"


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """The folder's events with their offsets: numbered by hour and inside the hours."""
    e = t(spark, d, "events").withColumn("stream_id", F.col("event_type"))
    return log.dense_offsets(e, "stream_id", ["ts", "event_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))


def the_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of a folder's events, appended once a session in the lakehouse layout and read back."""
    rows = _appended(spark, d)
    at = kept(spark, f"log of {d}", lambda at: log.write_layout(rows, at, "ts", 1))
    return log.read_layout(spark, at, rows.schema)


@query(LOG + " SELECT stream_id, log_offset, event_id FROM log")
def log_append_offsets(spark, d):
    return _appended(spark, d).select("stream_id", "log_offset", "event_id")


@query(LOG + " SELECT stream_id, max(log_offset) + 1 AS head_offset, count(*) AS n_records FROM log GROUP BY 1")
def log_registry_heads(spark, d):
    return log.registry_heads(the_log(spark, d))


@query(LOG + " SELECT stream_id, log_offset, event_id, (SELECT max(log_offset) FROM log WHERE stream_id = 'click') > 149 AS has_more FROM log WHERE stream_id = 'click' AND log_offset BETWEEN 50 AND 149")
def log_fetch_range(spark, d):
    return log.fetch(the_log(spark, d), "click", 50, 100).select("stream_id", "log_offset", "event_id", "has_more")


@query(LOG + """, p AS (SELECT *, sum(length(props)) OVER (ORDER BY log_offset) AS b FROM log WHERE stream_id = 'click' AND log_offset BETWEEN 50 AND 149)
SELECT stream_id, log_offset, event_id, (SELECT max(log_offset) FROM log WHERE stream_id = 'click') > (SELECT max(log_offset) FROM p WHERE b <= 300) AS has_more FROM p WHERE b <= 300""")
def log_fetch_bytes(spark, d):
    return log.fetch(the_log(spark, d), "click", 50, 100, max_bytes=300, size=F.length("props")).select("stream_id", "log_offset", "event_id", "has_more")


@query("SELECT record_id, batch_id // 100 AS segment, row_number() OVER (ORDER BY batch_id // 100, batch_id, record_id) - 1 AS replay_no FROM (SELECT DISTINCT record_id, batch_id FROM record_entries)")
def log_ordered_replay(spark, d):
    r = t(spark, d, "record_entries").select("record_id", "batch_id", F.floor(F.col("batch_id") / 100).alias("segment")).distinct()
    return log.replay(r, "segment", ["batch_id", "record_id"]).select("record_id", "segment", "replay_no")


@query(LOG + " SELECT stream_id, log_offset // 500 AS chunk, bool_or(event_id % 997 = 0) AS broken FROM log GROUP BY 1, 2")
def chunk_verify(spark, d):
    """Sealed chunks against their checksums, after some payloads were altered."""
    rows = the_log(spark, d)
    sealed = log.seal(log.chunk_manifest(rows, 500, F.length("props")), rows, 500, "props")
    altered = rows.withColumn("props", F.when(F.col("event_id") % 997 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    now = log.seal(sealed.drop("crc32"), altered, 500, "props").select("stream_id", "start_offset", F.col("crc32").alias("found"))
    return sealed.join(now, ["stream_id", "start_offset"]).select("stream_id", F.floor(F.col("start_offset") / 500).alias("chunk"), (F.col("crc32") != F.col("found")).alias("broken"))


@query("SELECT count(DISTINCT batch_id // 100) AS n_segments, count(DISTINCT batch_id) AS n_batches, count(*) AS n_records, max(logical_offset) AS last_offset FROM record_entries")
def log_replay_report(spark, d):
    r = t(spark, d, "record_entries").select(F.floor(F.col("batch_id") / 100).alias("segment"), "batch_id", F.col("logical_offset").alias("log_offset"))
    return log.replay_report(r, "segment", ["batch_id"])


@query(LOG + " SELECT log_offset AS _offset, 1700000000000000000::BIGINT AS _timestamp_ns, props AS payload FROM log WHERE stream_id = 'view' AND log_offset >= 200")
def flight_projection(spark, d):
    own = the_log(spark, d).where("stream_id = 'view' AND log_offset >= 200").withColumn("bytes", F.col("props").cast("binary"))
    return log.flight_projection(own, "bytes", 1_700_000_000_000_000_000)


@query(LOG + """ SELECT stream_id, min(log_offset) AS start_offset, max(log_offset) AS end_offset, count(*) AS n_records, sum(length(props))::BIGINT AS n_bytes,
  stream_id || '/' || printf('%016x', min(log_offset)) || '.parquet' AS uri FROM log GROUP BY stream_id, log_offset // 500""")
def chunk_manifest(spark, d):
    return log.chunk_manifest(the_log(spark, d), 500, F.length("props"))


@query(LOG + """, chunks AS (SELECT stream_id, min(log_offset) AS s, max(log_offset) AS e FROM log GROUP BY stream_id, log_offset // 500)
SELECT l.stream_id, l.log_offset, c.s AS start_offset, c.e AS end_offset FROM log l LEFT JOIN chunks c ON c.stream_id = l.stream_id AND l.log_offset BETWEEN c.s AND c.e""")
def chunk_covering_lookup(spark, d):
    rows = the_log(spark, d)
    return lookup.covering(rows.select("stream_id", "log_offset"), log.chunk_manifest(rows, 500, F.length("props")), "stream_id", "log_offset", 500, ["start_offset", "end_offset"])


@query(LOG + """, idx AS (SELECT stream_id, log_offset AS at, event_id AS segment_id FROM log WHERE log_offset % 100 = 0)
SELECT l.stream_id, l.log_offset, i.at AS indexed_offset, i.segment_id FROM log l ASOF LEFT JOIN idx i ON l.stream_id = i.stream_id AND l.log_offset >= i.at""")
def sparse_floor_lookup(spark, d):
    rows = the_log(spark, d).select("stream_id", "log_offset", "event_id")
    index = rows.where("log_offset % 100 = 0").select("stream_id", "log_offset", F.col("log_offset").alias("indexed_offset"), F.col("event_id").alias("segment_id"))
    return lookup.asof_backward(rows.select("stream_id", "log_offset"), index, "stream_id", "log_offset", ["indexed_offset", "segment_id"], 1000)


@query("""WITH p AS (SELECT left(md5(s_suppkey::VARCHAR || '#' || v), 8) AS h, min(s_suppkey::VARCHAR) AS n FROM supplier, range(16) r(v) GROUP BY 1),
k AS (SELECT c_custkey, left(md5(c_custkey::VARCHAR), 8) AS h FROM customer)
SELECT c_custkey, coalesce(p.n, (SELECT arg_min(n, h) FROM p)) AS ring_node FROM k ASOF LEFT JOIN p ON p.h >= k.h""")
def ring_successor(spark, d):
    return lookup.ring_successor(t(spark, d, "customer").select("c_custkey"), t(spark, d, "supplier"), "c_custkey", "s_suppkey")


@query(LOG + " SELECT stream_id, min(log_offset) AS earliest, min(log_offset) FILTER (ts >= TIMESTAMP '2024-01-15') AS at_or_after, max(log_offset) + 1 AS latest FROM log GROUP BY 1")
def offset_for_time(spark, d):
    return lookup.offset_for_time(the_log(spark, d), "ts", F.lit("2024-01-15").cast(NTZ))


_BRIDGE = """WITH b AS (SELECT stream_id, min(logical_offset) AS source_base, max(logical_offset) - 5 AS high_water, 500 + 10 * min(logical_offset) AS own_base FROM record_entries WHERE stream_id IS NOT NULL GROUP BY 1),
c AS (SELECT group_id, stream_id, arg_max(log_offset, (seq, log_offset)) AS committed_offset FROM lease_deltas WHERE op = 'Ack' GROUP BY 1, 2),
j AS (SELECT c.*, own_base + committed_offset - source_base AS moved, CASE WHEN own_base IS NULL THEN 'unmapped' WHEN committed_offset > high_water THEN 'above_high_water' ELSE 'translated' END AS outcome FROM c LEFT JOIN b ON b.stream_id = c.stream_id)
"""


def _translated(spark, d):
    own = t(spark, d, "record_entries").where("stream_id IS NOT NULL").groupBy("stream_id").agg(F.min("logical_offset").alias("source_base"), (F.max("logical_offset") - 5).alias("high_water"))
    return lookup.translate(_commits(spark, d), own.withColumn("own_base", 500 + 10 * F.col("source_base")), ["stream_id"])


def _commits(spark, d):
    """The acknowledgements taken as commits of a stream-mode group."""
    return lookup.committed(t(spark, d, "lease_deltas").where("op = 'Ack'"), ["group_id", "stream_id"], "log_offset", ["seq"])


@query(_BRIDGE + "SELECT group_id, stream_id, committed_offset, CASE WHEN outcome = 'translated' THEN moved END AS own_offset, outcome FROM j")
def offset_translation(spark, d):
    return _translated(spark, d)


@query(_BRIDGE + "SELECT outcome, count(*) AS n, max(committed_offset) AS high FROM j GROUP BY 1")
def migration_report(spark, d):
    return _translated(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max("committed_offset").alias("high"))


@query("SELECT group_id, stream_id, arg_max(log_offset, (seq, log_offset)) AS committed_offset FROM lease_deltas WHERE op = 'Ack' GROUP BY 1, 2")
def committed_offsets(spark, d):
    return _commits(spark, d)


_REGIONS = """WITH b AS (SELECT DISTINCT batch_id AS pos, coalesce(region_name, 'nowhere') AS region, base_offset, record_count, batch_id % 7 AS region_epoch FROM batch_headers),
c AS (SELECT pos, region, CASE WHEN pos % 60 < 20 THEN 'promote' ELSE 'demote' END AS kind, pos % 5 AS new_epoch FROM b WHERE pos % 20 = 0),
z AS (SELECT *, count(*) FILTER (kind = 'demote') OVER (PARTITION BY region ORDER BY pos) AS z FROM c),
r AS (SELECT region, pos, kind, coalesce(first_value(CASE WHEN kind = 'demote' THEN new_epoch END) OVER (PARTITION BY region, z ORDER BY pos), 0) + count(*) FILTER (kind = 'promote') OVER (PARTITION BY region, z ORDER BY pos) AS epoch FROM z),
o AS (SELECT b.*, CASE WHEN r.kind = 'promote' THEN 'rejected:primary' WHEN b.region_epoch < coalesce(r.epoch, 0) THEN 'rejected:stale_epoch' ELSE 'applied' END AS outcome FROM b ASOF LEFT JOIN r ON r.region = b.region AND b.pos >= r.pos)
"""


def _applied(spark, d):
    h = t(spark, d, "batch_headers").select(F.col("batch_id").alias("at"), F.coalesce("region_name", F.lit("nowhere")).alias("region"), "base_offset", F.col("record_count").alias("n_records"), (F.col("batch_id") % 7).alias("region_epoch")).distinct()
    events = h.where("at % 20 = 0").select("region", "at", F.when(F.col("at") % 60 < 20, "promote").otherwise("demote").alias("kind"), (F.col("at") % 5).alias("new_epoch"))
    return regions.apply_batches(h, events, 1000)


@query(_REGIONS + "SELECT region, pos, outcome, CASE WHEN outcome = 'applied' THEN base_offset + record_count - 1 END AS last_offset FROM o")
def replication_outcomes(spark, d):
    """Batches sent to their own region, whose role changes with every twentieth."""
    return _applied(spark, d).select("region", F.col("at").alias("pos"), "outcome", "last_offset")


@query(_REGIONS + "SELECT region, region_epoch, arg_max(base_offset + record_count - 1, pos) AS last_offset FROM o WHERE outcome = 'applied' GROUP BY 1, 2")
def replication_applied(spark, d):
    return regions.replicated_offsets(_applied(spark, d), "region_epoch")


@query("""SELECT region_name, max(last_offset) AS own_head, arg_max(base_offset, batch_id) AS source_high, max(last_offset) - arg_max(base_offset, batch_id) AS offset_lag, count(*) FILTER (flags = 0) AS dual_writes
FROM (SELECT DISTINCT * FROM batch_headers WHERE region_name IS NOT NULL) GROUP BY 1""")
def migration_status(spark, d):
    h = t(spark, d, "batch_headers").where("region_name IS NOT NULL").distinct()
    return metrics.migration_status(h.select("region_name", F.col("batch_id").alias("at"), F.col("base_offset").alias("source_high"), F.col("last_offset").alias("own_head")), h.where("flags = 0"), ["region_name"])


# --- shredding -----------------------------------------------------------------------------------------------------------

_JSON = "json_object('event_id', event_id, 'user_id', user_id, 'event_type', event_type, 'value', value, 'k', CAST(json_extract(props, '$.k') AS BIGINT))"
_PAY = """WITH p AS (SELECT payload_id, min(payload) AS payload FROM shred_payloads GROUP BY 1), v AS (SELECT payload_id, payload, CASE WHEN json_valid(payload) THEN payload END AS j FROM p),
o AS (SELECT payload_id, payload, j, coalesce(json_type(j) = 'OBJECT', false) AS is_object FROM v),
k AS (SELECT payload_id, unnest(json_keys(j)) AS field FROM o WHERE is_object), f AS (SELECT field, count(*) AS n_seen, min(payload_id) AS first_at FROM (SELECT DISTINCT * FROM k) GROUP BY 1)
"""


def _payloads(spark, d):
    return t(spark, d, "shred_payloads").groupBy("payload_id").agg(F.min("payload").alias("payload"))


def _events_json(spark, d):
    e = t(spark, d, "events")
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    return e.select("event_id", "ts", "user_id", "event_type", "value", body.alias("payload"))


@query(_PAY + "SELECT field, n_seen, first_at FROM f")
def field_frequency(spark, d):
    return shred.field_observations(_payloads(spark, d), "payload_id", "payload")


@query(_PAY + "SELECT field FROM f ORDER BY first_at, field LIMIT 64")
def shred_first_come(spark, d):
    return shred.first_come(field_frequency(spark, d))


@query(_PAY + "SELECT row_number() OVER (ORDER BY n_seen DESC, field)::INT AS rank, field, n_seen FROM f ORDER BY n_seen DESC, field LIMIT 61")
def shred_rank_top61(spark, d):
    return shred.ranked_schema(field_frequency(spark, d))


@query(_PAY + """, top AS (SELECT field FROM f ORDER BY first_at, field LIMIT 64)
SELECT o.payload_id, coalesce(any_value(is_object), false) AS is_object, count(DISTINCT k.field) FILTER (k.field IN (SELECT field FROM top)) AS n_columns, count(DISTINCT k.field) FILTER (k.field NOT IN (SELECT field FROM top)) AS n_overflow
FROM o LEFT JOIN k ON k.payload_id = o.payload_id GROUP BY 1""")
def shred_fixed_cap(spark, d):
    names = [r.field for r in shred_first_come(spark, d).collect()]  # at most 64 names
    return shred.split_report(_payloads(spark, d), "payload_id", "payload", names)


@query(f"SELECT event_id, event_id::VARCHAR AS c_event_id, event_type AS c_event_type, user_id::VARCHAR AS c_user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS overflow_k, value AS overflow_value FROM events")
def shred_overflow_json(spark, d):
    s = shred.shred(_events_json(spark, d).withColumnRenamed("event_id", "id"), "payload", ["event_id", "event_type", "user_id"], keep=["id"])
    over = F.col(shred.OVERFLOW)
    return s.select(F.col("id").alias("event_id"), F.col("event_id").alias("c_event_id"), F.col("event_type").alias("c_event_type"), F.col("user_id").alias("c_user_id"), F.get_json_object(over, "$.k").cast("bigint").alias("overflow_k"), F.get_json_object(over, "$.value").cast("double").alias("overflow_value"))


@query(_PAY + "SELECT payload_id, payload IS NOT NULL AS has_overflow FROM o WHERE NOT coalesce(is_object, false)")
def shred_not_objects(spark, d):
    s = shred.shred(_payloads(spark, d), "payload", ["stock_ref"], keep=["payload_id", "payload"])
    return s.where(~F.coalesce(shred.is_object(F.col("payload")), F.lit(False))).select("payload_id", F.col(shred.OVERFLOW).isNotNull().alias("has_overflow"))


@query(_PAY + "SELECT payload_id, CASE WHEN is_object THEN j->>'$.unit' END AS unit, CASE WHEN is_object THEN j->>'$.never_there' END AS never_there FROM o")
def shred_null_fill(spark, d):
    """Promoted fields in name order; what a record lacks, or has as null, is null."""
    s = shred.shred(_payloads(spark, d), "payload", ["unit", "never_there"], keep=["payload_id"], null_mode="missing")
    assert s.columns == ["payload_id", "never_there", "unit", shred.OVERFLOW]
    return s.select("payload_id", "unit", "never_there")


@query(_PAY + "SELECT field FROM f WHERE field NOT IN ('unit', 'promoted_before') ORDER BY first_at, field LIMIT 8")
def shred_promoted_union(spark, d):
    """What may still be promoted where some fields were promoted by earlier batches."""
    return shred.first_come(field_frequency(spark, d), 10, ["unit", "promoted_before"])


@query(_PAY + """, g AS (SELECT payload_id, any_value(file_id) AS file_id FROM shred_payloads GROUP BY 1), m AS (SELECT k.payload_id, k.field, g.file_id, CASE json_type(json_extract(o.j, '$."' || k.field || '"')) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind
  FROM (SELECT DISTINCT * FROM k) k JOIN o USING (payload_id) JOIN g USING (payload_id)),
c AS (SELECT field, max(n)::DOUBLE / sum(n) AS consistency FROM (SELECT field, kind, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT field, count(*) AS n_seen, count(DISTINCT file_id) AS n_files FROM m GROUP BY 1), n AS (SELECT count(*) AS n, count(DISTINCT g.file_id) AS files FROM o JOIN g USING (payload_id) WHERE is_object)
SELECT field, n_seen, round(n_seen::DOUBLE / n * coalesce(consistency, 0) * (n_files::DOUBLE / files), 6) AS score, n_seen::DOUBLE / n * coalesce(consistency, 0) * (n_files::DOUBLE / files) >= 0.7 AS promote FROM s LEFT JOIN c USING (field), n""")
def shred_promotion_score(spark, d):
    rows = t(spark, d, "shred_payloads").groupBy("payload_id").agg(F.min("payload").alias("payload"), F.max("file_id").alias("file_id"))
    return shred.promotion_scores(rows, "payload", "file_id").select("field", "n_seen", "score", "promote")


# --- the lakehouse -------------------------------------------------------------------------------------------------------

_HIST = """WITH s AS (SELECT committed_at::DATE AS committed, count(*) AS n_files, sum(record_count)::BIGINT AS added_records, sum(file_size_bytes)::BIGINT AS added_bytes FROM data_files GROUP BY 1),
h AS (SELECT *, row_number() OVER (ORDER BY committed) AS snapshot_id, row_number() OVER (ORDER BY committed) - 1 AS p, sum(added_records) OVER (ORDER BY committed)::BIGINT AS total_records FROM s)
"""


def _history(spark, d):
    files = t(spark, d, "data_files").withColumn("day", F.to_date("committed_at"))
    return ledger.history(files, "day"), files


@query(_HIST + "SELECT committed, n_files, added_records, added_bytes, snapshot_id, nullif(p, 0) AS parent_id, total_records FROM h")
def snapshot_history(spark, d):
    return _history(spark, d)[0]


@query(_HIST + "SELECT committed, snapshot_id, total_records FROM h WHERE committed >= DATE '2024-03-05' OR snapshot_id = (SELECT max(snapshot_id) FROM h)")
def snapshot_expire(spark, d):
    return ledger.expire(_history(spark, d)[0], F.lit("2024-03-05").cast("date")).select("committed", "snapshot_id", "total_records")


@query(_HIST + "SELECT file_id, subject, record_count FROM data_files WHERE committed_at::DATE IN (SELECT committed FROM h WHERE snapshot_id <= 4)")
def snapshot_as_of(spark, d):
    h, files = _history(spark, d)
    return ledger.as_of(files, h, "day", 4).select("file_id", "subject", "record_count")


@query("SELECT file_path FROM data_files WHERE committed_at::DATE > DATE '2024-03-04' AND partition_spec_id <> 2")
def orphan_files(spark, d):
    """Files written since the last snapshot taken into account: of no snapshot, unless a writer has them pending."""
    f = t(spark, d, "data_files")
    used = f.where("CAST(committed_at AS DATE) <= date'2024-03-04'")
    return ledger.orphan_files(f.select("file_path"), used.select("file_path"), f.where("partition_spec_id = 2").select("file_path"))


@query("SELECT file_id, CASE WHEN file_id % 3 = 0 THEN file_id - 2 WHEN file_id = 1 THEN NULL ELSE file_id - 1 END AS expected_parent, nullif(file_id - 1, 0) AS current, CASE WHEN file_id % 3 = 0 THEN 'conflict' ELSE 'accepted' END AS outcome FROM data_files")
def occ_outcomes(spark, d):
    f = t(spark, d, "data_files").select("file_id")
    expected = F.when(F.col("file_id") % 3 == 0, F.col("file_id") - 2).when(F.col("file_id") > 1, F.col("file_id") - 1)
    return ledger.commit_outcomes(f.withColumn("expected_parent", expected).withColumn("current", F.when(F.col("file_id") > 1, F.col("file_id") - 1)))


_DUE = "SELECT file_id, greatest(epoch_ms(committed_at) % 100000 - 4000, 0) >= 60000 AS standard_due, greatest(epoch_ms(committed_at) % 100000 - 4000, 0) >= 5000 AS fast_due FROM data_files"


@query(_DUE)
def commit_due(spark, d):
    now = F.pmod(F.unix_millis(F.col("committed_at").cast("timestamp")), F.lit(100_000))
    return t(spark, d, "data_files").select("file_id", ledger.due(F.lit(4000), now, "standard").alias("standard_due"), ledger.due(F.lit(4000), now, "fast").alias("fast_due"))


@query("SELECT subject, count(*) AS n_files, sum(file_size_bytes)::BIGINT AS n_bytes, round(avg(file_size_bytes), 3) AS mean_bytes, round(avg((file_size_bytes < 4096)::INT), 6) AS small_share FROM data_files GROUP BY 1")
def file_hygiene(spark, d):
    return metrics.hygiene(t(spark, d, "data_files"), 4096, ["subject"])


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN NULL ELSE value END AS humidity, event_id, event_type FROM events")
def schema_evolution_union(spark, d):
    e = t(spark, d, "events")
    old = e.where("ts < timestamp_ntz '2024-01-10'").select("event_id", "event_type")
    new = e.where("ts >= timestamp_ntz '2024-01-10'").select("event_id", "event_type", F.col("value").alias("humidity"))
    return registry.evolve(old, new)


@query("SELECT event_type, event_id, value, ts::DATE AS event_date FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' AND event_type = 'click'")
def partitioned_round_trip(spark, d):
    at = scratch(spark, "layout")
    rows = the_log(spark, d).select("stream_id", "log_offset", "event_type", "event_id", "value", F.col("ts").alias("ingest_ts"))
    log.write_layout(rows, at, buckets=4, codec="zstd")
    kept = log.read_layout(spark, at).where("event_date BETWEEN date'2024-01-03' AND date'2024-01-05' AND stream_id = 'click'")
    return kept.select("event_type", "event_id", "value", "event_date")


@query("SELECT event_id, user_id, event_type, value FROM events")
def ledger_round_trip(spark, d):
    book = ledger.Ledger(spark, scratch(spark, "ledger"))
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    book.append(e.where("event_id % 2 = 0"), commit_id="even")
    book.append(e.where("event_id % 2 = 1"), codec="zstd", commit_id="odd")
    book.append(e.where("event_id % 2 = 1"), commit_id="odd")  # a repeated micro-batch adds nothing
    return book.read()


# --- schemas -------------------------------------------------------------------------------------------------------------


_TYPES = "CASE lower(t) WHEN 'boolean' THEN 'bool' WHEN 'int32' THEN 'int' WHEN 'integer' THEN 'int' WHEN 'int64' THEN 'long' WHEN 'bigint' THEN 'long' WHEN 'float32' THEN 'float' WHEN 'real' THEN 'float' WHEN 'float64' THEN 'double' WHEN 'utf8' THEN 'string' WHEN 'text' THEN 'string' WHEN 'bytes' THEN 'binary' WHEN 'record' THEN 'struct' ELSE lower(t) END"
_STEPS = f"""WITH e AS (SELECT subject, version, arg_min(definition::JSON, schema_id) AS j FROM schema_entries GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT subject, version, lag(version) OVER (PARTITION BY subject ORDER BY version) AS previous FROM e) WHERE previous IS NOT NULL),
l AS (SELECT subject, version, j, unnest(json_extract(j, '$.fields[*]')) AS f FROM e WHERE json_type(j, '$.fields') = 'ARRAY'),
o AS (SELECT subject, version, j, unnest(json_keys(j, '$.fields')) AS k FROM e WHERE json_type(j, '$.fields') = 'OBJECT'),
r AS (SELECT subject, version, j, f->>'$.name' AS field, f->>'$.type' AS t FROM l
  UNION ALL SELECT subject, version, j, k, CASE WHEN json_type(json_extract(j, '$.fields."' || k || '"')) = 'OBJECT' THEN 'struct' ELSE json_extract_string(j, '$.fields."' || k || '"') END FROM o),
x AS (SELECT subject, version, field, {_TYPES} AS type, coalesce(list_contains(CAST(json_extract(j, '$.required_fields') AS VARCHAR[]), field), false) AS required FROM r),
c AS (SELECT s.subject, s.version, n.field, n.type, n.required, true AS is_new FROM s JOIN x n USING (subject, version)
  UNION ALL SELECT s.subject, s.version, p.field, p.type, p.required, false FROM s JOIN x p ON p.subject = s.subject AND p.version = s.previous),
g AS (SELECT subject, version, field, bool_or(is_new) AS here, bool_or(NOT is_new) AS there, min(type) FILTER (is_new) AS tn, min(type) FILTER (NOT is_new) AS tp,
  coalesce(bool_or(required) FILTER (is_new), false) AS rn, coalesce(bool_or(required) FILTER (NOT is_new), false) AS rp FROM c GROUP BY 1, 2, 3),
b AS (SELECT subject, version, NOT bool_or((rn AND NOT rp) OR (here AND there AND tn <> tp)) AS backward, NOT bool_or(rp AND NOT here) AS forward FROM g GROUP BY 1, 2)
SELECT subject, version, previous, coalesce(backward, true) AS backward, coalesce(forward, true) AS forward, coalesce(backward AND forward, true) AS "full" FROM s LEFT JOIN b USING (subject, version)"""


@query(_STEPS)
def schema_compatibility(spark, d):
    from ..operators import drift

    entries = t(spark, d, "schema_entries")
    vs, _ = settle(drift.versions(entries), "versions")
    readable = entries.where(F.get_json_object("definition", "$.fields").isNotNull())
    required = readable.groupBy("subject", "version").agg(F.min_by("definition", "schema_id").alias("definition"))
    required = required.select("subject", "version", F.from_json(F.get_json_object("definition", "$.required_fields"), "array<string>").alias("required_fields"))
    flat = vs.join(required, ["subject", "version"], "left").select("subject", "version", F.explode("fields").alias("f"), "required_fields").where("f.top")
    fields = flat.select("subject", "version", F.col("f.path").alias("field"), F.col("f.type").alias("type"), F.coalesce(F.array_contains("required_fields", F.col("f.path")), F.lit(False)).alias("required"))
    return registry.compatibility_steps(fields, drift.with_previous(vs).where("previous IS NOT NULL"))


@query("SELECT subject, max(version) AS version, arg_max(schema_id, (version, -schema_id)) AS schema_id, count(DISTINCT version) AS n_versions FROM schema_entries GROUP BY 1")
def schema_latest(spark, d):
    return registry.latest(t(spark, d, "schema_entries"))


_CANON = f"""WITH e AS (SELECT schema_id, subject, version, registered_at, definition::JSON AS j FROM schema_entries),
l AS (SELECT schema_id, subject, version, registered_at, j, unnest(json_extract(j, '$.fields[*]')) AS f FROM e WHERE json_type(j, '$.fields') = 'ARRAY'),
o AS (SELECT schema_id, subject, version, registered_at, j, unnest(json_keys(j, '$.fields')) AS k FROM e WHERE json_type(j, '$.fields') = 'OBJECT'),
ov AS (SELECT *, json_extract(j, '$.fields."' || k || '"') AS v FROM o),
r AS (SELECT schema_id, subject, version, registered_at, j, f->>'$.name' AS path, f->>'$.type' AS t FROM l
  UNION ALL SELECT schema_id, subject, version, registered_at, j, k, CASE WHEN json_type(v) = 'OBJECT' THEN 'struct' ELSE v->>'$' END FROM ov
  UNION ALL SELECT schema_id, subject, version, registered_at, j, path || '.' || (c->>'$.name'), c->>'$.type' FROM (SELECT schema_id, subject, version, registered_at, j, f->>'$.name' AS path, unnest(json_extract(f, '$.fields[*]')) AS c FROM l WHERE lower(f->>'$.type') IN ('struct', 'record'))
  UNION ALL SELECT schema_id, subject, version, registered_at, j, k || '.' || c, json_extract_string(i, '$."' || c || '"') FROM (SELECT schema_id, subject, version, registered_at, j, k, i, unnest(json_keys(i)) AS c FROM (SELECT *, json_extract(v, '$.*')[1] AS i FROM ov WHERE json_type(v) = 'OBJECT'))),
x AS (SELECT DISTINCT schema_id, subject, version, registered_at, path || ':' || {_TYPES} || CASE WHEN list_contains(CAST(json_extract(j, '$.required_fields') AS VARCHAR[]), path) THEN '!' ELSE '' END AS line FROM r),
c AS (SELECT schema_id, subject, version, registered_at, sha256(string_agg(line, E'\\n' ORDER BY line)) AS fingerprint FROM x GROUP BY 1, 2, 3, 4)
"""


@query(_CANON + "SELECT schema_id, version, fingerprint FROM c")
def schema_fingerprints(spark, d):
    return t(spark, d, "schema_entries").select("schema_id", "subject", "version", "registered_at", registry.fingerprint(F.col("definition")).alias("fingerprint")).distinct().select("schema_id", "version", "fingerprint")


@query(_CANON + """, g AS (SELECT *, coalesce(fingerprint <> lag(fingerprint) OVER w, true) AS fresh FROM c WINDOW w AS (PARTITION BY subject ORDER BY registered_at, schema_id))
SELECT subject, schema_id, CASE WHEN fresh THEN 'registered' ELSE 'same' END AS outcome, count(*) FILTER (fresh) OVER (PARTITION BY subject ORDER BY registered_at, schema_id)::INT AS assigned_version FROM g""")
def schema_register(spark, d):
    """All entries submitted anew in their order, to subjects without a compatibility level; levels are tested against a plain registry."""
    entries = t(spark, d, "schema_entries").select("subject", "schema_id", "definition", "registered_at").distinct()
    return registry.register(entries, default="NONE").select("subject", "schema_id", "outcome", "assigned_version")


@query(_CANON + ", w AS (SELECT fingerprint FROM c WHERE version = 2) SELECT fingerprint, subject, arg_min(version, (version, schema_id)) AS version, arg_min(schema_id, (version, schema_id)) AS schema_id FROM c WHERE fingerprint IN (SELECT fingerprint FROM w) GROUP BY 1, 2")
def schema_resolve(spark, d):
    """Who else has a definition that some subject has as its second version."""
    entries = t(spark, d, "schema_entries")
    return registry.resolve(entries, entries.where("version = 2").select(registry.fingerprint(F.col("definition")).alias("fingerprint")))


@query("SELECT schema_id, subject, version FROM schema_entries WHERE NOT (version % 3 = 1 AND subject < 'm') OR version IS NULL OR subject IS NULL")
def schema_usable(spark, d):
    entries = t(spark, d, "schema_entries")
    return registry.usable(entries, entries.where("version % 3 = 1 AND subject < 'm'")).select("schema_id", "subject", "version")


@query(_STEPS.split("c AS (SELECT s.subject")[0].rstrip().rstrip(",") + """ SELECT n.subject, n.version, n.field, p.type AS old_type, n.type AS new_type, CASE WHEN n.type = p.type THEN n.type WHEN (p.type, n.type) IN (('int', 'long'), ('long', 'int')) THEN 'long' WHEN (p.type, n.type) IN (('int', 'float'), ('float', 'int')) THEN 'float'
  WHEN p.type IN ('int', 'long', 'float', 'double') AND n.type IN ('int', 'long', 'float', 'double') THEN 'double' END AS widened FROM s JOIN x n USING (subject, version) JOIN x p ON p.subject = s.subject AND p.version = s.previous AND p.field = n.field""")
def schema_widening(spark, d):
    """Each top-level field of a version with the type that also holds what the version before it has."""
    from ..operators import drift

    vs, _ = settle(drift.versions(t(spark, d, "schema_entries")), "versions")
    flat = vs.select("subject", "version", F.explode("fields").alias("f")).where("f.top").select("subject", "version", F.col("f.path").alias("field"), F.col("f.type").alias("type"))
    steps = drift.with_previous(vs).where("previous IS NOT NULL")
    old = flat.select("subject", F.col("version").alias("previous"), "field", F.col("type").alias("old_type"))
    j = flat.join(steps, ["subject", "version"]).join(old, ["subject", "previous", "field"])
    return j.select("subject", "version", "field", "old_type", F.col("type").alias("new_type"), registry.widened_type(F.col("old_type"), F.col("type")).alias("widened"))


# --- the overlay ---------------------------------------------------------------------------------------------------------

STATE = LOG + """, s AS (SELECT stream_id, log_offset, event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN 'EVICTED_DLQ' WHEN event_id % 13 = 0 THEN 'LEASED' ELSE 'ACKED' END AS state,
  CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN event_id % 3 + 1 ELSE 0 END AS attempts FROM log),
w AS (SELECT stream_id, coalesce(min(log_offset) FILTER (state IN ('LEASED', 'READY')), max(log_offset) + 1) AS w_base, max(log_offset) AS head FROM s GROUP BY 1)
"""


def the_journal(spark, d, rows=None):
    rows = the_log(spark, d) if rows is None else rows
    fails = F.when(F.col("event_id") % 11 == 0, 3).otherwise(F.col("event_id") % 3).cast("int")
    token = lambda k: (F.col("event_id") * 10 + k).cast("bigint")
    step = lambda op, k, i: F.struct(F.lit(op).alias("op"), token(k).alias("token"), (F.col("event_id") * 10 + i).cast("bigint").alias("seq"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k < fails, F.array(step("Acquire", k, 2 * k), step("Nack", k, 2 * k + 1))).otherwise(F.array().cast("array<struct<op:string,token:bigint,seq:bigint>>"))))
    last = F.when(F.col("event_id") % 11 != 0, F.array(step("Acquire", fails, 2 * fails))).otherwise(F.array().cast("array<struct<op:string,token:bigint,seq:bigint>>"))
    ack = F.when((F.col("event_id") % 11 != 0) & (F.col("event_id") % 13 != 0), F.array(step("Ack", fails, 2 * fails + 1))).otherwise(F.array().cast("array<struct<op:string,token:bigint,seq:bigint>>"))
    deadline = (F.unix_micros(F.col("ts").cast("timestamp")) + 30_000_000).alias("deadline_us")
    return rows.select("stream_id", "log_offset", deadline, F.explode(F.concat(pairs, last, ack)).alias("o")).select("stream_id", "log_offset", "o.seq", "o.op", "o.token", F.when(F.col("o.op") == "Acquire", F.col("deadline_us")).alias("deadline_us"))


def the_states(spark, d):
    rows = the_log(spark, d)
    return overlay.state_of_log(rows, overlay.fold_journal(the_journal(spark, d, rows), ["stream_id"]))


@query(STATE + "SELECT stream_id, log_offset, state, attempts::INT AS attempts FROM s")
def overlay_state(spark, d):
    return the_states(spark, d).select("stream_id", "log_offset", "state", "attempts")


@query(STATE + "SELECT stream_id, w_base, head FROM w")
def overlay_w_base(spark, d):
    return overlay.base_offsets(the_states(spark, d))


@query(STATE + "SELECT stream_id, log_offset, event_id FROM s WHERE state = 'EVICTED_DLQ'")
def overlay_dlq_view(spark, d):
    return overlay.dead_letters(the_log(spark, d), the_states(spark, d)).select("stream_id", "log_offset", "event_id")


@query(STATE + """, q AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY log_offset) AS rn FROM s WHERE state = 'EVICTED_DLQ')
SELECT s.stream_id, any_value(w_base) AS w_base, count(*) FILTER (state = 'READY') AS n_ready, count(*) FILTER (state = 'LEASED') AS n_leased, count(*) FILTER (state = 'ACKED' AND log_offset > w_base) AS n_acked_above,
 count(*) FILTER (state = 'EVICTED_DLQ') AS n_dlq, any_value((SELECT sum(log_offset)::BIGINT FROM q WHERE q.stream_id = s.stream_id AND rn <= 100)) AS sample_sum FROM s JOIN w ON w.stream_id = s.stream_id GROUP BY 1""")
def overlay_inspection(spark, d):
    return overlay.inspect(the_states(spark, d)).withColumn("sample_sum", F.aggregate("dlq_samples", F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("dlq_samples")


@query(STATE + """SELECT stream_id, log_offset, 'open_below_base' AS breach FROM s JOIN w USING (stream_id) WHERE log_offset < w_base + 7 AND state NOT IN ('ACKED', 'EVICTED_DLQ')
UNION ALL SELECT stream_id, log_offset, 'two_states' FROM s WHERE event_id % 50 = 0 AND state <> 'READY'
UNION ALL SELECT stream_id, log_offset, 'open_below_base' FROM s JOIN w USING (stream_id) WHERE event_id % 50 = 0 AND log_offset < w_base + 7""")
def overlay_invariants(spark, d):
    """A state that was tampered with: some offsets are READY besides what they are, and bases ran ahead."""
    states = the_states(spark, d).select("stream_id", "log_offset", "state", "event_id")
    both = states.unionByName(states.where("event_id % 50 = 0").withColumn("state", F.lit("READY"))).drop("event_id")
    bases = overlay.base_offsets(states).withColumn("w_base", F.col("w_base") + 7)
    return overlay.invariant_breaches(both, bases=bases)


@query(STATE + "SELECT stream_id, count(*) AS produced, count(*) FILTER (state = 'ACKED') AS acked, count(*) FILTER (state = 'EVICTED_DLQ') AS dead, count(*) FILTER (state = 'LEASED') AS leased FROM s GROUP BY 1")
def conservation_check(spark, d):
    n = lambda s: F.count_if(F.col("state") == s)
    return the_states(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("produced"), n("ACKED").alias("acked"), n("EVICTED_DLQ").alias("dead"), n("LEASED").alias("leased"))


@query(STATE + "SELECT stream_id, log_offset, CASE WHEN event_id % 3 = 2 THEN 'EVICTED_DLQ' ELSE 'READY' END AS next_state FROM s WHERE state = 'LEASED' AND ts <= TIMESTAMP '2024-01-20' - INTERVAL 30 SECONDS")
def lease_expiry(spark, d):
    return overlay.expired_leases(the_states(spark, d), 1_705_708_800_000_000).select("stream_id", "log_offset", "next_state")


@query(LOG + " SELECT log_offset FROM log WHERE stream_id = 'click' AND event_id % 5 <> 0 ORDER BY log_offset LIMIT 25")
def lease_candidates(spark, d):
    rows = the_log(spark, d).withColumn("state", F.when(F.col("event_id") % 5 == 0, "LEASED").otherwise("READY")).withColumn("attempts", F.lit(0))
    return overlay.lease_candidates(rows, "click", 25).select("log_offset")


@query(LOG + " SELECT log_offset, (event_id % 3)::INT AS attempts FROM log WHERE stream_id = 'click' AND event_id % 5 <> 0 ORDER BY event_id % 3 DESC, log_offset LIMIT 25")
def retry_first_candidates(spark, d):
    rows = the_log(spark, d).withColumn("state", F.when(F.col("event_id") % 5 == 0, "LEASED").otherwise("READY")).withColumn("attempts", (F.col("event_id") % 3).cast("int"))
    return overlay.lease_candidates(rows, "click", 25, retry_first=True).select("log_offset", "attempts")


@query(STATE + "SELECT stream_id, log_offset, CASE state WHEN 'EVICTED_DLQ' THEN 'READY' ELSE state END AS state FROM s WHERE event_id % 11 = 0")
def dlq_redrive(spark, d):
    rows = the_log(spark, d)
    journal = the_journal(spark, d, rows)
    dead = overlay.fold_journal(journal, ["stream_id"]).where("state = 'EVICTED_DLQ'")
    again = dead.select("stream_id", "log_offset", F.lit(2**62).cast("bigint").alias("seq"), F.lit("Redrive").alias("op"), F.lit(None).cast("bigint").alias("token"), F.lit(None).cast("bigint").alias("deadline_us"))
    folded = overlay.fold_journal(journal.unionByName(again), ["stream_id"])
    return folded.join(rows.where("event_id % 11 = 0").select("stream_id", "log_offset"), ["stream_id", "log_offset"]).select("stream_id", "log_offset", "state")


@query(STATE + "SELECT s.stream_id, count(*) FILTER (state = 'READY') AS ready, count(*) FILTER (state = 'LEASED') AS in_flight, any_value(head + 1 - w_base) AS lag FROM s JOIN w ON w.stream_id = s.stream_id GROUP BY 1")
def queue_depth(spark, d):
    return overlay.depth(the_states(spark, d))


@query(LOG + """, a AS (SELECT stream_id, log_offset, event_id, unnest(range(CASE WHEN event_id % 11 = 0 THEN 3 ELSE event_id % 3 + 1 END)) AS k FROM log)
SELECT stream_id, log_offset, event_id * 10 + k AS token, k + 1 AS attempt FROM a""")
def attempt_numbers(spark, d):
    return overlay.attempts(the_journal(spark, d), ["stream_id"]).select("stream_id", "log_offset", "token", "attempt")


_FOLD = """WITH j AS (SELECT DISTINCT tenant_id, stream_id, group_id, log_offset, seq, op, token, deadline_us FROM lease_deltas WHERE log_offset IS NOT NULL AND seq IS NOT NULL),
l AS (SELECT tenant_id, stream_id, group_id, log_offset, list_prepend({'seq': -1::BIGINT, 'op': '', 'token': NULL::BIGINT, 'deadline': NULL::BIGINT, 'state': 'READY', 'held': NULL::BIGINT, 'until': NULL::BIGINT, 'attempts': 0, 'granted': 0, 'rejected': 0, 'outs': []::VARCHAR[]},
  list({'seq': seq, 'op': op, 'token': token, 'deadline': deadline_us, 'state': '', 'held': NULL::BIGINT, 'until': NULL::BIGINT, 'attempts': 0, 'granted': 0, 'rejected': 0, 'outs': []::VARCHAR[]} ORDER BY seq)) AS ops, list(op ORDER BY seq) AS names, list(seq ORDER BY seq) AS seqs FROM j GROUP BY 1, 2, 3, 4),
f AS (SELECT *, list_reduce(ops, lambda a, e: {'seq': e.seq, 'op': e.op, 'token': e.token, 'deadline': e.deadline,
  'state': CASE WHEN e.op = 'Acquire' AND a.state = 'READY' THEN 'LEASED' WHEN e.op = 'Ack' AND a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token THEN 'ACKED' WHEN e.op = 'Nack' AND a.state = 'LEASED' THEN CASE WHEN a.attempts >= 3 THEN 'EVICTED_DLQ' ELSE 'READY' END WHEN e.op = 'EvictDlq' AND a.state <> 'ACKED' THEN 'EVICTED_DLQ' ELSE a.state END,
  'held': CASE WHEN e.op = 'Acquire' AND a.state = 'READY' THEN e.token WHEN (e.op = 'Ack' AND a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token) OR (e.op = 'Nack' AND a.state = 'LEASED') OR (e.op = 'EvictDlq' AND a.state <> 'ACKED') THEN NULL ELSE a.held END,
  'until': CASE WHEN e.op = 'Acquire' AND a.state = 'READY' THEN e.deadline WHEN (e.op = 'Ack' AND a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token) OR (e.op = 'Nack' AND a.state = 'LEASED') OR (e.op = 'EvictDlq' AND a.state <> 'ACKED') THEN NULL ELSE a.until END,
  'attempts': CASE WHEN e.op = 'Acquire' AND a.state = 'READY' THEN a.attempts + 1 WHEN (e.op = 'Ack' AND a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token) OR (e.op = 'Nack' AND a.state = 'LEASED' AND a.attempts >= 3) OR (e.op = 'EvictDlq' AND a.state <> 'ACKED') THEN 0 ELSE a.attempts END,
  'granted': a.granted + (e.op = 'Acquire' AND a.state = 'READY')::INT, 'rejected': a.rejected + ((e.op = 'Acquire' AND a.state <> 'READY') OR (e.op = 'Ack' AND a.state <> 'ACKED' AND NOT (a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token)))::INT,
  'outs': list_append(a.outs, CASE WHEN e.op = 'Acquire' THEN CASE WHEN a.state = 'READY' THEN 'granted' ELSE 'refused' END WHEN e.op = 'Ack' THEN CASE WHEN a.state = 'ACKED' OR (a.state = 'LEASED' AND a.held IS NOT DISTINCT FROM e.token) THEN 'accepted' WHEN a.state = 'LEASED' THEN 'conflict:stale_token' ELSE 'conflict:not_leased' END
    WHEN e.op = 'Nack' AND a.state = 'LEASED' THEN CASE WHEN a.attempts >= 3 THEN 'dead_lettered' ELSE 'returned' END WHEN e.op = 'EvictDlq' AND a.state <> 'ACKED' THEN 'dead_lettered' ELSE 'ignored' END)}) AS s FROM l)
"""


@query(_FOLD + "SELECT tenant_id, stream_id, group_id, log_offset, s.state AS state, s.held AS token, s.until AS deadline_us, s.attempts AS attempts, s.granted AS granted, s.rejected AS rejected FROM f")
def overlay_fold(spark, d):
    """The journal as it is: repeated rows, rows out of order, outdated tokens."""
    return overlay.fold_journal(t(spark, d, "lease_deltas"), ["tenant_id", "stream_id", "group_id"])


@query(_FOLD + "SELECT tenant_id, stream_id, group_id, log_offset, unnest(seqs) AS seq, unnest(names) AS op, unnest(s.outs) AS outcome FROM f")
def overlay_outcomes(spark, d):
    """What each operation of the journal came to."""
    return overlay.journal_outcomes(t(spark, d, "lease_deltas"), ["tenant_id", "stream_id", "group_id"])


@query(_FOLD + """, g AS (SELECT tenant_id, stream_id, group_id, max(log_offset) AS head FROM f GROUP BY 1, 2, 3),
n AS (SELECT tenant_id, stream_id, group_id, log_offset, row_number() OVER (PARTITION BY tenant_id, stream_id, group_id ORDER BY log_offset) - 1 AS i FROM f WHERE s.state IN ('ACKED', 'EVICTED_DLQ'))
SELECT tenant_id, stream_id, group_id, any_value(head) AS head, count(*) FILTER (log_offset = i) AS w_base FROM g LEFT JOIN n USING (tenant_id, stream_id, group_id) GROUP BY 1, 2, 3""")
def overlay_fold_base(spark, d):
    key = ["tenant_id", "stream_id", "group_id"]
    return overlay.base_of_sparse(overlay.fold_journal(t(spark, d, "lease_deltas"), key), key)


@query(_FOLD + """, o AS (SELECT tenant_id, stream_id, group_id, unnest(seqs) AS seq, unnest(s.outs) AS outcome FROM f),
a AS (SELECT tenant_id, stream_id, group_id, count(*) AS n_ops, min(seq) FILTER (outcome = 'refused' OR outcome LIKE 'conflict:%') AS aborted_at FROM o GROUP BY 1, 2, 3)
SELECT tenant_id, stream_id, group_id, any_value(n_ops) AS n_ops, any_value(aborted_at) AS aborted_at, count(*) FILTER (aborted_at IS NULL OR seq < aborted_at) AS n_replayed FROM o JOIN a USING (tenant_id, stream_id, group_id) GROUP BY 1, 2, 3""")
def overlay_replay(spark, d):
    return overlay.replay_breaks(t(spark, d, "lease_deltas"), ["tenant_id", "stream_id", "group_id"])


# --- producers, epochs, transactions -------------------------------------------------------------------------------------


def _batches(spark, d):
    o = t(spark, d, "orders").select((F.col("o_custkey")).alias("producer_id"), "o_orderkey", (F.col("o_orderkey") % 4 + 1).cast("int").alias("n_records"))
    from pyspark.sql import Window

    w = Window.partitionBy("producer_id").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    first = o.withColumn("base_sequence", F.coalesce(F.sum("n_records").over(w), F.lit(0)).cast("bigint")).withColumn("arrival", F.col("o_orderkey") * 2)
    again = first.where("o_orderkey % 5 = 0").withColumn("arrival", F.col("o_orderkey") * 2 + 1)
    return first.unionByName(again)


_PROD = """WITH o AS (SELECT o_custkey AS producer_id, o_orderkey, (o_orderkey % 4 + 1)::INT AS n FROM orders),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY producer_id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_sequence FROM o)
SELECT producer_id, o_orderkey * 2 AS arrival, base_sequence, 'accepted' AS outcome FROM b UNION ALL SELECT producer_id, o_orderkey * 2 + 1, base_sequence, 'duplicate' FROM b WHERE o_orderkey % 5 = 0"""


@query(_PROD)
def producer_dedup(spark, d):
    return producer.check_sequences(_batches(spark, d), ["producer_id"], "arrival", block=F.floor(F.col("arrival") / 20_000)).select("producer_id", "arrival", "base_sequence", "outcome")


def _produced(spark, d):
    """Producers that start anew in a higher epoch every five batches, lose the fourth, send the second twice and the third once more in their old epoch; some aren't checked."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", i.alias("i")).where("i % 5 <> 3")
    who = F.when(F.col("o_custkey") % 10 == 0, -1).otherwise(F.col("o_custkey")).cast("bigint").alias("producer_id")
    send = lambda rows, late, epoch: rows.select(who, (F.col("o_orderkey") * 4 + late).alias("arrival"), epoch.cast("bigint").alias("producer_epoch"), (F.col("i") % 5 * 10).cast("bigint").alias("base_sequence"), F.lit(10).cast("bigint").alias("n_records"), F.col("o_orderkey").alias("next_offset"), (F.col("o_custkey") % 4).alias("topic"))
    epoch = F.floor(F.col("i") / 5)
    all_ = send(o, 0, epoch).unionByName(send(o.where("i % 5 = 1"), 1, epoch)).unionByName(send(o.where("i % 5 = 2 AND i >= 5"), 2, epoch - 1))
    return producer.fold_producers(all_, ["producer_id"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
p AS (SELECT *, CASE WHEN o_custkey % 10 = 0 THEN -1 ELSE o_custkey END AS producer_id, 10 * (i % 5) AS base_sequence, i // 5 AS epoch FROM o WHERE i % 5 <> 3)
SELECT producer_id, o_orderkey * 4 AS arrival, base_sequence, CASE WHEN producer_id = -1 OR i % 5 < 3 THEN 'accepted' ELSE 'out_of_order' END AS outcome FROM p
UNION ALL SELECT producer_id, o_orderkey * 4 + 1, base_sequence, CASE WHEN producer_id = -1 THEN 'accepted' ELSE 'duplicate' END FROM p WHERE i % 5 = 1
UNION ALL SELECT producer_id, o_orderkey * 4 + 2, base_sequence, CASE WHEN producer_id = -1 THEN 'accepted' ELSE 'fenced' END FROM p WHERE i % 5 = 2 AND epoch > 0""")
def producer_fold(spark, d):
    return _produced(spark, d).select("producer_id", "arrival", "base_sequence", "outcome")


@query("""WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) AS gap FROM events)
SELECT event_id, coalesce(gap <= 600000000, false) AS duplicate FROM g""")
def dedup_within_window(spark, d):
    return producer.window_duplicates(t(spark, d, "events"), ["user_id", "event_type"], "ts", 600, block=F.to_date("ts")).select("event_id", "duplicate")


@query("""WITH g AS (SELECT delivery_id, epoch_us(received_at) - epoch_us(lag(received_at) OVER w) AS gap, sequence_number - lag(sequence_number) OVER w AS seqs
  FROM sqs_messages WINDOW w AS (PARTITION BY queue_url, message_body ORDER BY received_at, delivery_id)) SELECT delivery_id, coalesce(gap <= 600000000, false) AND coalesce(seqs <= 50, true) AS duplicate FROM g""")
def dedup_bounded(spark, d):
    """A window that ends after ten minutes or fifty sequence numbers, whichever is first."""
    m = t(spark, d, "sqs_messages").select("delivery_id", "queue_url", "message_body", "received_at", "sequence_number")
    return producer.window_duplicates(m, ["queue_url", "message_body"], "received_at", 600, ["delivery_id"], "sequence_number", 50).select("delivery_id", "duplicate")


@query("""WITH RECURSIVE h AS (SELECT DISTINCT batch_id, hlc_node_id, timestamp_us // 1000 AS own, physical_ms AS ms, hlc_logical::BIGINT AS c FROM batch_headers),
o AS (SELECT *, row_number() OVER (PARTITION BY hlc_node_id ORDER BY batch_id) AS i FROM h),
z(hlc_node_id, i, batch_id, ms, c) AS (SELECT hlc_node_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT hlc_node_id FROM h)
  UNION ALL SELECT o.hlc_node_id, o.i, o.batch_id, greatest(z.ms, o.ms, o.own), CASE WHEN z.ms = o.ms AND z.ms >= o.own THEN greatest(z.c, o.c) + 1 WHEN z.ms >= o.own AND z.ms > o.ms THEN z.c + 1 WHEN o.ms >= o.own AND o.ms > z.ms THEN o.c + 1 ELSE 0 END
  FROM z JOIN o ON o.hlc_node_id = z.hlc_node_id AND o.i = z.i + 1)
SELECT hlc_node_id, batch_id, ms AS hlc_ms, c AS hlc_count FROM z WHERE i > 0""")
def hlc_updates(spark, d):
    """A receiver per node that takes in its batches' clocks."""
    h = t(spark, d, "batch_headers").select("batch_id", "hlc_node_id", F.floor(F.col("timestamp_us") / 1000).alias("own"), "physical_ms", F.col("hlc_logical").cast("bigint").alias("logical")).distinct()
    return producer.hlc_receive(h, ["hlc_node_id"], ["batch_id"], "own", "physical_ms", "logical").select("hlc_node_id", "batch_id", "hlc_ms", "hlc_count")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
a AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN -1 ELSE o_custkey END AS producer_id, o_orderkey, o_custkey % 4 AS topic FROM o WHERE i % 5 < 3 OR (i % 5 = 4 AND o_custkey % 10 = 0)
  UNION ALL SELECT -1, o_orderkey, o_custkey % 4 FROM o WHERE o_custkey % 10 = 0 AND (i % 5 = 1 OR (i % 5 = 2 AND i >= 5)))
SELECT topic, count(*) AS n_batches, 10 * count(*) AS head_offset, count(DISTINCT o_orderkey) AS n_orders FROM a GROUP BY 1""")
def produce_append(spark, d):
    """Producer batches checked, and those accepted appended to their topic: duplicates, gaps and fenced ones add nothing."""
    checked = _produced(spark, d).where("outcome = 'accepted'").withColumn("stream_id", F.col("topic").cast("string"))
    records = checked.select("stream_id", "topic", "next_offset", "arrival", F.explode(F.sequence(F.lit(0), F.col("n_records") - 1)).alias("i"))
    stored = log.dense_offsets(records, "stream_id", ["arrival", "i"], F.floor(F.col("arrival") / 100_000))
    return stored.groupBy("topic").agg(F.floor(F.count(F.lit(1)) / 10).alias("n_batches"), (F.max("log_offset") + 1).alias("head_offset"), F.count_distinct("next_offset").alias("n_orders"))


@query("WITH e AS (SELECT event_id, user_id, ts, (event_id * 7 % 20)::INT AS epoch FROM events), m AS (SELECT *, max(epoch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS max_epoch FROM e) SELECT event_id, epoch, max_epoch, epoch < max_epoch AS fenced FROM m")
def epoch_fence(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_id") * 7 % 20).cast("int").alias("epoch"))
    return producer.fence_epochs(e, ["user_id"], "at", block=F.to_date(F.col("at.ts"))).select("event_id", "epoch", "max_epoch", "fenced")


@query("""WITH h AS (SELECT batch_id, hlc_node_id, max(physical_ms) OVER (PARTITION BY hlc_node_id ORDER BY batch_id) AS hlc_ms FROM (SELECT DISTINCT batch_id, hlc_node_id, physical_ms FROM batch_headers))
SELECT batch_id, hlc_node_id, hlc_ms, row_number() OVER (PARTITION BY hlc_node_id, hlc_ms ORDER BY batch_id) - 1 AS hlc_count FROM h""")
def hlc_plateaus(spark, d):
    h = t(spark, d, "batch_headers").select("batch_id", "hlc_node_id", "physical_ms").distinct()
    return producer.hlc_now(h, ["hlc_node_id"], "batch_id", block=F.floor(F.col("batch_id") / 256)).select("batch_id", "hlc_node_id", "hlc_ms", "hlc_count")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events")
def entity_order(spark, d):
    return log.dense_offsets(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.to_date("ts"), "nth").select("user_id", "event_id", (F.col("nth") + 1).alias("nth"))


_TXN = LOG + """, r AS (SELECT stream_id, log_offset, event_id, (event_id // 20) % 50 AS txn_id FROM log WHERE event_id % 20 <> 19), m AS (SELECT stream_id, log_offset, (event_id // 20) % 50 AS txn_id, CASE WHEN event_id % 3 = 0 THEN 'abort' ELSE 'commit' END AS kind FROM log WHERE event_id % 20 = 19),
f AS (SELECT stream_id, txn_id, min(log_offset) AS at, arg_min(kind, log_offset) AS kind FROM m WHERE txn_id <> 0 GROUP BY 1, 2),
v AS (SELECT r.*, CASE WHEN r.txn_id = 0 THEN 'none' WHEN f.at IS NULL OR r.log_offset >= f.at THEN 'open' WHEN f.kind = 'commit' THEN 'committed' ELSE 'aborted' END AS txn_state FROM r LEFT JOIN f ON f.stream_id = r.stream_id AND f.txn_id = r.txn_id)
"""


def _txn(spark, d):
    """The log as records and markers: every twentieth event ends the transaction its number names, commits or aborts it."""
    rows = the_log(spark, d).withColumn("txn_id", F.floor(F.col("event_id") / 20) % 50)
    markers = rows.where("event_id % 20 = 19").select("stream_id", "log_offset", "txn_id", F.when(F.col("event_id") % 3 == 0, "abort").otherwise("commit").alias("kind"))
    return rows.where("event_id % 20 <> 19").select("stream_id", "log_offset", "event_id", "txn_id"), markers


@query(_TXN + "SELECT stream_id, log_offset, event_id, txn_id, txn_state FROM v WHERE txn_state IN ('none', 'committed')")
def txn_read_committed(spark, d):
    return transactions.read_log(*_txn(spark, d))


@query(_TXN + "SELECT stream_id, log_offset, event_id, txn_id, txn_state FROM v")
def txn_read_uncommitted(spark, d):
    return transactions.read_log(*_txn(spark, d), committed=False)


@query(_TXN + "SELECT stream_id, coalesce(min(log_offset) FILTER (txn_state = 'open'), max(log_offset) + 1) AS last_stable_offset FROM v GROUP BY 1")
def txn_last_stable(spark, d):
    return transactions.last_stable(*_txn(spark, d))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'click'")
def compacted_log(spark, d):
    """The latest value of each key; a click deletes it."""
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "click").alias("gone"))
    return transactions.latest_values(e, "user_id", ["ts", "event_id"], "gone").select("user_id", "event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS pos, (event_id % 5 + 1)::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b(user_id, i, event_id, pos, tokens, admitted) AS (SELECT user_id, i, event_id, pos, CASE WHEN 6 >= cost THEN 6 - cost ELSE 6 END, 6 >= cost FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.pos, CASE WHEN least(6, b.tokens + 0.00002 * (e.pos - b.pos) / 1000000) >= e.cost THEN least(6, b.tokens + 0.00002 * (e.pos - b.pos) / 1000000) - e.cost ELSE least(6, b.tokens + 0.00002 * (e.pos - b.pos) / 1000000) END,
    least(6, b.tokens + 0.00002 * (e.pos - b.pos) / 1000000) >= e.cost FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT user_id, event_id, admitted, round(tokens, 4) AS tokens FROM b""")
def quota_admission(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 5 + 1).alias("cost"))
    return quota.token_bucket(e, ["user_id"], "at", "cost", 6.0, 0.00002, ["event_id"]).select("user_id", "event_id", "admitted", F.round("tokens", 4).alias("tokens"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'logout'")
def latest_per_key(spark, d):
    last = t(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"))
    return last.where("l.event_type <> 'logout'").select("user_id", "l.event_id")


# --- gateway -------------------------------------------------------------------------------------------------------------


@query("""SELECT delivery_id, 'sqs-group-' || split_part(queue_url, '/', -1) AS group_id, printf('msg-%016x-', coalesce(sequence_number, 0)) || left(md5(message_body), 8) AS made_id, md5(message_body) = md5_of_body AS body_ok FROM sqs_messages""")
def queue_ids(spark, d):
    m = t(spark, d, "sqs_messages")
    return m.select("delivery_id", ids.queue_group(F.col("queue_url")).alias("group_id"), ids.message_id(F.coalesce("sequence_number", F.lit(0)), F.col("message_body")).alias("made_id"), (F.md5("message_body") == F.col("md5_of_body")).alias("body_ok"))


@query("""WITH o AS (SELECT delivery_id, queue_url, message_body, row_number() OVER (PARTITION BY queue_url ORDER BY received_at, delivery_id) - 1 AS off FROM sqs_messages)
SELECT delivery_id, off AS log_offset, printf('msg-%016x-', off) || left(md5(message_body), 8) AS made_id, md5(message_body) AS md5_of_body FROM o""")
def queue_send(spark, d):
    """Messages appended to their queue's stream, with the identifiers the sender gets."""
    m = t(spark, d, "sqs_messages").select("delivery_id", F.col("queue_url").alias("stream_id"), "message_body", "received_at")
    stored = log.dense_offsets(m, "stream_id", ["received_at", "delivery_id"], F.to_date("received_at"))
    return stored.select("delivery_id", "log_offset", ids.message_id(F.col("log_offset"), F.col("message_body")).alias("made_id"), F.md5("message_body").alias("md5_of_body"))


@query("""WITH h AS (SELECT delivery_id, string_split(receipt_handle, '-') AS p FROM sqs_messages WHERE regexp_full_match(receipt_handle, 'RH-[0-9a-f]{8}-[0-9a-f]{16}-[0-9a-f]{16}-[0-9a-f]{8}'))
SELECT delivery_id, ('0x' || p[2])::BIGINT AS shard, ('0x' || p[3])::BIGINT AS epoch, ('0x' || p[4])::BIGINT AS log_offset, ('0x' || p[5])::BIGINT AS nonce FROM h""")
def receipt_handles(spark, d):
    m = t(spark, d, "sqs_messages").select("delivery_id", ids.parse_handle(F.col("receipt_handle")).alias("h")).where("h IS NOT NULL")
    return m.select("delivery_id", "h.*")


@query("""WITH e AS (SELECT event_id, (user_id * 37) & 65535 AS shard, event_id & 65535 AS epoch, (event_id * 31) & 4294967295 AS nonce FROM events)
SELECT event_id, (CASE WHEN shard >= 32768 THEN shard - 65536 ELSE shard END) * 281474976710656 + epoch * 4294967296 + nonce AS token, shard, epoch, nonce FROM e""")
def token_pack(spark, d):
    e = t(spark, d, "events").select("event_id", ids.pack_token(F.col("user_id") * 37, F.col("event_id"), F.col("event_id") * 31).alias("token"))
    return e.select("event_id", "token", ids.unpack_token(F.col("token")).alias("u")).select("event_id", "token", "u.*")


@query("""WITH e AS (SELECT event_id, printf('%08x', user_id) AS a, printf('%016x', event_id) AS b, printf('%016x', event_id * 1000003) AS c, printf('%08x', (event_id * 31) & 4294967295) AS d FROM events),
le AS (SELECT event_id, """ + " || ".join(f"substr({c}, {i}, 2)" for c, n in (("a", 8), ("b", 16), ("c", 16), ("d", 8)) for i in range(n - 1, 0, -2)) + """ AS token FROM e)
SELECT e.event_id, token, e.event_id * 1000003 AS log_offset, (e.event_id * 31) & 4294967295 AS nonce FROM e JOIN le USING (event_id)""")
def token_bytes(spark, d):
    e = t(spark, d, "events")
    raw = e.select("event_id", ids.token_bytes(F.col("user_id"), F.col("event_id"), F.col("event_id") * 1000003, F.col("event_id") * 31).alias("raw"))
    return raw.select("event_id", ids.hex_id(F.col("raw")).alias("token"), ids.parse_token_bytes(F.col("raw")).alias("t")).select("event_id", "token", "t.log_offset", "t.nonce")


@query("SELECT event_id, ((event_id * 2654435761) >> 32) % 1024 AS shard, printf('%04x', (event_id * 2654435761) >> 48) AS prefix FROM events")
def hash_shards(spark, d):
    """Shard and object prefix of given 64-bit hashes."""
    h = F.col("event_id") * 2654435761
    return t(spark, d, "events").select("event_id", ids.shard_of(h).alias("shard"), ids.uri_prefix(h).alias("prefix"))


@query()
def stream_ids(spark, d):
    """Stream ids, shards and chunk addresses of every stream by its name; tested against the published hash function."""
    s = t(spark, d, "streams").select("stream_id", F.coalesce("stream_name", F.lit("")).alias("name"), "tenant_id", F.col("active_segment_id").alias("segment"))
    tenant = F.concat(ids.little_endian(F.col("tenant_id"), 8), ids.little_endian(F.lit(0), 8))
    return s.select(
        "stream_id", ids.hex_id(ids.topic_stream(F.col("name"), F.lit(3))).alias("topic_stream"), ids.hex_id(ids.tenant_stream(tenant, F.col("name"))).alias("queue_stream"),
        ids.hex_id(ids.tenant_stream(tenant, F.col("name"), F.lit(3))).alias("bridged_stream"), ids.shard_of(ids.xxh64(F.col("name"))).alias("shard"),
        ids.chunk_uri("lake", tenant, F.unhex("stream_id"), F.col("segment"), F.col("segment") + 99).alias("uri"),
    )


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END AS body FROM events")
def strict_utf8(spark, d):
    """Bodies, a third of which end in a byte that is no UTF-8."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_type").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("event_type").cast("binary"))
    return t(spark, d, "events").select("event_id", ids.strict_text(raw).alias("body"))


@query("""SELECT event_id, CASE WHEN user_id % 7 <> 3 THEN 'wrong_shard' WHEN event_id % 5 < 2 THEN 'fenced' WHEN event_id % 5 > 2 THEN 'from_the_future' WHEN event_id > 5000 THEN 'beyond_head' ELSE 'valid' END AS outcome FROM events""")
def ack_outcomes(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", ids.token_outcome(F.col("user_id") % 7, F.col("event_id") % 5, F.lit(3), F.lit(2), F.col("event_id"), F.lit(5000)).alias("outcome"))


_EXCHANGES = ["amq.topic", "amq.headers", "a.topic.b", "amq.direct", "amq.headers.x", "amq.topics", "amq.topic.x"]


@query("SELECT delivery_id, CASE WHEN x = 'amq.topic' OR contains(x, '.topic.') THEN 'rejected:topic' WHEN x = 'amq.headers' THEN 'rejected:headers' ELSE 'routed' END AS outcome FROM (SELECT delivery_id, [" + ", ".join(f"'{x}'" for x in _EXCHANGES) + "][delivery_id % 7 + 1] AS x FROM sqs_messages)")
def exchange_routing(spark, d):
    x = F.element_at(F.array(*[F.lit(x) for x in _EXCHANGES]), (F.col("delivery_id") % 7 + 1).cast("int"))
    return t(spark, d, "sqs_messages").select("delivery_id", ids.exchange_outcome(x).alias("outcome"))


@query("SELECT record_id, (ceil(payload_len / 4096.0) * 4096)::BIGINT AS padded FROM record_entries")
def page_padding(spark, d):
    return t(spark, d, "record_entries").select("record_id", ids.page_padded(F.col("payload_len")).alias("padded"))


# --- governance ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND user_id % 10 <> 0")
def pitr_restore(spark, d):
    e = t(spark, d, "events")
    gone = e.where("user_id % 10 = 0").select("user_id")
    return govern.restore(e, gone, "ts", F.lit("2024-01-20").cast(NTZ), "user_id").select("event_id", "user_id", "value")


@query("SELECT count(*) FILTER (user_id % 10 <> 0) AS recovered, count(*) FILTER (user_id % 10 = 0) AS blocked FROM events WHERE ts <= TIMESTAMP '2024-01-20'")
def pitr_report(spark, d):
    e = t(spark, d, "events")
    return govern.restore_report(e, e.where("user_id % 10 = 0").select("user_id"), "ts", F.lit("2024-01-20").cast(NTZ), "user_id")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR user_id % 25 = 0")
def retention_visible(spark, d):
    e = t(spark, d, "events")
    return govern.visible(e, e.where("user_id % 25 = 0").select("user_id"), "ts", F.lit("2024-01-20").cast(NTZ), "user_id").select("event_id", "user_id")


@query("WITH h AS (SELECT user_id FROM events WHERE user_id % 5 = 0 GROUP BY 1 HAVING arg_max(event_id % 3, (ts, event_id)) <> 0) SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM h)")
def legal_hold_filter(spark, d):
    """Holds that are applied and released again by the events of some users: those whose last one applied it."""
    e = t(spark, d, "events")
    log_ = e.where("user_id % 5 = 0").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, "release").otherwise("apply").alias("kind"))
    return govern.held_records(e, govern.active_holds(log_, ["user_id"], ["ts", "event_id"]), ["user_id"]).select("event_id")


@query("SELECT tenant_id, stream_id, 'PROOF-SHRED-' || (tenant_id % 256) || '-' || (tenant_id * 7) || '-' || (1700000000000000000 + tenant_id) AS proof_id, stream_name IS NULL OR stream_name < 'n' AS valid FROM streams")
def erasure_proofs(spark, d):
    """Proofs of erasure of one key a stream, some of them forged afterwards."""
    s = t(spark, d, "streams")
    tenant = F.concat(ids.little_endian(F.col("tenant_id"), 8), ids.little_endian(F.lit(0), 8))
    targets = s.select(tenant.alias("tenant_id"), (F.col("tenant_id") * 7).alias("dek_id"), "stream_id", (F.col("tenant_id") + 1_700_000_000_000_000_000).alias("destroyed_at_ns"), F.lit("op").alias("operator_id"), F.lit("request").alias("reason"))
    proofs = govern.erasure_proofs(targets).join(s.select("stream_id", F.col("tenant_id").alias("t_"), "stream_name"), "stream_id")
    forged = proofs.withColumn("reason", F.when(F.col("stream_name") >= "n", "other").otherwise(F.col("reason")))
    return govern.valid_proofs(forged).select(F.col("t_").alias("tenant_id"), "stream_id", "proof_id", "valid")


@query("SELECT stream_id, tenant_id % 10 <> 0 AS active FROM streams")
def key_registry(spark, d):
    """Whether each stream's key is active after those of some tenants were destroyed; a key that is gone from the table is in the registry."""
    s = t(spark, d, "streams").select("stream_id", "tenant_id", F.col("tenant_id").alias("dek_id"))
    keys, _ = settle(govern.new_keys(s.select("tenant_id", "dek_id").distinct()), "keys")
    destroyed = s.where("tenant_id % 10 = 0").select("tenant_id", "dek_id").distinct()
    left = govern.erase_keys(keys, destroyed)
    return govern.active_keys(s, destroyed).join(left.select("tenant_id", "dek_id", (F.octet_length("dek") == 32).alias("has_")), ["tenant_id", "dek_id"], "left").select("stream_id", (F.col("active") & F.coalesce("has_", F.lit(False))).alias("active"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey <> c_custkey % 25 AND c_mktsegment <> 'BUILDING' THEN 'deny:tenant' WHEN c_nationkey = 3 THEN 'deny:rule'
  WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_custkey % 2 = 0 THEN 'allow' ELSE 'deny:default' END AS decision FROM customer""")
def abac_decisions(spark, d):
    role = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("super-admin"), F.lit("producer"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("producer"))).otherwise(F.array(F.lit("guest")))
    req = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("tenant_id"), role.alias("roles"), F.when(F.col("c_custkey") % 2 == 0, "produce").otherwise("consume").alias("action"), (F.col("c_custkey") % 25).alias("resource_tenant"))
    rules = spark.createDataFrame([("allow", None, ["producer"], ["produce"]), ("deny", 3, [], ["produce", "consume"])], "effect string, tenant_scope bigint, required_roles array<string>, actions array<string>")
    return govern.authorize(req, rules, "c_custkey").select("c_custkey", "decision")


@query("SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN props END AS payload FROM events")
def crypto_shred_visible(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 50).cast("int").alias("dek_id"), "props")
    dek = spark.range(50).select(F.col("id").cast("int").alias("dek_id"), F.unhex(F.substring(F.sha2(F.concat(F.lit("test key "), F.col("id").cast("string")), 256), 1, 32)).alias("dek"))
    sealed = govern.encrypt(e, "props", dek, "dek_id", F.col("event_type"))
    return govern.decrypt(sealed, dek.where("dek_id % 10 <> 0"), "dek_id", F.col("event_type")).select("event_id", "payload")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 97 <> 0) AS n_intact FROM events GROUP BY 1")
def audit_chain_verify(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("tenant_id"), F.col("event_id").alias("seq"), "event_type", "value")
    chain = govern.build_chain(e, ["seq", "event_type", "value"])
    tampered = chain.withColumn("value", F.when(F.col("seq") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return govern.verify_chain(tampered, ["seq", "event_type", "value"]).groupBy(F.col("tenant_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("intact").alias("n_intact"))


# --- telemetry -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total, max(user_id) AS most, floor(sum(user_id) / count(user_id))::BIGINT AS mean_floor FROM events GROUP BY 1")
def metrics_rollup(spark, d):
    return metrics.rollup(t(spark, d, "events"), ["event_type"], "user_id")


@query("SELECT event_type, count(*) AS n, round(coalesce(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 0), 0), 9) AS per_second FROM events GROUP BY 1")
def throughput(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    g = t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), ((us(F.max("ts")) - us(F.min("ts"))) / 1_000_000).alias("s"))
    return g.select("event_type", "n", F.round(metrics.rate(F.col("n"), F.col("s")), 9).alias("per_second"))


@query(STATE + "SELECT stream_id, floor(greatest(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts), 0) / 86400000000)::BIGINT AS bucket, count(*) AS n FROM s WHERE state = 'LEASED' GROUP BY 1, 2")
def lease_age_histogram(spark, d):
    """Leases by the days since they were given, as of a time."""
    leased = the_states(spark, d).where("state = 'LEASED'")
    return metrics.age_histogram(leased, F.lit(1_705_708_800_000_000) - F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000, ["stream_id"])


@query(LOG + """, c AS (SELECT stream_id, min(log_offset) AS s, count(*) AS n, sum(length(props))::BIGINT AS b FROM log GROUP BY stream_id, log_offset // 500)
SELECT stream_id, to_json({'stream_id': stream_id, 'head_offset': sum(n)::BIGINT, 'first_offset': min(s), 'n_chunks': count(*), 'n_records': sum(n)::BIGINT, 'n_bytes': sum(b)::BIGINT})::VARCHAR AS doc FROM c GROUP BY 1""")
def storage_inspection(spark, d):
    rows = the_log(spark, d)
    return metrics.inspection(log.chunk_manifest(rows, 500, F.length("props")), log.registry_heads(rows))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, coalesce(max(value) FILTER (i = floor(n * 0.5)), 0) AS p500, coalesce(max(value) FILTER (i = floor(n * 0.95)), 0) AS p950, coalesce(max(value) FILTER (i = floor(n * 0.99)), 0) AS p990 FROM r GROUP BY 1""")
def latency_index_percentiles(spark, d):
    return metrics.index_percentiles(t(spark, d, "events"), "event_type", "value", [0.5, 0.95, 0.99], "event_id")


@query("SELECT printf('events_total{group=\"%s\"} %d', event_type, count(*)) AS line FROM events GROUP BY event_type")
def prometheus_lines(spark, d):
    m = t(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("value")).withColumn("name", F.lit("events_total"))
    return metrics.prometheus(m)


@query("""WITH b AS (SELECT file_id, subject, sum(CASE WHEN file_id % 3 = 0 THEN -record_count ELSE record_count END) OVER (PARTITION BY subject ORDER BY file_id)::BIGINT AS backlog FROM data_files) SELECT file_id, backlog, backlog >= 20 AS backpressure FROM b""")
def backlog_backpressure(spark, d):
    f = t(spark, d, "data_files").withColumn("delta", F.when(F.col("file_id") % 3 == 0, -F.col("record_count")).otherwise(F.col("record_count")))
    return metrics.backpressure(f, "file_id", "delta", 20, ["subject"], F.floor(F.col("file_id") / 512)).select("file_id", "backlog", "backpressure")


@query("""WITH h AS (SELECT DISTINCT batch_id, region_name, physical_ms - timestamp_us // 1000 AS lag_ms FROM batch_headers), r AS (SELECT *, row_number() OVER (PARTITION BY region_name ORDER BY lag_ms, batch_id) - 1 AS i, count(*) OVER (PARTITION BY region_name) AS n FROM h)
SELECT region_name, any_value(n) AS n, max(lag_ms) AS most, max(lag_ms) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY 1""")
def freshness_p95(spark, d):
    """The lag of batches; the percentile in two passes, so that no region's values meet in one buffer."""
    h = t(spark, d, "batch_headers").select("batch_id", F.coalesce("region_name", F.lit("")).alias("region_name"), (F.col("physical_ms") - F.floor(F.col("timestamp_us") / 1000)).alias("lag_ms")).distinct()
    p = metrics.index_percentiles(h, "region_name", "lag_ms", [0.95], "batch_id", 100.0)
    j = h.groupBy("region_name").agg(F.count(F.lit(1)).alias("n"), F.max("lag_ms").alias("most")).join(p, "region_name")
    return j.select(F.nullif("region_name", F.lit("")).alias("region_name"), "n", "most", F.col("p950").cast("bigint").alias("p95"))


@query("SELECT code, remediation, count(*) AS n FROM (SELECT printf('ERR-%03d', event_id % 16 + 1) AS code FROM events) JOIN (VALUES " + ", ".join(f"('ERR-{n:03d}', '{r.replace(chr(39), chr(39) * 2)}')" for n, _, r in metrics.DIAGNOSTICS) + ") v(code, remediation) USING (code) GROUP BY 1, 2")
def diagnostics_lookup(spark, d):
    e = t(spark, d, "events").groupBy(F.format_string("ERR-%03d", F.col("event_id") % 16 + 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(metrics.diagnostics(spark)), "code").select("code", "remediation", "n")


@query("SELECT batch_id, CASE WHEN flags % 2 = 1 THEN 'Degraded' WHEN batch_id % 5 = 0 OR batch_id % 7 = 0 THEN 'Unhealthy' WHEN batch_id % 11 = 0 THEN 'Degraded' ELSE 'Healthy' END AS status FROM (SELECT DISTINCT batch_id, flags FROM batch_headers)")
def readiness(spark, d):
    b = F.col("batch_id")
    probes = t(spark, d, "batch_headers").select("batch_id", "flags").distinct().select("batch_id", (F.col("flags") % 2 == 1).alias("draining"), (b % 5 != 0).alias("storage"), (b % 7 != 0).alias("state_plane"), (b % 11 != 0).alias("memory"))
    return metrics.readiness(probes).select("batch_id", "status")


# --- analytics -----------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS orders, round(sum(value), 2) AS revenue, round(avg(value), 4) AS average FROM events WHERE event_type = 'purchase' GROUP BY 1")
def hourly_revenue(spark, d):
    """Shredded payloads, committed to a ledger and read back through its snapshot."""
    s = shred.shred(_events_json(spark, d), "payload", ["event_type", "value"], keep=["ts"])
    book = ledger.Ledger(spark, scratch(spark, "revenue"))
    book.append(s)
    own = book.read().where("event_type = 'purchase'").select(F.date_trunc("hour", "ts").cast(NTZ).alias("hour"), F.expr("try_cast(value AS double)").alias("amount"))
    return own.groupBy("hour").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"), F.round(F.avg("amount"), 4).alias("average"))


@query("SELECT user_id AS sensor, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS n_new FROM events GROUP BY 1")
def sensor_rollup(spark, d):
    e = t(spark, d, "events")
    both = registry.evolve(e.where("ts < timestamp_ntz '2024-01-10'").select("user_id", "value"), e.where("ts >= timestamp_ntz '2024-01-10'").select("user_id", "value", F.lit(1).alias("version")))
    return both.groupBy(F.col("user_id").alias("sensor")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"), F.count("version").alias("n_new"))


@query("SELECT l_returnflag AS level, l_suppkey AS service, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, level, service LIMIT 10")
def top_errors(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("level"), F.col("l_suppkey").alias("service")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "level", "service").limit(10)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R' AND l_extendedprice > 1000")
def pushdown_range_filter(spark, d):
    where = "l_shipdate >= timestamp_ntz '1995-01-01' AND l_shipdate < timestamp_ntz '1996-01-01' AND l_returnflag = 'R' AND l_extendedprice > 1000"
    return log.pushdown(t(spark, d, "lineitem"), where, ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("SELECT count(*) AS scanned, count(*) FILTER (l_quantity > 40) AS matched FROM lineitem")
def pushdown_counts(spark, d):
    return log.pushdown_report(t(spark, d, "lineitem"), "l_quantity > 40")


@query("""WITH r AS (SELECT * FROM lineitem WHERE l_orderkey BETWEEN 100 AND 20000), m AS (SELECT * FROM r WHERE l_quantity > 40)
SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM r) AS scanned, (SELECT count(*) FROM m) AS matched FROM m ORDER BY l_orderkey, l_linenumber LIMIT 25""")
def pushdown_query(spark, d):
    return log.pushdown_query(t(spark, d, "lineitem"), "l_orderkey BETWEEN 100 AND 20000", "l_quantity > 40", ["l_orderkey", "l_linenumber", "l_quantity"], 25, ["l_orderkey", "l_linenumber"])


@query("SELECT event_type AS stream_id, count(*) AS ingested, count(*) AS stored, count(*) AS in_chunks FROM events GROUP BY 1")
def count_reconcile(spark, d):
    """What was taken in, what the log has when it is read back, and what its manifest says."""
    rows = the_log(spark, d)
    stored = log.registry_heads(rows).select("stream_id", F.col("n_records").alias("stored"))
    chunks = log.chunk_manifest(rows, 500, F.length("props")).groupBy("stream_id").agg(F.sum("n_records").alias("in_chunks"))
    return t(spark, d, "events").groupBy(F.col("event_type").alias("stream_id")).agg(F.count(F.lit(1)).alias("ingested")).join(stored, "stream_id", "full_outer").join(chunks, "stream_id", "full_outer")


@query("SELECT event_id, event_type FROM events")
def projection_subset(spark, d):
    return t(spark, d, "events").select("event_id", "event_type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def overflow_read(spark, d):
    s = shred.shred(_events_json(spark, d).withColumnRenamed("event_id", "id"), "payload", ["event_type"], keep=["id"])
    k = F.get_json_object(shred.OVERFLOW, "$.k").cast("bigint")
    return s.select(F.col("id").alias("event_id"), k.alias("k")).where("k > 50")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def time_range(spark, d):
    return log.pushdown(t(spark, d, "events"), "ts BETWEEN timestamp_ntz '2024-01-05' AND timestamp_ntz '2024-01-06'", ["event_id", "ts"])


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def stream_only(spark, d):
    return log.pushdown(t(spark, d, "events"), "event_type = 'view'", ["event_id", "value"])


@query(LOG + " SELECT log_offset, user_id, value FROM log WHERE stream_id = 'click' AND log_offset >= 10 AND user_id % 3 = 0 ORDER BY log_offset LIMIT 20")
def keyed_replay(spark, d):
    return log.pushdown(the_log(spark, d), "stream_id = 'click' AND log_offset >= 10 AND user_id % 3 = 0", ["log_offset", "user_id", "value"], 20, ["log_offset"])


# --- specified beyond the code -------------------------------------------------------------------------------------------


@query("SELECT file_path, file_size_bytes FROM data_files WHERE starts_with(file_path, 'lake/canal')")
def prefix_listing(spark, d):
    return t(spark, d, "data_files").where(F.col("file_path").startswith("lake/canal")).select("file_path", "file_size_bytes")


@query(LOG + ", c AS (SELECT stream_id, sum(length(props))::BIGINT AS b FROM log GROUP BY stream_id, log_offset // 500) SELECT stream_id, count(*) AS n_chunks, sum(b)::BIGINT AS n_bytes FROM c GROUP BY 1")
def manifest_totals(spark, d):
    return log.chunk_manifest(the_log(spark, d), 500, F.length("props")).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"))


@query(_PAY + """, top AS (SELECT field FROM f ORDER BY first_at, field LIMIT 64), x AS (SELECT o.payload_id, any_value(is_object) AS ok, count(*) FILTER (k.field IS NOT NULL AND k.field NOT IN (SELECT field FROM top)) AS extra FROM o LEFT JOIN k ON k.payload_id = o.payload_id GROUP BY 1)
SELECT payload_id, CASE WHEN NOT ok OR extra > 0 THEN 'rejected' ELSE 'accepted' END AS strict, CASE WHEN NOT ok THEN 'raw' WHEN extra > 0 THEN 'overflow' ELSE 'accepted' END AS permissive FROM x""")
def schema_modes(spark, d):
    s = shred_fixed_cap(spark, d)
    return s.select("payload_id", shred.mode_outcome("strict").alias("strict"), shred.mode_outcome("permissive").alias("permissive"))


@query("""WITH g AS (SELECT delivery_id, epoch_us(received_at) - epoch_us(lag(received_at) OVER (PARTITION BY queue_url, md5(message_body) ORDER BY received_at, delivery_id)) AS gap FROM sqs_messages)
SELECT delivery_id, coalesce(gap <= 600000000, false) AS duplicate FROM g""")
def content_dedup(spark, d):
    m = t(spark, d, "sqs_messages").select("delivery_id", "queue_url", F.md5("message_body").alias("h"), "received_at")
    return producer.window_duplicates(m, ["queue_url", "h"], "received_at", 600, ["delivery_id"], block=F.to_date("received_at")).select("delivery_id", "duplicate")


@query(_HIST + "SELECT committed, snapshot_id FROM h WHERE snapshot_id > (SELECT max(snapshot_id) FROM h) - 3 OR (committed >= DATE '2024-03-06' AND snapshot_id > (SELECT max(snapshot_id) FROM h) - 1000)")
def snapshot_retention(spark, d):
    return ledger.retained(_history(spark, d)[0], 3, F.lit("2024-03-06").cast("date")).select("committed", "snapshot_id")


@query(STATE + "SELECT stream_id, log_offset, state, attempts::INT AS attempts FROM s")
def overlay_restore(spark, d):
    rows, states = the_log(spark, d), the_states(spark, d)
    return overlay.restored(rows, overlay.snapshot(states), overlay.base_offsets(states)).select("stream_id", "log_offset", "state", "attempts")


@query(STATE + "SELECT stream_id, attempts::INT AS attempts, count(*) AS n FROM s WHERE state = 'LEASED' GROUP BY 1, 2")
def lease_attempt_histogram(spark, d):
    return the_states(spark, d).where("state = 'LEASED'").groupBy("stream_id", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT stream_id, logical_offset FROM record_entries WHERE stream_id IS NOT NULL)
SELECT stream_id, logical_offset AS source_offset, 500 + row_number() OVER (PARTITION BY stream_id ORDER BY logical_offset) - 1 AS own_offset FROM r""")
def bridge_offset_map(spark, d):
    r = t(spark, d, "record_entries").where("stream_id IS NOT NULL").select("stream_id", F.col("logical_offset").alias("source_offset")).distinct()
    own = log.dense_offsets(r, "stream_id", ["source_offset"], F.floor(F.col("source_offset") / 4096), "own_offset")
    return own.withColumn("own_offset", F.col("own_offset") + 500)


@query(STATE + """, b AS (SELECT stream_id, coalesce(min(log_offset) FILTER (event_id % 11 <> 0), max(log_offset) + 1) AS w_base FROM s GROUP BY 1)
SELECT stream_id, 'all' AS group_id, w_base FROM w UNION ALL SELECT stream_id, 'never_acks', w_base FROM b""")
def group_fanout(spark, d):
    """Two groups over one log, one of which never acknowledges: their overlays don't touch."""
    rows = the_log(spark, d)
    j = the_journal(spark, d, rows)
    both = j.withColumn("group_id", F.lit("all")).unionByName(j.where("op <> 'Ack'").withColumn("group_id", F.lit("never_acks")))
    key = ["stream_id", "group_id"]
    groups = rows.withColumn("group_id", F.explode(F.array(F.lit("all"), F.lit("never_acks"))))
    return overlay.base_offsets(overlay.state_of_log(groups, overlay.fold_journal(both, key), key), key).select("stream_id", "group_id", "w_base")


@query("SELECT subject, version, count(DISTINCT schema_id) AS n_entries FROM schema_entries GROUP BY 1, 2")
def schema_versions(spark, d):
    return t(spark, d, "schema_entries").groupBy("subject", "version").agg(F.count_distinct("schema_id").alias("n_entries"))


@query("SELECT event_id, least(event_id % 101, 64) AS n_columns, greatest(event_id % 101 - 64, 0) AS n_overflow FROM events")
def wide_payload_cap(spark, d):
    """Payloads of up to 100 fields, one a event, over a schema of 64."""
    n = (F.col("event_id") % 101).cast("int")
    name = lambda i: F.format_string('"field_%03d":"v%d"', i, i)
    body = F.concat(F.lit("{"), F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), name), ",")).otherwise(F.lit("")), F.lit("}"))
    wide = t(spark, d, "events").select("event_id", body.alias("payload"))
    names = [r.field for r in shred.first_come(shred.field_observations(wide.withColumn("at", F.lit(0)), "at", "payload")).collect()]  # at most 64 names
    return shred.split_report(wide, "event_id", "payload", names).select("event_id", "n_columns", "n_overflow")
