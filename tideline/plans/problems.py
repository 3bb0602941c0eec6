"""Queries of the general data problems, over their whole tables with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import drift, late, redelivery, skew
from ..session import table as t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.surplus_copies(t(spark, d, "sqs_messages"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    cols = ["delivery_id", "receive_batch_id", "queue_url", "message_id", "message_deduplication_id", "sequence_number", "md5_of_body"]
    return redelivery.first_copies(t(spark, d, "sqs_messages")).select(*cols)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late.late_records(t(spark, d, "record_entries"), t(spark, d, "batch_headers"))


def p3_hourly(spark: SparkSession, d: str) -> DataFrame:
    return late.period_counters(t(spark, d, "record_entries"), t(spark, d, "batch_headers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_key_report([("stream", t(spark, d, "record_entries"), "stream_id"), ("tenant", t(spark, d, "lease_deltas"), "tenant_id")])


def p4_streams(spark: SparkSession, d: str) -> DataFrame:
    return skew.stream_totals(t(spark, d, "record_entries"), t(spark, d, "streams"))


def p4_tenants(spark: SparkSession, d: str) -> DataFrame:
    return skew.tenant_ops(t(spark, d, "lease_deltas"))


def p4_tagged(spark: SparkSession, d: str) -> DataFrame:
    return skew.tagged_records(t(spark, d, "record_entries"), t(spark, d, "streams"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(t(spark, d, "schema_entries"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.ingest(t(spark, d, "shred_payloads"), t(spark, d, "data_files"), t(spark, d, "schema_entries"))


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The declared columns of all subjects' tables, a row per value in the column of its type."""
    return drift.cells(drift.ingest(t(spark, d, "shred_payloads"), t(spark, d, "data_files"), t(spark, d, "schema_entries"), promote="none"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p3_found, p3_hourly, p4_found, p4_streams, p4_tenants, p4_tagged, p5_found, p5_table, p5_cells)}

_P1 = r"""
WITH RECURSIVE m AS (
  SELECT delivery_id AS id, sequence_number AS seq, queue_url AS q,
         nullif(lower(trim(message_id, E' \t\n\r\f\v')), '') AS a, nullif(lower(trim(message_deduplication_id, E' \t\n\r\f\v')), '') AS b
  FROM sqs_messages),
star AS (
  SELECT id, min(id) OVER (PARTITION BY q, a) AS lead FROM m WHERE a IS NOT NULL AND q IS NOT NULL
  UNION SELECT id, min(id) OVER (PARTITION BY q, b) FROM m WHERE b IS NOT NULL AND q IS NOT NULL),
edge AS (SELECT id AS x, lead AS y FROM star WHERE id <> lead UNION SELECT lead, id FROM star WHERE id <> lead),
reach(id, root) AS (SELECT id, id FROM m UNION SELECT e.y, r.root FROM reach r JOIN edge e ON e.x = r.id),
kept AS (SELECT r.id, arg_min(r.root, (s.seq IS NULL, coalesce(s.seq, 0), s.id)) AS first FROM reach r JOIN m s ON s.id = r.root GROUP BY r.id)
"""

_P3 = """
WITH h AS (SELECT DISTINCT batch_id, timestamp_us, physical_ms FROM batch_headers),
r AS (SELECT DISTINCT record_id, batch_id, stream_id, payload_len, timestamp_delta_ms FROM record_entries),
e AS (SELECT r.*, physical_ms * 1000 AS came, ((timestamp_us + 1000 * timestamp_delta_ms) // 3600000000 + 1) * 3600000000 AS ended FROM r JOIN h USING (batch_id)),
v AS (SELECT *, CASE WHEN came < ended THEN 'on_time' WHEN came < ended + 7200000000 THEN 'late' ELSE 'too_late' END AS verdict FROM e WHERE timestamp_delta_ms IS NOT NULL)
"""

_P5 = """
WITH e AS (SELECT subject, version, arg_min(definition::JSON, schema_id) AS j FROM schema_entries GROUP BY 1, 2),
l AS (SELECT subject, version, unnest(json_extract(j, '$.fields[*]')) AS f FROM e WHERE json_type(j, '$.fields') = 'ARRAY'),
o AS (SELECT subject, version, j, unnest(json_keys(j, '$.fields')) AS k FROM e WHERE json_type(j, '$.fields') = 'OBJECT'),
ov AS (SELECT subject, version, j, k, json_extract(j, '$.fields."' || k || '"') AS v FROM o),
r AS (
  SELECT subject, version, f->>'$.name' AS path, f->>'$.type' AS t, true AS top, f->>'$.field_id' AS no, coalesce(CAST(json_extract(f, '$.aliases') AS VARCHAR[]), []) AS former FROM l
  UNION ALL SELECT subject, version, k, CASE WHEN json_type(v) = 'OBJECT' THEN 'struct' ELSE v->>'$' END, true, NULL, CASE WHEN json_extract_string(j, '$.renamed_from."' || k || '"') IS NULL THEN [] ELSE [json_extract_string(j, '$.renamed_from."' || k || '"')] END FROM ov
  UNION ALL SELECT subject, version, path || '.' || (c->>'$.name'), c->>'$.type', false, NULL, [] FROM (SELECT subject, version, f->>'$.name' AS path, unnest(json_extract(f, '$.fields[*]')) AS c FROM l WHERE lower(f->>'$.type') IN ('struct', 'record'))
  UNION ALL SELECT subject, version, k || '.' || c, json_extract_string(i, '$."' || c || '"'), false, NULL, [] FROM (SELECT subject, version, k, i, unnest(json_keys(i)) AS c FROM (SELECT subject, version, k, json_extract(v, '$.*')[1] AS i FROM ov WHERE json_type(v) = 'OBJECT'))),
x AS (SELECT subject, version, path, top, no, former, CASE lower(t) WHEN 'boolean' THEN 'bool' WHEN 'int32' THEN 'int' WHEN 'integer' THEN 'int' WHEN 'int64' THEN 'long' WHEN 'bigint' THEN 'long' WHEN 'float32' THEN 'float'
  WHEN 'real' THEN 'float' WHEN 'float64' THEN 'double' WHEN 'utf8' THEN 'string' WHEN 'text' THEN 'string' WHEN 'bytes' THEN 'binary' WHEN 'record' THEN 'struct' ELSE lower(t) END AS type FROM r),
n AS (SELECT subject, version, lag(version) OVER (PARTITION BY subject ORDER BY version) AS prev FROM e),
m AS (SELECT n.subject, n.version, n.prev, a.path AS pa, a.type AS ta FROM n JOIN x a ON a.subject = n.subject AND a.version = n.prev),
born AS (SELECT b.*, n.prev FROM x b JOIN n ON n.subject = b.subject AND n.version = b.version WHERE n.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x a WHERE a.subject = b.subject AND a.version = n.prev AND a.path = b.path)),
gone AS (SELECT a.*, n.version AS upto FROM x a JOIN n ON n.subject = a.subject AND n.prev = a.version WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.subject = a.subject AND b.version = n.version AND b.path = a.path)),
tied AS (SELECT b.subject, b.version, b.path, b.type, g.path AS was, g.type AS was_type FROM born b JOIN gone g ON g.subject = b.subject AND g.upto = b.version AND b.top AND g.top AND (b.no = g.no OR list_contains(b.former, g.path)))
"""

ORACLE = {
    "p1_found": _P1 + "SELECT id AS delivery_id FROM kept WHERE id <> first",
    "p1_kept": _P1 + "SELECT delivery_id, receive_batch_id, queue_url, message_id, message_deduplication_id, sequence_number, md5_of_body FROM sqs_messages JOIN kept ON id = delivery_id WHERE id = first",
    "p3_found": _P3 + "SELECT record_id, verdict FROM v WHERE verdict <> 'on_time'",
    "p3_hourly": _P3
    + """SELECT stream_id, make_timestamp(ended - 3600000000) AS period_start, count(*) FILTER (verdict = 'on_time') AS first_count,
  coalesce(sum(payload_len) FILTER (verdict = 'on_time'), 0)::BIGINT AS first_bytes, count(*) FILTER (verdict <> 'too_late') AS corrected_count,
  coalesce(sum(payload_len) FILTER (verdict <> 'too_late'), 0)::BIGINT AS corrected_bytes, count(*) FILTER (verdict = 'too_late') AS dropped_count
FROM v GROUP BY stream_id, ended""",
    "p4_found": """SELECT 'stream' AS key_kind, stream_id AS key_value FROM record_entries WHERE stream_id IS NOT NULL GROUP BY stream_id HAVING count(*) > 0.02 * (SELECT count(*) FROM record_entries)
UNION ALL SELECT 'tenant', tenant_id::VARCHAR FROM lease_deltas WHERE tenant_id IS NOT NULL GROUP BY tenant_id HAVING count(*) > 0.02 * (SELECT count(*) FROM lease_deltas)""",
    "p4_streams": """SELECT r.stream_id, count(*) AS n_records, sum(coalesce(payload_len, 0))::BIGINT AS n_bytes, max(logical_offset) AS max_offset, any_value(tenant_id) AS tenant_id, any_value(stream_name) AS stream_name
FROM record_entries r LEFT JOIN streams s ON s.stream_id = r.stream_id GROUP BY r.stream_id""",
    "p4_tenants": """SELECT tenant_id, count(*) FILTER (op = 'Acquire') AS n_acquire, count(*) FILTER (op = 'Ack') AS n_ack, count(*) FILTER (op = 'Nack') AS n_nack,
  count(*) FILTER (op = 'EvictDlq') AS n_evictdlq, count(*) FILTER (op IS NULL OR op NOT IN ('Acquire', 'Ack', 'Nack', 'EvictDlq')) AS n_other FROM lease_deltas GROUP BY tenant_id""",
    "p4_tagged": "SELECT record_id, r.stream_id, payload_len, tenant_id FROM record_entries r LEFT JOIN streams s ON s.stream_id = r.stream_id",
    "p5_found": _P5 + """SELECT subject, version, path AS field_name, 'renamed' AS change_kind FROM tied
UNION ALL SELECT subject, version, path, 'type_changed' FROM tied WHERE type <> was_type
UNION ALL SELECT m.subject, m.version, m.pa, 'type_changed' FROM m JOIN x b ON b.subject = m.subject AND b.version = m.version AND b.path = m.pa WHERE b.type <> m.ta
UNION ALL SELECT subject, version, path, 'added' FROM born b WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.subject = b.subject AND t.version = b.version AND t.path = b.path)
UNION ALL SELECT subject, upto, path, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.subject = g.subject AND t.version = g.upto AND t.was = g.path)""",
    "p5_cells": _P5.replace("WITH e", "WITH RECURSIVE e", 1) + """, f AS (SELECT file_id, any_value(subject) AS subject, any_value(schema_version) AS version FROM data_files GROUP BY 1),
p AS (SELECT payload_id, any_value(file_id) AS file_id, any_value(payload) AS payload FROM shred_payloads WHERE payload_id IS NOT NULL GROUP BY 1),
q AS (SELECT payload_id, f.subject, coalesce(f.version, -1) AS version, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM p JOIN f USING (file_id)),
w AS (SELECT payload_id, subject, version, j FROM q WHERE json_type(j) = 'OBJECT' AND subject IN (SELECT subject FROM e)),
k AS (SELECT payload_id, subject, version, a.id, a.type AS t, a.value AS v, replace(substr(a.fullkey, 3), '"', '') AS path FROM w, LATERAL (SELECT * FROM json_tree(w.j)) a
  WHERE a.key IS NOT NULL AND NOT contains(a.fullkey, '[') AND (a.type <> 'OBJECT' OR a.value::VARCHAR = '{}')),
target AS (SELECT x.subject, path AS name, type FROM x JOIN (SELECT subject, max(version) AS version FROM e GROUP BY 1) USING (subject, version)),
tops AS (SELECT DISTINCT subject, version, split_part(path, '.', 1) AS top FROM k),
chain(subject, version, top, upto, now) AS (SELECT subject, version, top, version, top FROM tops
  UNION ALL SELECT c.subject, c.version, c.top, r.version, r.path FROM chain c JOIN tied r ON r.subject = c.subject AND r.was = c.now AND r.version > c.upto
    WHERE r.version = (SELECT min(version) FROM tied s WHERE s.subject = c.subject AND s.was = c.now AND s.version > c.upto)),
latest AS (SELECT subject, version, top, arg_max(now, upto) AS now FROM chain GROUP BY 1, 2, 3),
named AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM target g WHERE g.subject = k.subject AND g.name = k.path) THEN path ELSE now || substr(path, length(top) + 1) END AS name
  FROM k JOIN latest z ON z.subject = k.subject AND z.version = k.version AND z.top = split_part(k.path, '.', 1)),
taken AS (SELECT n.*, g.type AS kind, v->>'$' AS s, row_number() OVER (PARTITION BY payload_id, n.name ORDER BY length(path) - length(replace(path, '.', '')), id) AS nth FROM named n JOIN target g ON g.subject = n.subject AND g.name = n.name
  WHERE (t = 'NULL' AND g.type <> 'struct') OR (g.type = 'bool' AND t = 'BOOLEAN') OR (g.type IN ('string', 'binary') AND t = 'VARCHAR') OR (g.type IN ('float', 'double') AND t IN ('BIGINT', 'UBIGINT', 'DOUBLE'))
    OR (g.type = 'int' AND t IN ('BIGINT', 'UBIGINT') AND TRY_CAST(v->>'$' AS INTEGER) IS NOT NULL) OR (g.type = 'long' AND t IN ('BIGINT', 'UBIGINT') AND TRY_CAST(v->>'$' AS BIGINT) IS NOT NULL))
SELECT subject, payload_id, name AS field_name, CASE WHEN kind = 'bool' THEN s::BOOLEAN END AS bool_value, CASE WHEN kind IN ('int', 'long') THEN s::BIGINT END AS long_value,
  CASE WHEN kind IN ('float', 'double') THEN s::DOUBLE END AS double_value, CASE WHEN kind IN ('string', 'binary') THEN s END AS text_value FROM taken WHERE nth = 1""",
}
