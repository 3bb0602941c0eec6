"""Governance: access decisions, point-in-time restore, legal hold, crypto-shredding, the audit chain."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import little_endian

GENESIS = "5a" * 32


def authorize(requests: DataFrame, rules: DataFrame, key: str = "request_id") -> DataFrame:
    """Each request with its decision: tenant gate, then deny overrides, then allow, else deny.

    requests: request_id (unique; see ``key``), tenant_id, roles, action, resource_tenant; rules: effect, tenant_scope (null: all), required_roles (empty: all), actions.
    Only ``super-admin`` passes the tenant gate. Rules that agree in action and role (any for none required) fold to the effects they have for all
    tenants and for some; requests meet them by equality on action and role, so no request walks through the rules.
    """
    role = F.explode(F.when(F.size("required_roles") > 0, F.col("required_roles")).otherwise(F.array(F.lit(None).cast("string"))))
    flat = rules.select("effect", "tenant_scope", F.explode("actions").alias("action"), "required_roles").select("effect", "tenant_scope", "action", role.alias("role_"))
    per = flat.groupBy("action", "role_", "tenant_scope").agg(F.bool_or(F.col("effect") == "deny").alias("denies"), F.bool_or(F.col("effect") == "allow").alias("allows"))
    per = per.withColumnsRenamed({"action": "action_", "tenant_scope": "scope_"})
    asked = requests.select(key, "tenant_id", "action", F.explode(F.array_union(F.coalesce("roles", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("role_"))
    # a rule for all tenants and one for the request's own are two keys
    both = asked.select(key, "action", "role_", F.explode(F.array_distinct(F.array(F.col("tenant_id"), F.lit(None).cast("bigint")))).alias("scope"))
    same = (F.col("action") == F.col("action_")) & F.col("r.role_").eqNullSafe(F.col("p.role_")) & F.col("scope").eqNullSafe(F.col("scope_"))
    hits = both.alias("r").join(per.alias("p"), same).groupBy(F.col(f"r.{key}").alias(key)).agg(F.bool_or("denies").alias("denies_"), F.bool_or("allows").alias("allows_"))
    gate = (F.col("tenant_id") == F.col("resource_tenant")) | F.array_contains("roles", "super-admin")
    decision = F.when(~F.coalesce(gate, F.lit(False)), "deny:tenant").when(F.col("denies_"), "deny:rule").when(F.col("allows_"), "allow").otherwise("deny:default")
    return requests.join(hits, key, "left").select(*requests.columns, decision.alias("decision"))


def restore(records: DataFrame, destroyed: DataFrame, ts: str, cutoff: Column, key: str) -> DataFrame:
    """Point-in-time restore: records up to the cut-off whose key isn't destroyed. Records without a key are plain."""
    return records.where(F.col(ts) <= cutoff).join(destroyed.select(key).distinct(), key, "left_anti")


def restore_report(records: DataFrame, destroyed: DataFrame, ts: str, cutoff: Column, key: str) -> DataFrame:
    """How many records the restore recovers and how many a destroyed key blocks."""
    gone = destroyed.select(F.col(key), F.lit(True).alias("gone")).distinct()
    j = records.where(F.col(ts) <= cutoff).join(gone, key, "left")
    return j.agg(F.count_if(F.col("gone").isNull()).alias("recovered"), F.count_if("gone").alias("blocked"))


def visible(records: DataFrame, holds: DataFrame, ts: str, oldest: Column, key: str) -> DataFrame:
    """Retention: records that haven't expired, and expired ones under legal hold."""
    held = holds.select(F.col(key), F.lit(True).alias("held")).distinct()
    return records.join(held, key, "left").where((F.col(ts) >= oldest) | F.col("held")).drop("held")


def encrypt(df: DataFrame, column: str, keys: DataFrame, key_id: str, aad: Column, iv: Column | None = None) -> DataFrame:
    """AES-GCM of a column under the row's key (keys: key_id, dek binary); ``aad`` binds the ciphertext to its stream."""
    args = [F.col("dek"), F.lit("GCM"), F.lit("DEFAULT"), *([iv] if iv is not None else [F.lit("")]), aad]
    return df.join(keys, key_id, "left").withColumn("ciphertext", F.aes_encrypt(F.col(column), *args)).drop("dek", column)


def decrypt(df: DataFrame, keys: DataFrame, key_id: str, aad: Column, into: str = "payload") -> DataFrame:
    """The inverse; NULL where the key is destroyed or the context doesn't fit. Destroying a key is deleting its row."""
    plain = F.try_aes_decrypt(F.col("ciphertext"), F.col("dek"), F.lit("GCM"), F.lit("DEFAULT"), aad)
    return df.join(keys, key_id, "left").withColumn(into, F.when(F.col("dek").isNotNull(), plain.cast("string"))).drop("dek", "ciphertext")


def audit_hash(prev: Column, columns: Sequence[str]) -> Column:
    """SHA-256 over the previous hash and all fields, each with its length, so that fields can't run into each other."""
    parts = [prev]
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts.append(F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat_ws("|", *parts), 256)


def build_chain(events: DataFrame, columns: Sequence[str], partition: str = "tenant_id", order: str = "seq") -> DataFrame:
    """record_hash and prev_hash per partition in order.

    A chain is strictly sequential, so it is one task's; it is streamed in order with one hash of state, never held. Chains are independent.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])
    cols = list(dict.fromkeys([partition, order, *columns]))
    ordered = events.select(*cols, body.alias("body_")).repartition(partition).sortWithinPartitions(partition, order)

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, began = None, GENESIS, False
        for b in batches:
            before, own = [], []
            for k, text in zip(b.column(partition).to_pylist(), b.column("body_").to_pylist(), strict=True):
                if k != now or not began:
                    now, last, began = k, GENESIS, True
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*cols, "prev_hash", "record_hash"])

    types = {f.name: f.dataType.simpleString() for f in events.schema}
    return ordered.mapInArrow(link, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", prev_hash string, record_hash string")


def verify_chain(chain: DataFrame, columns: Sequence[str], partition: str = "tenant_id", order: str = "seq") -> DataFrame:
    """Each record with ``intact``: its hash is that of its fields, and its prev_hash is the hash before it."""
    before = F.coalesce(F.lag("record_hash").over(Window.partitionBy(partition).orderBy(order)), F.lit(GENESIS))
    return chain.withColumn("intact", (F.col("prev_hash") == before) & (F.col("record_hash") == audit_hash(F.col("prev_hash"), columns)))


# keys, their destruction, holds ------------------------------------------------------------------------------------------


def new_keys(wanted: DataFrame) -> DataFrame:
    """(tenant_id, dek_id, dek): a fresh random 256-bit key for each row; write it before it is used, for another read makes others."""

    @F.pandas_udf("binary")
    def key(n: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_bytes(32) for _ in n])

    return wanted.select("tenant_id", "dek_id", key.asNondeterministic()("dek_id").alias("dek"))


def erase_keys(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """The key table without the keys to destroy (tenant_id, dek_id); what was encrypted with them can't be read again."""
    return keys.join(targets.select("tenant_id", "dek_id").distinct(), ["tenant_id", "dek_id"], "left_anti")


def active_keys(references: DataFrame, destroyed: DataFrame) -> DataFrame:
    """Each reference to a key (tenant_id, dek_id, ...) with ``active``: whether the registry of destroyed keys lacks it."""
    gone = destroyed.select("tenant_id", "dek_id", F.lit(True).alias("gone_")).distinct()
    return references.join(gone, ["tenant_id", "dek_id"], "left").withColumn("active", F.col("gone_").isNull()).drop("gone_")


def erasure_checksum(proof_id: Column, tenant: Column, dek_id: Column, erased_at_ns: Column, operator: Column, reason: Column) -> Column:
    """CRC-32 over proof id, tenant, key id and time (8 bytes each, least first), operator and reason. The stream isn't part of it."""
    return F.crc32(F.concat(proof_id.cast("binary"), tenant, little_endian(dek_id, 8), little_endian(erased_at_ns, 8), operator.cast("binary"), reason.cast("binary")))


def erasure_proofs(targets: DataFrame) -> DataFrame:
    """A proof of erasure for each destroyed key (tenant_id: 16 bytes, dek_id, stream_id, destroyed_at_ns, operator_id, reason), with its checksum."""
    first = F.conv(F.hex(F.substring("tenant_id", 1, 1)), 16, 10)
    named = targets.withColumn("proof_id", F.concat(F.lit("PROOF-SHRED-"), first, F.lit("-"), F.col("dek_id").cast("string"), F.lit("-"), F.col("destroyed_at_ns").cast("string")))
    check = erasure_checksum(*[F.col(c) for c in ("proof_id", "tenant_id", "dek_id", "destroyed_at_ns", "operator_id", "reason")])
    return named.select("proof_id", "tenant_id", "dek_id", "stream_id", F.col("destroyed_at_ns").alias("erased_at_ns"), "operator_id", "reason", check.alias("verification_checksum"))


def valid_proofs(proofs: DataFrame) -> DataFrame:
    """Proofs with ``valid``: their checksum is that of their attributes."""
    check = erasure_checksum(*[F.col(c) for c in ("proof_id", "tenant_id", "dek_id", "erased_at_ns", "operator_id", "reason")])
    return proofs.withColumn("valid", F.coalesce(F.col("verification_checksum") == check, F.lit(False)))


def active_holds(events: DataFrame, key: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The keys under legal hold after a log of events (key, at, kind): those whose last event is ``apply``, not ``release``."""
    last = events.groupBy(*key).agg(F.max_by("kind", F.struct(*at)).alias("kind"))
    return last.where("kind = 'apply'").select(*key)


def held_records(records: DataFrame, holds: DataFrame, key: Sequence[str]) -> DataFrame:
    """The records under an active hold."""
    return records.join(holds, list(key), "left_semi")
