"""Identifiers of the queue gateway and fenced tokens, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def queue_group(url: Column) -> Column:
    """The consumer group of a queue: its last path segment."""
    return F.concat(F.lit("sqs-group-"), F.element_at(F.split(url, "/"), -1))


def message_id(sequence: Column, body: Column) -> Column:
    return F.format_string("msg-%016x-%s", sequence, F.substring(F.md5(body), 1, 8))


def receipt_handle(shard: Column, epoch: Column, offset: Column, nonce: Column) -> Column:
    return F.format_string("RH-%08x-%016x-%016x-%08x", shard, epoch, offset, nonce)


def parse_handle(handle: Column) -> Column:
    """struct<shard,epoch,log_offset,nonce>, NULL where the text is no handle. Values above 2^63 - 1 aren't supported."""
    ok = handle.rlike("^RH-[0-9a-f]{8}-[0-9a-f]{16}-[0-9a-f]{16}-[0-9a-f]{8}$")
    part = lambda i: F.conv(F.element_at(F.split(handle, "-"), i), 16, 10).cast("bigint")
    return F.when(ok, F.struct(part(2).alias("shard"), part(3).alias("epoch"), part(4).alias("log_offset"), part(5).alias("nonce")))


def pack_token(shard: Column, epoch: Column, nonce: Column) -> Column:
    """The 64-bit wire form: 16 bits of shard, 16 of epoch, 32 of nonce; lossy beyond them. A shard from 32768 on makes a negative number."""
    return F.shiftleft(shard.cast("bigint").bitwiseAND(F.lit(0xFFFF)), 48).bitwiseOR(F.shiftleft(epoch.cast("bigint").bitwiseAND(F.lit(0xFFFF)), 32)).bitwiseOR(nonce.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_token(token: Column) -> Column:
    return F.struct(F.shiftrightunsigned(token, 48).alias("shard"), F.shiftrightunsigned(token, 32).bitwiseAND(F.lit(0xFFFF)).alias("epoch"), token.bitwiseAND(F.lit(0xFFFFFFFF)).alias("nonce"))


def little_endian(n: Column, size: int) -> Column:
    """The lowest ``size`` bytes of an integer, least first."""
    text = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(size)]))


def from_little_endian(raw: Column, at: int, size: int) -> Column:
    """The unsigned integer in ``size`` bytes from ``at`` on (from 0); as bigint, so 8 bytes wrap at 2^63."""
    text = F.hex(F.substring(raw, at + 1, size))
    turned = F.concat(*[F.substring(text, 2 * size - 1 - 2 * i, 2) for i in range(size)])
    if size < 8:
        return F.conv(turned, 16, 10).cast("bigint")
    half = lambda i: F.conv(F.substring(turned, i, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def token_bytes(shard: Column, epoch: Column, offset: Column, nonce: Column) -> Column:
    """The lossless 24-byte form: shard 4, epoch 8, offset 8, nonce 4 bytes, each least byte first."""
    return F.concat(little_endian(shard, 4), little_endian(epoch, 8), little_endian(offset, 8), little_endian(nonce, 4))


def parse_token_bytes(raw: Column) -> Column:
    """struct<shard,epoch,log_offset,nonce>, NULL where there aren't 24 bytes."""
    parts = F.struct(*[from_little_endian(raw, at, size).alias(name) for name, at, size in (("shard", 0, 4), ("epoch", 4, 8), ("log_offset", 12, 8), ("nonce", 20, 4))])
    return F.when(F.octet_length(raw) == 24, parts)


def xxh64(c: Column, seed: int = 0) -> Column:
    """XXH64 of a text's UTF-8 or of bytes, as a signed 64-bit number, bit for bit the published function; NULL for NULL.

    Spark's own expression with another seed than the 42 its SQL function fixes, so it stays inside generated code; where there is no JVM session
    (Spark Connect) a Pandas UDF.
    """
    sc = SparkContext._active_spark_context
    if sc is None:

        @F.pandas_udf("bigint")
        def of(v: pd.Series) -> pd.Series:
            import xxhash

            raw = [None if x is None else xxhash.xxh64(x, seed=seed).intdigest() for x in v]
            return pd.Series([None if h is None else h - (h >> 63 << 64) for h in raw], dtype="Int64")

        return of(c)
    from pyspark.sql.classic.column import Column as Classic

    jvm = sc._jvm
    of_jvm = jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.PythonUtils.toSeq([of_jvm.expression(c._jc)]), seed)
    return F.when(c.isNotNull(), Classic(of_jvm.column(hashed)))


#: The seeds of the two halves of a topic's stream id, the number of shards, and a ring's points a node.
STREAM_SEEDS = (0xCAFEBABE, 0xDEADBEEF)
SHARDS, VNODES = 1024, 128


def hex_id(raw: Column) -> Column:
    """Bytes as they are shown: lower-case hex."""
    return F.lower(F.hex(raw))


def topic_stream(topic: Column, partition: Column) -> Column:
    """The 16-byte stream id of a topic's partition: two seeded hashes of name and partition."""
    text = F.concat(topic.cast("binary"), little_endian(partition, 4))
    return F.concat(*[little_endian(xxh64(text, seed), 8) for seed in STREAM_SEEDS])


def tenant_stream(tenant: Column, name: Column, partition: Column | None = None) -> Column:
    """The 16-byte stream id of a queue URL, a routing key, or a bridged topic with its partition: the first 8 bytes of the tenant's id, then the name's hash."""
    text = name.cast("binary") if partition is None else F.concat(name.cast("binary"), little_endian(partition, 4))
    return F.concat(F.substring(tenant, 1, 8), little_endian(xxh64(text), 8))


def shard_of(hashed: Column) -> Column:
    """The shard of a 64-bit hash: its upper half modulo SHARDS."""
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(SHARDS))


def uri_prefix(hashed: Column) -> Column:
    """Four hex digits, the top 16 bits of a hash, that spread objects over a store's partitions."""
    return F.lpad(F.lower(F.hex(F.shiftrightunsigned(hashed, 48))), 4, "0")


def chunk_uri(bucket: str, tenant: Column, stream: Column, start: Column, end: Column) -> Column:
    """Where a chunk lies in the object store; tenant and stream are 16 bytes each."""
    prefix = uri_prefix(xxh64(F.concat(tenant, stream, little_endian(start, 8))))
    return F.concat(F.lit(f"s3://{bucket}/chunks/"), prefix, F.lit("/"), hex_id(tenant), F.lit("/"), hex_id(stream), F.lit("/"), start.cast("string"), F.lit("_"), end.cast("string"), F.lit(".chk"))


def strict_text(raw: Column) -> Column:
    """The text of bytes that are valid UTF-8, NULL for others."""
    return F.try_validate_utf8(raw.cast("string"))


def token_outcome(token_shard: Column, token_epoch: Column, shard: Column, epoch: Column, offset: Column, head: Column) -> Column:
    """Whether a fenced token is valid at a shard's epoch and head."""
    return F.when(token_shard != shard, "wrong_shard").when(token_epoch < epoch, "fenced").when(token_epoch > epoch, "from_the_future").when(offset > head, "beyond_head").otherwise("valid")


def page_padded(size: Column, page: int = 4096) -> Column:
    """Bytes a record run takes on whole pages."""
    return (F.ceil(size / page) * page).cast("bigint")


def exchange_outcome(exchange: Column) -> Column:
    """Exchange kinds the queue gateway doesn't route: the topic and headers exchanges themselves, and any that is named as a topic."""
    return F.when((exchange == "amq.topic") | exchange.contains(".topic."), "rejected:topic").when(exchange == "amq.headers", "rejected:headers").otherwise("routed")
