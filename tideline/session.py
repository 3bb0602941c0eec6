"""Session, table and shared-folder helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings record_entries batch_headers "
    "streams lease_deltas sqs_messages schema_entries data_files shred_payloads mix_targets containers"
).split()


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster the caller brings its own."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tideline")
    for k, v in base.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, whose executors are this very process, may do without one; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        # a session that already checkpoints somewhere keeps its folder
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, at[7:], True)
        sc.setCheckpointDir(at)
        return at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; dropped by ``release``, at the latest when the session's JVM ends."""
    at = f"{shared_dir(spark).rstrip('/')}/tideline/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of a table that is written once an application, by its first user; after ``release`` it is written anew."""
    app = spark.sparkContext.applicationId
    at = _kept.get((app, name))
    if at is None or at not in _made.get(app, ()):
        at = scratch(spark, "kept")
        write(at)
        _kept[app, name] = at
    return at


def release(spark: SparkSession) -> int:
    """Drop every intermediate table this application has written so far; to be called once the results made of them are written. Returns how many there were."""
    at = _made.pop(spark.sparkContext.applicationId, [])
    for a in at:
        drop_path(spark, a)
    return len(at)


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.delete(path, True)
    fs.cancelDeleteOnExit(path)


def local_path(uri: str) -> str | None:
    """The POSIX path of a file URI, None for other file systems."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def settle(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as a table in the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    at = scratch(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, for CPU-heavy maps over a few small files.

    Only a plain scan with fewer splits than cores is repartitioned; anything larger, or made of more than scans, projections and filters, stays as it is.
    """
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation", "LogicalRelationWithTable"):
            return df
        todo += [node.children().apply(i) for i in range(node.children().size())]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
