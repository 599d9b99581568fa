"""Session settings and shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# What tables are written with; doubles take about a tenth less than with the default.
COMPRESSION = "zstd"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# What the plans assume of any session; none changes a result.
ASSUMED = {
    # Panels hash-partitioned by symbol join on (symbol, trade_date) as they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The JVM never compiles methods beyond 8,000 bytes of code; let wide
    # projections use split methods instead of one interpreted giant.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A stored table's shuffles are never read again: their files go when the table is there, not when the
    # driver's collector happens to run.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(
    app: str = "barquet", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Session with the settings the plans assume.

    On a cluster leave `shuffle_partitions` unset: adaptive execution starts
    from spark.sql.adaptive.coalescePartitions.initialPartitionNum and merges
    small partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(map=ASSUMED)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def assume(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the settings the plans assume."""
    for key, value in ASSUMED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barquet-"))
        folder = context.getCheckpointDir()
    return folder


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts long lineages; the written table survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", COMPRESSION)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames; others are left alone. Nothing may read them afterwards."""
    for df in frames:
        folder = _FOLDERS.pop(df, None)
        if folder is not None:
            delete_folder(df.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(spark: SparkSession, *jobs: Callable) -> list:
    """Results of jobs that do not depend on each other, run side by side: while one is planned, others
    compute. Waits for all of them, also if one fails."""
    with ThreadPoolExecutor(max(len(jobs), 1)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [job.result() for job in started]
