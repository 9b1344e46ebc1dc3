"""Session construction and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of rows that go to a Python worker at once (and one row beyond), and most files a core that staged() writes of shuffled rows.
BATCH_BYTES, FILES = 4 << 20, 4


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "termloom") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where a local session left it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="termloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have BATCH_BYTES at most, or the session's own limit if that is less.

    By Spark's own limit, 10,000 rows or 64 MB, a batch of texts may take that much several times over at once:
    in the executor's direct memory, doubled as it fills, in the worker, and in both again on its way back.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))


def staged(df: DataFrame, name: str, shuffled: bool = False) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    shuffled: the rows come from a shuffle and are few beside the texts; at most FILES files a core are
    written, however many partitions the shuffle has. The folder is removed when the driver's file system closes.
    """
    spark = df.sparkSession
    if shuffled:
        df = df.coalesce(FILES * spark.sparkContext.defaultParallelism)
    path = f"{scratch_dir(spark)}/termloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
