"""Session defaults, the shared work folder and size checks."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation (in bytes) that the library will ask Spark to broadcast.
BROADCAST_BYTES = 256 * 1024 * 1024

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_work_folder() -> str:
    folder = tempfile.mkdtemp(prefix="emberline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session whose driver and executors are one process may go without the setting; it gets a temporary folder
    that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_work_folder()
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def _scratch_root(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/emberline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _table_prefix(spark: SparkSession) -> str:
    """Start of the names of this application's bucketed tables."""
    return "emberline_" + spark.sparkContext.applicationId.lower().replace("-", "_") + "_"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store ``path`` names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; indexes and tables that read them are unusable afterwards."""
    for table in spark.catalog.listTables(pattern=f"{_table_prefix(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    delete_path(spark, _scratch_root(spark))


def broadcast_bytes(spark: SparkSession) -> int:
    """Largest relation to broadcast from this driver, whose heap holds it several times over meanwhile."""
    return min(BROADCAST_BYTES, spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // 8)


def materialize(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives Catalyst the real
    size of the result. Its path is added to ``made``, for callers that delete it when nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` once to the shared folder, in ``buckets`` by ``key``; joins on ``key`` then read it without a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = _table_prefix(spark) + uuid.uuid4().hex
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows. Counted task by task; a stored table is counted by the footers of its files."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` stays under ``limit`` bytes.

    ``row_bytes`` is the caller's upper estimate for one row. A larger relation comes back
    without a hint, so that Catalyst and AQE choose a shuffled join.
    """
    return F.broadcast(df) if has_at_most(df, limit // row_bytes) else df
