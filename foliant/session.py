"""Session settings, the shared work folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # per-row work is costly here (word splitting, nested records): merge only very small partitions below one per core
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # one entry, link target or class may hold a third of all rows: split such partitions at run time,
    # also when the split costs one more exchange after the join
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that come sorted by their group are gathered as they come, without a hash map that is sorted when it is full
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bound the memory of the Python helpers whatever the width of a row
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def local_session(cores: str = "*", memory: str = "8g", app: str = "foliant") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# folders made for sessions without a shared one, by application
_own_folders: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on one machine a temporary one where none is set."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":  # local[8] is one machine, local-cluster is not
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="foliant-")
    return _own_folders[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a table that is read as fewer tasks than there are cores.

    A table of many files has more tasks than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps neither recompute nor re-roll it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
