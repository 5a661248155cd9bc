"""Session-level helpers: parallel scans and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, tempfile.TemporaryDirectory] = {}


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan only when it has fewer splits than the cluster has cores.

    A 100 TB scan has far more splits than cores and passes through untouched; one
    small file would otherwise run every expression above it in a single task.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.TemporaryDirectory(
            prefix="corpusloom-", ignore_cleanup_errors=True
        )
    return _LOCAL_SCRATCH[app].name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and return a scan of what was written.

    Cuts the lineage, survives the loss of executors, and fixes values that depend on the
    physical layout (partition numbers). ``DataFrame.checkpoint`` would run the plan twice.
    """
    spark = df.sparkSession
    path = f"{_own_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written in this application.

    To be called when the results that build on it have been read or written.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on rows go to Python tasks in Arrow batches of about ``size``.

    Spark's own limit is 64 MB, held several times over by the JVM and by the worker, for every
    core; a limit that the session has set itself stays.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":
        spark.conf.set(limit, size)


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize`` plus the number of rows, observed while writing."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]
