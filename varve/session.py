"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "varve", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a folder of our own if the master is local; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = f"file://{tempfile.gettempdir()}/varve-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch to Python, which bound a worker's memory and what the JVM holds beside it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH, for frames with whole texts; smaller settings stay."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing.

    Returns the frame and its path; call ``remove`` when the frame is no longer needed. What is left
    over is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def few(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most ``most`` rows, which are counted. df: stashed or cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return
