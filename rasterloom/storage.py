"""Tables, scratch storage and bounded broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many short rows may be broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{shared_dir(spark)}/rasterloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; results that still read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, keys: list[str] | str, how: str = "inner") -> DataFrame:
    """A join whose sides are shuffled and merged, for sides that grow with the input.

    Rows of few distinct values shrink to little on disk, so that Spark would send them through the
    driver by the size of their files: hundreds of MB from files of a few.
    """
    return left.join(right.hint("merge"), keys, how)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``spark.sql.shuffle.partitions`` says, however few its bytes are.

    For rows that grow within their task: Spark would join tasks by the size of what is sent, and what comes of it would spill.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: So many rows of pixels are a task's share where few bytes are sent for them.
TASK_ROWS = 200_000


def shared_out(df: DataFrame, rows: int, *keys: str, share: int = TASK_ROWS) -> DataFrame:
    """``df`` of so many ``rows`` dealt by ``keys`` to tasks of about ``share`` rows each, so that a task's memory does not grow with the input.

    Few rows still get a task for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // share), min(cores, -(-rows // 10_000)), 1), *keys)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` written, and hinted for broadcast only if its counted rows are within ``limit``; and whether they are."""
    kept = written(df, "small")
    fits = kept.count() <= limit
    return (F.broadcast(kept) if fits else kept), fits
