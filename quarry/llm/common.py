"""What the operators share: scratch tables, words, and column helpers."""

from __future__ import annotations

import contextlib
import gc
import math
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of these characters parts two words (Java and Python spelling).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: What a batch that goes to a Python worker holds at most: rows, and bytes where Spark knows that limit.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that materialize() made and that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Let the session's batches to Python be no larger than BATCH; a task holds several copies of one, outside the heap and in its worker.

    Smaller bounds of the session stay; no row or result depends on them.
    """
    for key, most in BATCH.items():
        with contextlib.suppress(Py4JJavaError, PySparkException):  # a Spark without that limit
            now = spark.conf.get(key)
            size = float(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) if "Bytes" in key else int(now)
            if not 0 < size <= most:
                spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Let finished steps' shuffle files go now: they go with their plans, which the driver's JVM may keep for long."""
    spark.range(0, 1, 1, 1).collect()  # the last query's plan is held until another has run
    with contextlib.suppress(Py4JJavaError):  # events that wait for their listeners hold plans
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salt(column: str, rows: int, per_block: int) -> tuple[Column, int]:
    """A block number for each value of column, for blocks of about per_block rows."""
    n = max(1, math.ceil(rows / per_block))
    return F.pmod(F.xxhash64(F.lit("block"), F.col(column)), F.lit(n)).cast("int"), n
