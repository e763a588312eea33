"""Helpers shared by the corpus operators: words, scratch tables, ranks and checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is handed at once; one longer row makes a batch of its own. Spark's own limits (10,000
#: rows, 64 MB) let a worker and the buffers of its executor grow by several times that.
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder only where none is set and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,\]]*(, *\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    steps that led here. The copy is columnar and compressed, and its size is
    known to the planner.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stashed: DataFrame) -> None:
    """Delete a stashed table that no later step reads."""
    spark = stashed.sparkSession
    for file in stashed.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def give_back() -> None:
    """Return freed memory to the system; glibc keeps it otherwise, in a worker that waits for its next task as well."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with batches of about BATCH_BYTES, after which a worker gives back what it has freed.

    Spark reads the limit from the session when the plan runs, so it stays set.
    """

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted ``rows`` are at most ``most``; else the planner joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add a dense 1-based position in ``order`` without gathering the rows in one task.

    Rows are dealt by range, numbered inside each range, and shifted by the
    sizes of the ranges before (one row per range).
    """
    dealt = stash(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + local).cast("long")).drop("_range", "_start")
