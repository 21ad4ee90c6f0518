"""Cutting lineage and numbering rows without a task that sees them all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session of one machine gets one where ``spark.checkpoint.dir`` is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to ``spark.checkpoint.dir``; a session of one machine gets a folder where that is unset."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessitura-"))
    return df.checkpoint()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what is read again is computed once."""
    path = f"{shared_folder(df.sparkSession)}/tessitura/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, n: int, most: int = 4096) -> DataFrame:
    """Ids from 0 to ``n`` - 1, dealt out to a task each. Rows made from them have no estimated size, which would be that of
    the ids and have them broadcast."""
    ids = spark.sparkContext.parallelize(range(n), max(1, min(most, n))).map(lambda t: (t,))
    return spark.createDataFrame(ids, "id long")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 0 in the order of columns that tell them apart.

    Rows are dealt out by ranges and numbered within them; only the ranges' sizes meet in one task.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = ranges.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1)
    return within.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")
