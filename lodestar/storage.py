"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is made only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in a total order, without sorting everything in one task.

    Rows are dealt by ranges and written once; each range is numbered on its own and moved up by the number of
    rows in the ranges before it.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = checkpointed(dealt)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")
