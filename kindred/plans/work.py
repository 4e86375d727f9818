"""The shared work folder, and ranking without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a local session gets a temporary folder, any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Add the rank (from 0) in the order of the columns, which must order rows fully.

    Rows are dealt by range and written; ranges are numbered by their row counts, one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        dealt.withColumn("_nth", within)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_nth") - 1).cast("long"))
        .drop("_part", "_nth", "_before")
    )
