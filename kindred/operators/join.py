"""Two-sided joins on derived keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def hashjoin(
    left: DataFrame,
    right: DataFrame,
    key: Callable[[Column], Column] | None = None,
    keys: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(left_id, right_id, left_value, right_value) of rows (id, value) with an equal key.

    Null keys are equal. With ``keys`` (an array) a pair comes once if the key sets meet.
    """
    if (key is None) == (keys is None):
        raise TypeError("either key or keys is needed")
    a = left.select(F.col("id").alias("left_id"), F.col("value").alias("left_value"))
    b = right.select(F.col("id").alias("right_id"), F.col("value").alias("right_value"))
    columns = ["left_id", "right_id", "left_value", "right_value"]
    if key is not None:
        x, y = a.withColumn("_k", key(F.col("left_value"))), b.withColumn("_j", key(F.col("right_value")))
        return x.join(y, F.col("_k").eqNullSafe(F.col("_j"))).select(*columns)
    x = a.select("left_id", F.explode(F.array_distinct(keys(F.col("left_value")))).alias("_k"))
    y = b.select("right_id", F.explode(F.array_distinct(keys(F.col("right_value")))).alias("_j"))
    met = x.join(y, F.col("_k").eqNullSafe(F.col("_j"))).select("left_id", "right_id").distinct()
    return met.join(a, "left_id").join(b, "right_id").select(*columns)
