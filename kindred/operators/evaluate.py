"""Clusters against a truth, and labels to clusters and back; frames are (item, cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def best_matching_macro_average(truth: DataFrame, predicted: DataFrame, allow_additional_items: bool = False) -> DataFrame:
    """One row (precision, recall, f1): macro means over truth clusters of their best predicted one.

    The best is the predicted cluster of largest F1; ties go to the smallest cluster id. Raises
    ValueError for empty inputs, an item in two predicted clusters, a truth item without prediction,
    or (unless allowed, when they are left out) predicted items that the truth does not know.
    """
    t = truth.select("item", F.col("cluster").alias("t")).distinct()
    p = predicted.select("item", F.col("cluster").alias("p")).distinct()
    if t.isEmpty() or p.isEmpty():
        raise ValueError("truth and predicted clusters must not be empty")
    if not p.groupBy("item").count().filter("count > 1").isEmpty():
        raise ValueError("an item is in two predicted clusters")
    if not t.join(p, "item", "left_anti").isEmpty():
        raise ValueError("an item of the truth is in no predicted cluster")
    extra = p.join(t, "item", "left_anti")
    if not allow_additional_items and not extra.isEmpty():
        raise ValueError("a predicted item is unknown to the truth")
    p = p.join(t.select("item").distinct(), "item", "left_semi")
    sizes_t = t.groupBy("t").agg(F.count("*").alias("nt"))
    sizes_p = p.groupBy("p").agg(F.count("*").alias("np"))
    met = t.join(p, "item").groupBy("t", "p").agg(F.count("*").alias("m")).join(sizes_t, "t").join(sizes_p, "p")
    met = met.withColumn("precision", F.col("m") / F.col("np")).withColumn("recall", F.col("m") / F.col("nt"))
    met = met.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    best = met.withColumn("r", F.row_number().over(W.partitionBy("t").orderBy(F.desc("f1"), "p"))).filter("r = 1")
    return best.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def labels_to_clusters(labels: DataFrame) -> DataFrame:
    """(cluster, items) of (item, cluster)."""
    return labels.groupBy("cluster").agg(F.array_sort(F.collect_list("item")).alias("items"))


def clusters_to_labels(clusters: DataFrame, items: str = "items") -> DataFrame:
    """(item, cluster) of (cluster, items)."""
    return clusters.select(F.explode(items).alias("item"), "cluster")
