"""Bipartite projection and threshold search on weighted graphs: nodes (id, part), edges (src, dst[, weight])."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kindred.plans.work import materialise, ranked

from .clusters import connected_components

METRICS = (None, "jaccard", "dice", "overlap", "binary_cosine", "cosine")


def _weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


def check_bipartite(nodes: DataFrame, edges: DataFrame) -> None:
    a = nodes.select(F.col("id").alias("src"), F.col("part").alias("part_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("part").alias("part_b"))
    bad = edges.join(a, "src", "left").join(b, "dst", "left").filter(
        F.col("part_a").isNull() | F.col("part_b").isNull() | (F.col("part_a") == F.col("part_b"))
    )
    if nodes.agg(F.count_distinct("part")).first()[0] > 2 or not bad.isEmpty():
        raise TypeError("the graph is not bipartite")


def _checked(nodes: DataFrame, edges: DataFrame, metrics: list[str | None], check: bool) -> None:
    for m in metrics:
        if m not in METRICS:
            raise TypeError(f"unknown metric {m!r}")
    if check:
        check_bipartite(nodes, edges)


def shared_neighbours(nodes: DataFrame, edges: DataFrame, project: str, weighted: bool = True) -> DataFrame:
    """(a, b, m, dot, na, nb, qa, qb) of nodes of part ``project`` that share m neighbours, a < b; dot, qa and qb if ``weighted``.

    Nodes are numbered in their order. A neighbour sends each of its nodes the later ones, as one array;
    a node counts what it is sent in the task where that is, so no pair of a single neighbour is a row of an exchange.
    """
    own = nodes.filter(F.col("part") == project).select("id").distinct()
    e = _weighted(edges)
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("via"), "weight").union(
        e.select(F.col("dst").alias("id"), F.col("src").alias("via"), "weight")
    )
    own = materialise(ranked(own.filter("id is not null"), "id").withColumn("pos", F.col("pos").cast("int")), "nodes")
    ties = both.join(own, "id").groupBy("pos", "via").agg(F.max("weight").alias("w"))
    ties = materialise(ties if weighted else ties.select("pos", "via"), "ties")
    size = ties.groupBy("pos").agg(F.count("*").alias("n"), *([F.sum(F.col("w") * F.col("w")).alias("q")] if weighted else []))
    size = materialise(size.join(own, "pos"), "sizes")
    member = F.struct("pos", "w") if weighted else F.col("pos")
    groups = ties.filter("via is not null").groupBy("via").agg(F.sort_array(F.collect_list(member)).alias("all"))
    later = F.slice("all", F.col("i") + 2, F.size("all"))
    sent = groups.filter(F.size("all") > 1).select("all", F.posexplode("all").alias("i", "first")).filter(F.col("i") + 1 < F.size("all"))
    if weighted:
        sent = sent.select(F.col("first.pos").alias("x"), F.col("first.w").alias("wa"), later.alias("later"))
    else:
        sent = sent.select(F.col("first").alias("x"), later.alias("later"))
    # dealt by x alone, which also groups by (x, y)
    sent = sent.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x")
    each = sent.select("*", F.explode("later").alias("y")).drop("later")
    if weighted:
        met = each.groupBy("x", F.col("y.pos").alias("y")).agg(F.count("*").alias("m"), F.sum(F.col("wa") * F.col("y.w")).alias("dot"))
    else:
        met = each.groupBy("x", "y").agg(F.count("*").alias("m"))
    side = lambda pos, end: size.select(F.col("pos").alias(pos), F.col("id").alias(end), F.col("n").alias("n" + end), *([F.col("q").alias("q" + end)] if weighted else []))
    return met.join(side("x", "a"), "x").join(side("y", "b"), "y").drop("x", "y")


def weighed(met: DataFrame, metric: str | None = None, threshold: float | None = None) -> DataFrame:
    """(a, b, weight) of ``shared_neighbours``."""
    m, x, y = F.col("m"), F.col("na"), F.col("nb")
    weight = {
        None: lambda: m.cast("double"),
        "jaccard": lambda: m / (x + y - m),
        "dice": lambda: 2 * m / (x + y),
        "overlap": lambda: m / F.least(x, y),
        "binary_cosine": lambda: m / F.sqrt((x * y).cast("double")),
        "cosine": lambda: F.coalesce(F.try_divide("dot", F.sqrt(F.col("qa") * F.col("qb"))), F.lit(0.0)),
    }[metric]()
    out = met.select("a", "b", weight.alias("weight")).filter("weight <> 0")
    return out if threshold is None else out.filter(F.col("weight") >= threshold)


def monopartite_projection(
    nodes: DataFrame, edges: DataFrame, project: str, metric: str | None = None, threshold: float | None = None, check: bool = True
) -> DataFrame:
    """(a, b, weight) of nodes of part ``project`` that share neighbours, a < b.

    Weight: shared neighbours (no metric), a set metric of the neighbourhoods, or the cosine of the
    edge weights. Nodes without such an edge have none; they stay in ``nodes``.
    """
    _checked(nodes, edges, [metric], check)
    return weighed(shared_neighbours(nodes, edges, project, metric == "cosine"), metric, threshold)


def monopartite_projections(
    nodes: DataFrame, edges: DataFrame, project: str, metrics: list[str | None], threshold: float | None = None, check: bool = True
) -> DataFrame:
    """(metric, a, b, weight) by several metrics; shared neighbours are counted once and written."""
    _checked(nodes, edges, metrics, check)
    met = materialise(shared_neighbours(nodes, edges, project, "cosine" in metrics), "met")
    found = [weighed(met, m, threshold).select(F.lit(m).alias("metric"), "a", "b", "weight") for m in metrics]
    return reduce(DataFrame.union, found)


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size), isolated nodes included."""
    links = edges.filter("src <> dst").select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b"))
    labels = connected_components(links)
    each = nodes.select("id").join(labels, "id", "left").select(F.coalesce("component", "id").alias("component"))
    return each.groupBy("component").agg(F.count("*").alias("size"))


def second_largest_component_size(nodes: DataFrame, edges: DataFrame) -> int | None:
    top = component_sizes(nodes, edges).orderBy(F.desc("size")).limit(2).collect()
    return top[1]["size"] if len(top) == 2 else None


def floatsam_threshold(
    nodes: DataFrame, edges: DataFrame, start: float = 0.0, step: float = 0.05, max_drifter_size: int | None = None
) -> float:
    """The last threshold before the second largest component reaches ``max_drifter_size``.

    Thresholds rise by repeated addition, and never beyond the largest weight.
    """
    e = _weighted(edges)
    top = e.agg(F.max("weight")).first()[0]
    if top is None:
        return start
    drift = int(math.log(nodes.count())) if max_drifter_size is None else max_drifter_size
    threshold = start
    while True:
        best, threshold = threshold, threshold + step
        if threshold > top:
            return best
        size = second_largest_component_size(nodes, e.filter(F.col("weight") >= threshold))
        if size is not None and size >= drift:
            return best


def floatsam_sparsification(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """The edges at the found threshold or above."""
    return _weighted(edges).filter(F.col("weight") >= floatsam_threshold(nodes, edges, **options))
