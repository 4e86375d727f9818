"""Pairs to clusters: connected components, greedy balls, leaders; and the clustering operators.

Clusters are long frames (cluster_id, id); ``as_lists`` groups them. Greedy modes depend on an order,
which is the id's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions import metrics as M
from kindred.plans.work import materialise

from . import pairs as P

INF = 2**62


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in (id_a, id_b); the component is its smallest id.

    Each id points to the smallest within two links, pointers are followed to their ends, and links are
    contracted to those between ends, until none is left; so one round only meets all links. What a
    round finds is written to the shared folder, so it needs no growing lineage.
    """
    a, b = F.col("id_a"), F.col("id_b")
    links = materialise(edges.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")), "links")
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        both = links.union(links.select(b.alias("id_a"), a.alias("id_b")))
        near = materialise(both.groupBy(a.alias("id")).agg(F.min("id_b").alias("m")).select("id", F.least("id", "m").alias("m")), "near")
        least = both.join(near.withColumnRenamed("id", "id_b"), "id_b").groupBy(a.alias("id")).agg(F.min("m").alias("far"))
        labels = materialise(near.join(least, "id").select("id", F.least("m", "far").alias("component")), "labels")
        rounds.append(_followed(labels))
        end = lambda side: rounds[-1].select(F.col("id").alias(side), F.col("component").alias("end_" + side))
        left = links.join(end("id_a"), "id_a").join(end("id_b"), "id_b").filter("end_id_a <> end_id_b")
        left = left.select(F.least("end_id_a", "end_id_b").alias("id_a"), F.greatest("end_id_a", "end_id_b").alias("id_b"))
        links = materialise(left.distinct(), "links")
    found = rounds.pop()
    while rounds:
        on = found.select(F.col("id").alias("component"), F.col("component").alias("end"))
        found = rounds.pop().join(on, "component", "left").select("id", F.coalesce("end", "component").alias("component"))
    return found


def _followed(labels: DataFrame) -> DataFrame:
    """(id, component) with pointers to smaller ids followed to their ends."""
    while True:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        step = materialise(labels.join(up, "component").select("id", F.col("component").alias("old"), F.col("up").alias("component")), "labels")
        labels = step.select("id", "component")
        if step.filter("old <> component").isEmpty():
            return labels


def _sized(clusters: DataFrame, min_size: int, max_size: float) -> DataFrame:
    if min_size <= 1 and max_size >= INF:
        return clusters
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    kept = sizes.filter(F.col("_n").between(min_size, min(max_size, INF))).select("cluster_id")
    return clusters.join(kept, "cluster_id", "left_semi")


def component_clusters(edges: DataFrame, min_size: int = 2, max_size: float = INF) -> DataFrame:
    found = connected_components(edges).select(F.col("component").alias("cluster_id"), "id")
    return _sized(found, min_size, max_size)


def _greedy(edges: DataFrame, choose: Callable[[list[int], dict[int, list[int]]], list[tuple[int, int]]]) -> DataFrame:
    """Apply a sequential choice to each component; components are independent of each other."""
    labels = connected_components(edges)
    dealt = edges.select("id_a", "id_b").distinct().join(labels.withColumnRenamed("id", "id_a"), "id_a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        order: dict[int, None] = {}
        for a, b in sorted(zip(pdf["id_a"].tolist(), pdf["id_b"].tolist(), strict=True)):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
            order[a] = order[b] = None
        return pd.DataFrame(choose(list(order), near), columns=["cluster_id", "id"], dtype="int64")

    return dealt.groupBy("component").applyInPandas(run, "cluster_id long, id long")


def fuzzy_clusters(edges: DataFrame, min_size: int = 2, max_size: float = INF, by_id: bool = False) -> DataFrame:
    """Greedy balls: a node and its neighbours, unless an earlier ball holds the node; ids may repeat.

    Nodes come in order of first appearance in the sorted pairs, or by id. A ball outside the size
    bounds is skipped and marks nobody.
    """

    def choose(order: list[int], near: dict[int, list[int]]) -> list[tuple[int, int]]:
        seen: set[int] = set()
        out = []
        for node in sorted(order) if by_id else order:
            if node in seen or not min_size <= len(near[node]) + 1 <= max_size:
                continue
            ball = [node, *near[node]]
            seen.update(ball)
            out += [(node, x) for x in ball]
        return out

    return _greedy(edges, choose)


def leader_clusters(edges: DataFrame, min_size: int = 2, max_size: float = INF) -> DataFrame:
    """Each id joins its first leader; a leader is an id that no earlier leader has absorbed."""

    def choose(order: list[int], near: dict[int, list[int]]) -> list[tuple[int, int]]:
        taken: set[int] = set()
        out = []
        for node in sorted(order):
            if node in taken:
                continue
            group = [node, *sorted(x for x in near[node] if x > node and x not in taken)]
            taken.update(group)
            out += [(node, x) for x in group]
        return out

    return _sized(_greedy(edges, choose), min_size, max_size)


MODES = {"connected_components": component_clusters, "fuzzy_clusters": fuzzy_clusters, "leader": leader_clusters}


def clusters_from_pairs(
    edges: DataFrame, min_size: int = 2, max_size: float = INF, mode: str = "connected_components"
) -> DataFrame:
    if mode not in MODES:
        raise TypeError(f"unknown mode {mode!r}")
    return MODES[mode](edges, min_size, max_size)


def clusters_from_buckets(
    buckets: DataFrame,
    df: DataFrame | None = None,
    condition: P.Condition | None = None,
    mode: str = "connected_components",
    edits: int | None = None,
    **sizes,
) -> DataFrame:
    """Clusters of ids that share a key in (key, id) and, if given, meet the condition or are within so many edits.

    An arbitrary condition compares all pairs of a bucket; edits are joined by segments within it.
    """
    if condition is not None and edits is not None:
        raise TypeError("give a condition or edits, not both")
    if edits is not None:
        found = P.segment_pairs(buckets.join(df.select("id", "value"), "id"), edits, "key")
    else:
        found = P.pairs_from_buckets(buckets)
    if condition is not None:
        found = P.verify(found, df, condition)
    return clusters_from_pairs(found, mode=mode, **sizes)


def as_lists(clusters: DataFrame) -> DataFrame:
    """(cluster_id, ids): each cluster's ids, ascending."""
    return clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


# -- operators over rows (id, value)


def pairwise(df: DataFrame, similarity=None, distance=None, radius=None, mode: str = "connected_components", **sizes) -> DataFrame:
    """All pairs compared; any condition."""
    return clusters_from_pairs(P.theta_pairs(df, P.make_similarity_function(similarity, distance, radius)), mode=mode, **sizes)


def key_collision(
    df: DataFrame,
    key: Callable[[Column], Column] | None = None,
    keys: Callable[[Column], Column] | None = None,
    min_size: int = 2,
    max_size: float = INF,
    merge: bool = False,
) -> DataFrame:
    """Clusters of rows with the same key; null and empty keys are dropped.

    With ``keys`` (an array) buckets are clusters of their own, or components if ``merge``, which
    links each member to its bucket's smallest id, so a bucket costs its size and no more.
    (cluster_id, id): a bucket's cluster_id is its key's hash, a component's its smallest id.
    """
    if (key is None) == (keys is None):
        raise TypeError("either key or keys is needed")
    value = F.col("value")
    keyed = df.select("id", (key(value) if key is not None else F.explode(keys(value))).alias("key"))
    keyed = keyed.filter(F.col("key").isNotNull() & (F.col("key").cast("string") != "")).distinct()
    if merge and keys is not None:
        first = keyed.groupBy("key").agg(F.min("id").alias("id_a"))
        links = keyed.join(first, "key").filter("id <> id_a").select("id_a", F.col("id").alias("id_b"))
        return component_clusters(links, 2, INF)
    return _sized(keyed.select(F.xxhash64("key").alias("cluster_id"), "id"), min_size, max_size)


def blocking(df, block=None, blocks=None, similarity=None, distance=None, radius=None, mode="connected_components", max_block_size=None, **sizes) -> DataFrame:
    condition = P.make_similarity_function(similarity, distance, radius)
    return clusters_from_pairs(P.block_pairs(df, condition, block, blocks, max_block_size), mode=mode, **sizes)


def sorted_neighborhood(df, keys, window=10, similarity=None, distance=None, radius=None, mode="connected_components", **sizes) -> DataFrame:
    condition = P.make_similarity_function(similarity, distance, radius)
    return clusters_from_pairs(P.sorted_neighborhood_pairs(df, condition, keys, window), mode=mode, **sizes)


def adaptive_sorted_neighborhood(df, keys, similar, window=2, similarity=None, distance=None, radius=None, mode="connected_components", **sizes) -> DataFrame:
    condition = P.make_similarity_function(similarity, distance, radius)
    return clusters_from_pairs(P.adaptive_neighborhood_pairs(df, condition, similar, keys, window), mode=mode, **sizes)


def intersection_index(df: DataFrame, metric: str = "jaccard", radius: float = 0.8, **options) -> DataFrame:
    if metric not in ("jaccard", "overlap"):
        raise TypeError(f"unknown metric {metric!r}")
    return clusters_from_pairs(P.count_pairs(df, metric, radius), **options)


def minhash(df: DataFrame, radius: float = 0.8, h: int = 256, bands: int | None = None, seed: int = 0) -> DataFrame:
    return component_clusters(P.minhash_pairs(df, radius, h, bands, seed))


def passjoin(df: DataFrame, k: int, mode: str = "connected_components", **sizes) -> DataFrame:
    return clusters_from_pairs(P.segment_pairs(df, k), mode=mode, **sizes)


def quickjoin(df: DataFrame, distance=None, radius: float = 1, similarity=None, mode: str = "connected_components", **sizes) -> DataFrame:
    """Metric range join by pivots; a similarity s counts as the distance 1 - s."""
    if distance is None:
        return clusters_from_pairs(P.pivot_pairs(df, lambda a, b: 1 - similarity(a, b), 1 - radius), mode=mode, **sizes)
    return clusters_from_pairs(P.pivot_pairs(df, distance, radius), mode=mode, **sizes)


def vp_tree(df: DataFrame, distance, radius: float, min_size: int = 2, max_size: float = INF) -> DataFrame:
    """Balls around ids in their order, skipping ids that an earlier ball holds."""
    return fuzzy_clusters(P.pivot_pairs(df, distance, radius), min_size, max_size, by_id=True)


def laesa(df: DataFrame, distance, radius: float, pivots: int = 8, **options) -> DataFrame:
    """Clusters by pivot elimination: pairs whose pivot distances differ by more than the radius go."""
    return clusters_from_pairs(P.pivot_pairs(df, distance, radius, pivots), **options)


def nn_descent(df: DataFrame, distance, radius: float, k: int | None = None, **options) -> DataFrame:
    """Components of the approximate nearest-neighbour graph's edges within the radius."""
    graph = P.nn_descent(df, distance, k, **options).filter(F.col("score") <= radius)
    return component_clusters(graph.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))


def levenshtein(a: Column, b: Column) -> Column:
    return M.levenshtein_distance(a, b)
