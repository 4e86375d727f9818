"""Similarity joins by metric and threshold: the strategy is chosen here, the plan is Catalyst's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kindred.operators import pairs

SET_METRICS = ("jaccard", "dice", "overlap", "binary_cosine")


def similarity_pairs(df: DataFrame, metric: str, threshold: float, strategy: str | None = None) -> DataFrame:
    """(id_a, id_b, score) of rows (id, value) at ``threshold`` or better.

    ``value`` is an array for set metrics and a string for "levenshtein" (threshold: the largest
    distance). Set metrics take the prefix filter (overlap: shared-token counts, as its
    bound gives no prefix); edit distance takes wildcard keys at 1 and segments beyond.
    """
    if metric == "levenshtein":
        k = int(threshold)
        strategy = strategy or ("wildcard" if k == 1 else "segments")
        if strategy == "segments":
            return pairs.segment_pairs(df, k)
        if strategy == "wildcard" and k == 1:
            return pairs.wildcard_pairs(df)
        if strategy == "naive":
            return pairs.naive_pairs(df, metric, threshold)
    elif metric in SET_METRICS:
        strategy = strategy or ("count" if metric == "overlap" else "prefix")
        if strategy == "prefix" and metric != "overlap":
            return pairs.prefix_pairs(df, metric, threshold)
        if strategy == "count":
            return pairs.count_pairs(df, metric, threshold)
        if strategy == "naive":
            return pairs.naive_pairs(df, metric, threshold)
    raise TypeError(f"no strategy {strategy!r} for metric {metric!r} at {threshold!r}")
