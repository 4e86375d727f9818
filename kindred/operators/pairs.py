"""Candidate generation and verification: rows (id, value) to pairs (id_a, id_b, score), id_a < id_b.

Every strategy is an equi-join on what it derives from the value, a distinct, and a check of the
metric, so Catalyst picks the join and AQE splits skewed keys. Values are strings for edit distances
and arrays of strings for set metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions import keys as K, metrics as M, sketch
from kindred.plans.work import materialise, ranked

EPSILON = 1e-6
COMMON = 64  # values that may share a segment and meet by it
Condition = Callable[[Column, Column], Column]

SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard": M.jaccard_similarity,
    "dice": M.dice_coefficient,
    "overlap": M.overlap_coefficient,
    "binary_cosine": M.binary_cosine_similarity,
}


def make_similarity_function(
    similarity: Condition | None = None, distance: Condition | None = None, radius: float | None = None
) -> Condition:
    """A condition on two columns: similarity >= radius, or distance <= radius.

    Without radius the function's own truth counts (a distance is negated). Similarity wins.
    """
    if similarity is None and distance is None:
        raise TypeError("a similarity or a distance is needed")
    if similarity is not None:
        return similarity if radius is None else (lambda a, b: similarity(a, b) >= radius)
    return (lambda a, b: ~distance(a, b).cast("boolean")) if radius is None else (lambda a, b: distance(a, b) <= radius)


def _score(metric: str, a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) if metric == "levenshtein" else SIMILARITIES[metric](a, b)


def _passes(metric: str, threshold: float) -> Column:
    return F.col("score") <= threshold if metric == "levenshtein" else F.col("score") >= threshold


def _with_values(pairs: DataFrame, df: DataFrame) -> DataFrame:
    a = df.select(F.col("id").alias("id_a"), F.col("value").alias("value_a"))
    b = df.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"))
    return pairs.join(a, "id_a").join(b, "id_b")


def verify(pairs: DataFrame, df: DataFrame, condition: Condition) -> DataFrame:
    """Pairs (id_a, id_b) whose values meet the condition."""
    both = _with_values(pairs.select("id_a", "id_b"), df)
    return both.filter(condition(F.col("value_a"), F.col("value_b"))).select("id_a", "id_b")


def _scored(pairs: DataFrame, df: DataFrame, metric: str, threshold: float) -> DataFrame:
    both = _with_values(pairs, df)
    score = _score(metric, F.col("value_a"), F.col("value_b"))
    return both.withColumn("score", score).filter(_passes(metric, threshold)).select("id_a", "id_b", "score")


def pairs_from_buckets(buckets: DataFrame, max_block_size: int | None = None) -> DataFrame:
    """(id_a, id_b) of ids that share a key in (key, id); each pair once."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    if max_block_size:
        sizes = sizes.filter(F.col("n") <= max_block_size)
    kept = buckets.join(sizes.select("key"), "key")
    a, b = kept.select("key", F.col("id").alias("id_a")), kept.select("key", F.col("id").alias("id_b"))
    return a.join(b, "key").filter("id_a < id_b").select("id_a", "id_b").distinct()


def naive_pairs(df: DataFrame, metric: str, threshold: float) -> DataFrame:
    """All pairs compared; the ground truth for small inputs."""
    a = df.select(F.col("id").alias("id_a"), F.col("value").alias("value_a"))
    b = df.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"))
    score = _score(metric, F.col("value_a"), F.col("value_b"))
    both = a.join(b, F.col("id_a") < F.col("id_b"))
    return both.withColumn("score", score).filter(_passes(metric, threshold)).select("id_a", "id_b", "score")


def theta_pairs(df: DataFrame, condition: Condition) -> DataFrame:
    """All pairs (id_a < id_b) that meet an arbitrary condition; quadratic by nature."""
    a = df.select(F.col("id").alias("id_a"), F.col("value").alias("value_a"))
    b = df.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"))
    on = (F.col("id_a") < F.col("id_b")) & condition(F.col("value_a"), F.col("value_b"))
    return a.join(b, on).select("id_a", "id_b")


def block_pairs(
    df: DataFrame,
    condition: Condition | None,
    block: Callable[[Column], Column] | None = None,
    blocks: Callable[[Column], Column] | None = None,
    max_block_size: int | None = None,
) -> DataFrame:
    """Pairs that share a block key (``block`` gives one, ``blocks`` an array) and meet the condition."""
    if (block is None) == (blocks is None):
        raise TypeError("either block or blocks is needed")
    keyed = (
        df.select("id", block(F.col("value")).alias("key"))
        if block is not None
        else df.select("id", F.explode(F.array_distinct(blocks(F.col("value")))).alias("key"))
    )
    pairs = pairs_from_buckets(keyed, max_block_size)
    return pairs if condition is None else verify(pairs, df, condition)


def sorted_neighborhood_pairs(
    df: DataFrame, condition: Condition | None, keys: list[Callable[[Column], Column]], window: int = 10
) -> DataFrame:
    """Pairs at most ``window`` - 1 places apart in the order of a key; one pass per key."""
    if window < 2:
        raise ValueError("window must be at least 2")
    found = None
    for key in keys:
        order = ranked(df.select("id", key(F.col("value")).alias("key")), "key", "id").select("id", "pos")
        near = order.select(
            F.col("id").alias("x"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window - 1)).alias("pos")
        )
        both = near.join(order.withColumnRenamed("id", "y"), "pos")
        both = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        found = both if found is None else found.union(both)
    found = found.distinct()
    return found if condition is None else verify(found, df, condition)


def adaptive_neighborhood_pairs(
    df: DataFrame,
    condition: Condition,
    similar: Callable[[object, object], bool],
    keys: list[Callable[[Column], Column]],
    window: int = 2,
) -> DataFrame:
    """Sorted neighbourhood with windows that grow while their ends are alike.

    ``similar`` is the condition as a Python function: finding the windows is one sequential pass
    over the sorted values, which one task streams; the pairs inside windows are compared by a join.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    found = None
    for key in keys:
        order = ranked(df.select("id", "value", key(F.col("value")).alias("key")), "key", "id")

        def runs(batches, window=window):
            import pandas as pd

            ids, values = [], []
            for pdf in batches:
                pdf = pdf.sort_values("pos")
                ids += pdf["id"].tolist()
                values += pdf["value"].tolist()
            rows = [(r, i) for r, (s, e) in enumerate(adaptive_windows(values, similar, window)) for i in ids[s : e + 1] if e > s]
            yield pd.DataFrame(rows, columns=["key", "id"])

        spans = order.select("id", "value", "pos").coalesce(1).sortWithinPartitions("pos").mapInPandas(runs, f"key long, id {df.schema['id'].dataType.simpleString()}")
        pairs = pairs_from_buckets(materialise(spans, "runs"))
        found = pairs if found is None else found.union(pairs)
    return verify(found.distinct(), df, condition)


def adaptive_windows(values: list, similar: Callable[[object, object], bool], window: int) -> list[tuple[int, int]]:
    """(first, last) of each run: jump ahead while the ends are alike, then step back to an alike pair."""
    out, start, n = [], 0, len(values)
    while start < n:
        last, probe = min(start + window - 1, n - 1), start
        if last == start:
            out.append((start, last))
            break
        while probe < last and similar(values[probe], values[last]):
            reach = last - start
            probe, last = last, min(last + max(reach, window - 1), n - 1)
        while last - start + 1 > window and not similar(values[last - 1], values[last]):
            last -= 1
        out.append((start, last))
        start = last + 1
    return out


# -- set similarity


def token_sets(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_distinct("value").alias("value"))


def count_pairs(df: DataFrame, metric: str = "jaccard", threshold: float = 0.8) -> DataFrame:
    """Exact join by counting shared tokens (intersection index)."""
    if metric not in ("jaccard", "overlap", "dice", "binary_cosine"):
        raise TypeError(f"unknown metric {metric!r}")
    posts = df.select("id", F.size(F.array_distinct("value")).alias("n"), F.explode(F.array_distinct("value")).alias("token"))
    a = posts.select("token", F.col("id").alias("id_a"), F.col("n").alias("n_a"))
    b = posts.select("token", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    both = a.join(b, "token").filter("id_a < id_b").groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("m"))
    m, x, y = F.col("m"), F.col("n_a"), F.col("n_b")
    score = {
        "jaccard": m / (x + y - m),
        "overlap": m / F.least(x, y),
        "dice": 2 * m / (x + y),
        "binary_cosine": m / F.sqrt((x * y).cast("double")),
    }[metric]
    return both.withColumn("score", score).filter(F.col("score") >= threshold).select("id_a", "id_b", "score")


def _bounds(metric: str, t: float):
    """(prefix length of n tokens, smallest partner of n tokens, largest partner) as Columns of n."""
    e = EPSILON
    return {
        "jaccard": (lambda n: F.floor((1 - t) * n + 1 + e), lambda n: F.ceil(t * n - e), lambda n: F.floor(n / t + e)),
        "dice": (
            lambda n: F.floor((1 - t / (2 - t)) * n + 1 + e),
            lambda n: F.ceil(t / (2 - t) * n - e),
            lambda n: F.floor((2 - t) / t * n + e),
        ),
        "binary_cosine": (
            lambda n: F.floor((1 - t * t) * n + 1 + e),
            lambda n: F.ceil(t * t * n - e),
            lambda n: F.floor(n / (t * t) + e),
        ),
    }[metric]


def prefix_pairs(df: DataFrame, metric: str = "jaccard", threshold: float = 0.8, ordering: str = "freq") -> DataFrame:
    """Exact set-similarity join by prefix, length and position filters.

    Tokens are ordered rarest first ("freq") or by CRC-32 ("crc32"); alike sets share a token of
    their prefixes. Empty sets pair with nothing.
    """
    if metric not in ("jaccard", "dice", "binary_cosine"):
        raise TypeError(f"unknown metric {metric!r}")
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    prefix, least, most = _bounds(metric, threshold)
    posts = df.select("id", F.explode(F.array_distinct("value")).alias("token"))
    if ordering == "freq":
        rarity = posts.groupBy("token").agg(F.count("*").alias("rank"))
        posts = posts.join(rarity, "token")
    elif ordering == "crc32":
        posts = posts.withColumn("rank", sketch.crc32("token"))
    else:
        raise TypeError(f"unknown ordering {ordering!r}")
    sets = materialise(
        posts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("value")),
        "sets",
    )
    n = F.size("value")
    probes = sets.select("id", n.alias("n"), F.posexplode(F.slice("value", F.lit(1), prefix(n).cast("int"))).alias("at", "token"))
    a = probes.select("token", F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = probes.select("token", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    na, nb = F.col("n_a"), F.col("n_b")
    need = {
        "jaccard": threshold / (1 + threshold) * (na + nb),
        "dice": threshold * (na + nb) / 2,
        "binary_cosine": threshold * F.sqrt((na * nb).cast("double")),
    }[metric]
    room = 1 + F.least(na - F.col("at_a"), nb - F.col("at_b")) - 1 + F.least("at_a", "at_b")
    fits = (nb >= least(na)) & (nb <= most(na)) & (room >= need - EPSILON)
    found = a.join(b, "token").filter((F.col("id_a") < F.col("id_b")) & fits).select("id_a", "id_b").distinct()
    return _scored(found, sets, metric, threshold)


def minhash_pairs(df: DataFrame, threshold: float = 0.8, h: int = 256, bands: int | None = None, seed: int = 0) -> DataFrame:
    """Banded MinHash candidates, verified by exact Jaccard."""
    bands = bands or sketch.guess_bands(h, threshold)
    rows = h // bands
    if rows < 1:
        raise ValueError("more bands than hashes")
    signed = df.filter(F.size("value") > 0).select("id", sketch.minhash("value", h, seed).alias("sig"))
    band = lambda i: F.xxhash64(i, F.array_join(F.transform(F.slice(F.col("sig"), i * rows + 1, F.lit(rows)), lambda x: x.cast("string")), ","))
    keyed = signed.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    return _scored(pairs_from_buckets(keyed), df, "jaccard", threshold)


def simhash_pairs(df: DataFrame, threshold: float = 0.8, f: int = 128, bands: int = 8) -> DataFrame:
    """Candidates that share a band of simhash bits, verified by token-frequency cosine."""
    width = 64 // (bands * 64 // f)
    signed = df.select("id", sketch.simhash("value", f).alias("sig"))
    per = 64 // width
    band = lambda i: F.struct(i.alias("band"), F.call_function("shiftrightunsigned", F.get(F.col("sig"), (i / per).cast("int")), (i % per) * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits"))
    keyed = signed.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(f // width - 1)), band)).alias("key"))
    both = _with_values(pairs_from_buckets(keyed), df)
    score = M.cosine_similarity(F.col("value_a"), F.col("value_b"))
    return both.withColumn("score", score).filter(F.col("score") >= threshold).select("id_a", "id_b", "score")


# -- edit distance


def partition(k: int, n: int) -> list[tuple[int, int, int]]:
    """(number, start, length) of the k + 1 segments of a string of n characters, the shorter ones first."""
    short, longer = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i >= k + 1 - longer)
        out.append((i, at, size))
        at += size
    return out


def segments(k: int, s: str) -> list[str]:
    return [s[start : start + size] for _, start, size in partition(k, len(s))]


def probe_interval(k: int, delta: int, i: int, s: int, start: int, size: int) -> tuple[int, int]:
    """First and last start in a string of length s where segment i of a string s - delta long can stand."""
    slack = k - i
    return max(0, start - i, start + delta - slack), min(start + i, start + delta + slack, s - size)


def segment_pairs(df: DataFrame, k: int, block: str | None = None) -> DataFrame:
    """Exact edit-distance join by shared segments (PassJoin), of rows with one ``block`` column if it is named.

    The windows of substrings to probe depend on lengths alone: one row of them per length,
    neighbour length and segment, which is joined to the strings by length. Equal values are compared
    once. Values with a segment that over ``COMMON`` values have meet by what up to k deletions leave
    of them instead, which two values within k edits share, so no segment makes all pairs of its values.
    """
    spark = df.sparkSession
    rows = df.filter("value is not null").select("id", "value", (F.col(block) if block else F.lit(0)).alias("block"))
    values = materialise(rows.select("block", "value").distinct().withColumn("n", F.length("value")), "values")
    lengths = sorted(r["n"] for r in values.select("n").distinct().collect())
    known = set(lengths)
    cuts = [(n, i, start, size) for n in lengths for i, start, size in partition(k, n)]
    probes = [
        (n, m, i, lo, hi, size)
        for n in lengths
        for m in range(max(0, n - k), n + 1)
        if m in known
        for i, start, size in partition(k, m)
        for lo, hi in [probe_interval(k, n - m, i, n, start, size)]
        if lo <= hi
    ]
    cut_table = spark.createDataFrame(cuts or [(0, 0, 0, 0)], "n int, seg int, start int, size int")
    probe_table = spark.createDataFrame(probes or [(-1, 0, 0, 0, 0, 0)], "n int, m int, seg int, lo int, hi int, size int")
    indexed = values.join(cut_table, "n").select(
        "block", F.col("value").alias("value_b"), F.col("n").alias("m"), "seg", F.expr("substring(value, start + 1, size)").alias("piece")
    )
    probing = values.join(probe_table, "n").select(
        "block", F.col("value").alias("value_a"), "n", "m", "seg",
        F.explode(F.expr("array_distinct(transform(sequence(lo, hi), p -> substring(value, p + 1, size)))")).alias("piece"),
    )
    on = ["block", "m", "seg", "piece"]
    common = materialise(indexed.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > COMMON).select(on), "common")
    found = probing.join(indexed.join(common, on, "left_anti"), on).filter((F.col("n") > F.col("m")) | (F.col("value_a") < F.col("value_b")))
    near = lambda pairs: pairs.withColumn("score", F.levenshtein("value_a", "value_b", k)).filter("score >= 0")
    ends = (F.least("value_a", "value_b").alias("value_a"), F.greatest("value_a", "value_b").alias("value_b"))
    found = near(found.filter("value_a <> value_b").select("block", *ends).distinct())
    if not common.isEmpty():
        crowded = materialise(probing.join(common, on, "left_semi").select("block", F.col("value_a").alias("value")).distinct(), "crowded")
        left = crowded.select("block", "value", F.explode(F.array_distinct(_deletions("value", k))).alias("left"))
        left = left.select("block", "value", F.xxhash64("left").alias("left"))
        a, b = left.withColumnRenamed("value", "value_a"), left.withColumnRenamed("value", "value_b")
        found = found.union(near(a.join(b, ["block", "left"]).filter("value_a < value_b").select("block", "value_a", "value_b"))).distinct()
    ids = rows.withColumn("rep", F.struct("block", "value")).select("rep", "id")
    reps = found.select(F.struct("block", F.col("value_a").alias("value")).alias("rep_a"), F.struct("block", F.col("value_b").alias("value")).alias("rep_b"), "score")
    copies = ids.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(0).alias("score"))
    return _members(reps.union(copies), ids)


def _deletions(value: str, k: int) -> Column:
    """What is left of a string without up to k of its characters; an array."""
    less = lambda v: F.when(
        F.length(v) > 0,
        F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))),
    ).otherwise(F.array().cast("array<string>"))
    last = F.array(F.col(value))
    out = [last]
    for _ in range(k):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        out.append(last)
    return F.concat(*out)


def wildcard_pairs(df: DataFrame, transpositions: bool = False) -> DataFrame:
    """Exact join at (Damerau-)Levenshtein distance 1 by the wildcard neighbourhood."""
    check = M.damerau_levenshtein_distance_lte1 if transpositions else M.levenshtein_distance_lte1
    found = block_pairs(df, check, blocks=lambda v: K.levenshtein_1d_keys(v, transpositions, skip_doubled=False))
    both = _with_values(found, df)
    return both.select("id_a", "id_b", F.levenshtein("value_a", "value_b").alias("score"))


def half_pairs(df: DataFrame, transpositions: bool = False) -> DataFrame:
    """Exact join at (Damerau-)Levenshtein distance 1 by halves."""
    check = M.damerau_levenshtein_distance_lte1 if transpositions else M.levenshtein_distance_lte1
    return block_pairs(df, check, blocks=lambda v: K.levenshtein_1d_blocks(v, transpositions))


# -- metric spaces


def pivot_pairs(df: DataFrame, distance: Callable[[Column, Column], Column], radius: float, pivots: int = 4) -> DataFrame:
    """Exact join at ``distance`` <= ``radius`` for a true metric, by distances to pivots.

    Rows are dealt by their distance to the first pivot, in rings as wide as the radius; alike rows
    are in the same or in neighbouring rings, and no pivot may tell their distances apart by more
    than the radius.
    """
    chosen = [r["value"] for r in df.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(pivots).collect()]
    literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    far = F.array(*(distance(F.col("value"), literal(p)).cast("double") for p in chosen)) if chosen else F.array(F.lit(0.0))
    ring = F.floor(F.get("far", F.lit(0)) / radius) if radius else F.get("far", F.lit(0))
    rows = materialise(df.select("id", "value", far.alias("far")).withColumn("ring", ring), "rings")
    a = rows.select(F.col("id").alias("id_a"), F.col("value").alias("value_a"), F.col("far").alias("far_a"),
                    F.explode(F.array("ring") if not radius else F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
    b = rows.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"), F.col("far").alias("far_b"), "ring")
    near = ~F.exists(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x - y)), lambda d: d > radius + 1e-9)
    both = a.join(b, "ring").filter((F.col("id_a") < F.col("id_b")) & near)
    return (
        both.withColumn("score", distance(F.col("value_a"), F.col("value_b"))).filter(F.col("score") <= radius).select("id_a", "id_b", "score")
    )


def nn_descent(
    df: DataFrame,
    distance: Callable[[Column, Column], Column],
    k: int | None = None,
    rounds: int = 10,
    rho: float = 1.0,
    delta: float = 0.001,
    seed: int = 0,
    pool: int | None = None,
) -> DataFrame:
    """Approximate k nearest neighbours (id_a, id_b, score): neighbours of neighbours, until few change.

    ``rho`` is the share of new edges that each round joins. The rounds hold the ``pool`` nearest of each
    id (2 k + 4 unless given), as lists of k alone settle too early. Each round is written to the shared folder.
    """
    import math

    from pyspark.sql import Window as W

    n = df.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], "id_a long, id_b long, score double")
    wanted = max(1, min(k or int(math.log2(n)), n - 1))
    k = max(wanted, min(pool or 2 * wanted + 4, n - 1))
    order = ranked(df.select("id", F.xxhash64("id", F.lit(seed)).alias("h")), "h", "id").select("id", "pos")
    start = order.select(F.col("id").alias("id_a"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + k)).alias("p"))
    start = start.select("id_a", (F.col("p") % n).alias("pos")).join(order.withColumnRenamed("id", "id_b"), "pos")
    best = W.partitionBy("id_a").orderBy("score", "id_b")

    def top(pairs: DataFrame, old: DataFrame | None) -> DataFrame:
        both = _with_values(pairs, df).select(
            "id_a", "id_b", distance(F.col("value_a"), F.col("value_b")).cast("double").alias("score"), F.lit(True).alias("new")
        )
        both = both if old is None else both.unionByName(old.withColumn("new", F.lit(False)))
        return materialise(both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"), "knn")

    graph = top(start.select("id_a", "id_b").filter("id_a <> id_b").distinct(), None)
    for _ in range(rounds):
        fresh = graph.filter("new")
        if rho < 1:
            fresh = fresh.filter(F.rand(seed) < rho)
        ends = lambda g: g.select("id_a", "id_b").union(g.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
        x = ends(fresh).select(F.col("id_a").alias("via"), F.col("id_b").alias("x"))
        y = ends(graph).select(F.col("id_a").alias("via"), F.col("id_b").alias("y"))
        step = x.join(y, "via").filter("x <> y").select("x", "y")
        cand = step.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")).union(step.select(F.col("y").alias("id_a"), F.col("x").alias("id_b")))
        cand = cand.distinct().join(graph.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
        graph = top(cand, graph.select("id_a", "id_b", "score"))
        if graph.filter("new").count() <= delta * n * k:
            break
    nearest = graph.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= wanted)
    return nearest.select("id_a", "id_b", "score")


# -- vectors in long form (id, term, weight)


def cosine_pairs(vectors: DataFrame, threshold: float | None = None) -> DataFrame:
    """(id_a, id_b, score) of sparse vectors that share a term.

    Of equal vectors one is compared, and its pairs hold for all of them.
    """
    from pyspark.sql import Window as W

    square = F.sum(F.col("weight") * F.col("weight"))
    each = vectors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("vector"), square.alias("q"))
    each = materialise(each.withColumn("rep", F.min("id").over(W.partitionBy("vector"))), "vectors")
    reps = each.filter("id = rep").select("id", "q", F.inline("vector"))
    a = reps.select("term", F.col("id").alias("rep_a"), F.col("weight").alias("w_a"), F.col("q").alias("q_a"))
    b = reps.select("term", F.col("id").alias("rep_b"), F.col("weight").alias("w_b"), F.col("q").alias("q_b"))
    both = a.join(b, "term").filter("rep_a <= rep_b")
    both = both.groupBy("rep_a", "rep_b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), F.first("q_a").alias("q_a"), F.first("q_b").alias("q_b"))
    both = both.withColumn("score", F.coalesce(F.try_divide("dot", F.sqrt(F.col("q_a") * F.col("q_b"))), F.lit(0.0)))
    both = both if threshold is None else both.filter(F.col("score") >= threshold)
    return _members(both.select("rep_a", "rep_b", "score"), each.select("rep", "id"))


def _members(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b, of the members (rep, id) of pairs (rep_a, rep_b, score), each pair once.

    A pair (r, r) gives the pairs within r. Few pairs may give many: they are dealt anew before they do.
    """
    x = of.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    y = of.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    dealt = pairs.join(x, "rep_a").repartition(int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "rep_b")
    both = dealt.join(y, "rep_b").filter((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "score")


def cosine_nearest(vectors: DataFrame) -> DataFrame:
    """(id, nearest, score): exact nearest neighbour by cosine; ties go to the smallest id."""
    pairs = cosine_pairs(vectors)
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "score").union(
        pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "score")
    )
    best = both.groupBy("id").agg(F.max(F.struct("score", (-F.col("other")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("nearest"), F.col("b.score").alias("score"))


def sqrt_index_pairs(df: DataFrame, similarity: Callable[[Column, Column], Column], seed: int = 0, each: int = 3) -> DataFrame:
    """Candidates by ~sqrt(n) random leaders: token arrays that have one of their ``each`` most similar leaders in common.

    Arrays meet the leaders that they share a token with, by an inverted index of the leaders' tokens. Those
    that share none with any leader are candidates with each other by their tokens.
    """
    import math

    from pyspark.sql import Window as W

    n = df.count()
    leaders = df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(1, math.isqrt(n)))
    leaders = materialise(leaders.select(F.col("id").alias("leader"), F.col("value").alias("lead")), "leaders")
    tokens = df.select("id", F.explode(F.array_distinct("value")).alias("key"))
    index = leaders.select("leader", F.explode(F.array_distinct("lead")).alias("key"))
    met = tokens.join(index, "key").select("id", "leader").distinct()
    scored = met.join(df, "id").join(leaders, "leader").select("id", "leader", similarity(F.col("value"), F.col("lead")).alias("s"))
    best = W.partitionBy("id").orderBy(F.desc("s"), F.desc("leader"))
    near = scored.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= each)
    near = materialise(near.select("id", F.col("leader").alias("key")), "near")
    alone = tokens.join(near.select("id").distinct(), "id", "left_anti")
    return pairs_from_buckets(near).union(pairs_from_buckets(alone)).distinct()
