"""One query per operator over the driver's tables, with the SQL that gives the same rows.

Sums and means of doubles are rounded on both sides; scores of single rows are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import keys as K, metrics as M, sketch, text as T
from kindred.operators import clusters as C, evaluate, graph, join, pairs as P, words
from kindred.sources import tables
from kindred.streaming import online

from .planner import similarity_pairs
from .work import materialise


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part names; the name is its own id."""
    return _read(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("value")).distinct()


def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names with their smallest part key as id."""
    return _read(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.min("p_partkey").alias("id"))


def part_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return part_names(spark, d).select("id", F.array_distinct(T.ngrams(2, "value")).alias("value"))


def benchmark_words(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split(F.lower("text"), " ").alias("value"))


def user_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, term, weight): how often a user has an event type."""
    e = _read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("term")).agg(F.count("*").cast("double").alias("weight"))


def _named(df: DataFrame) -> DataFrame:
    return df.select("id_a", "id_b", "score")


def _sized(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", "id")


def metrics_of_names(spark, d):
    n = part_names(spark, d).select(F.col("value").alias("a"))
    both = n.join(n.select(F.col("a").alias("b")), F.substring("a", 1, 1) == F.substring("b", 1, 1)).filter("a < b")
    x, y = M.chars("a"), M.chars("b")
    return both.select(
        "a", "b",
        M.jaccard_similarity(x, y).alias("jaccard"), M.dice_coefficient(x, y).alias("dice"),
        M.overlap_coefficient(x, y).alias("overlap"), M.binary_cosine_similarity(x, y).alias("binary_cosine"),
        M.intersection_size(x, y).cast("long").alias("shared"), M.levenshtein_distance("a", "b").cast("long").alias("lev"),
        M.limited_levenshtein_distance(3, "a", "b").cast("long").alias("lev3"), M.levenshtein_distance_lte1("a", "b").alias("lte1"),
        M.damerau_levenshtein_distance_lte1("a", "b").alias("damerau_lte1"),
    )


def sparse_metrics(spark, d):
    """Each user's event counts beside the next user's, as maps."""
    v = user_vectors(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    a, b = v.select("id", F.col("v").alias("a")), v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b"))
    return a.join(b, "id").select(
        "id", M.sparse_cosine_similarity("a", "b").alias("cosine"), M.weighted_jaccard_similarity("a", "b").alias("jaccard"),
        M.sparse_dot_product("a", "b").alias("dot"), M.sparse_norm("a").alias("norm"),
        F.coalesce(M.sparse_normalize("a")["click"], F.lit(0.0)).alias("click"),
    )


def keys_of_names(spark, d):
    return part_names(spark, d).select(
        "value", K.omission_key("value").alias("omission"), K.skeleton_key("value").alias("skeleton"),
        T.fingerprint("value").alias("fingerprint"), T.squeeze("value").alias("squeezed"),
        T.ngrams_fingerprint(2, "value").alias("ngrams_fingerprint"), T.join_ngrams(T.ngrams(3, "value")).alias("joined"),
        F.size(T.ngrams(3, "value")).cast("long").alias("n_trigrams"), F.size(F.array_distinct(K.levenshtein_1d_keys("value", flag="!"))).cast("long").alias("n_keys"),
        F.size(K.levenshtein_1d_blocks("value")).cast("long").alias("n_blocks"), F.size(K.levenshtein_2d_blocks("value")).cast("long").alias("n_blocks_2d"),
    )


def phonetics_of_names(spark, d):
    return part_names(spark, d).select("value", K.cologne("value").alias("cologne"), K.rusalka("value").alias("rusalka"))


def ngram_keys_of_names(spark, d):
    return part_names(spark, d).select("value", F.explode(K.ngram_keys(2, "value")).alias("key"))


def sketches_of_benchmark(spark, d):
    b = benchmark_words(spark, d)
    return b.select(
        "id", sketch.minhash("value", 64).alias("m"), sketch.lsb_minhash("value", 2).alias("l"), sketch.simhash("value").alias("s"),
        sketch.super_minhash("value", 64).alias("u"),
    )


def greedy(spark, d, mode):
    df = numbered_names(spark, d)
    return C.clusters_from_pairs(P.segment_pairs(df, 2), mode=mode)


def collisions(spark, d, key, turned=False):
    """Collisions of part names; ``turned`` adds each name with its words in reverse, under the id -1 - id,
    where that is no name itself.
    """
    df = numbered_names(spark, d)
    if turned:
        words = F.array_join(F.reverse(F.split("value", " ")), " ").alias("value")
        df = df.unionByName(df.select((-1 - F.col("id")).alias("id"), words).join(df.select("value"), "value", "left_anti"))
    found = C.key_collision(df, key=key)
    first = found.groupBy("cluster_id").agg(F.min("id").alias("first"))
    return found.join(first, "cluster_id").select(F.col("first").alias("cluster_id"), "id")


def bipartite(spark, d):
    """Brands and types of parts, weighted by how many parts have both."""
    e = _read(spark, d, "part").groupBy(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    nodes = e.select(F.col("src").alias("id"), F.lit("brand").alias("part")).union(e.select("dst", F.lit("type"))).distinct()
    return nodes, e


def suppliers(spark, d):
    e = _read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    e = materialise(e, "edges")
    nodes = e.select(F.col("src").alias("id"), F.lit("supplier").alias("part")).union(e.select("dst", F.lit("part"))).distinct()
    return materialise(nodes, "nodes"), e


def evaluation(spark, d):
    docs = _read(spark, d, "documents")
    got = evaluate.best_matching_macro_average(
        docs.select(F.col("doc_id").alias("item"), F.col("lang").alias("cluster")),
        docs.select(F.col("doc_id").alias("item"), F.col("source").alias("cluster")),
    )
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


def typed_tokens(spark, d):
    c = _read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words.tokenize("text")).alias("at", "t"))
    return c.select("conv_id", "turn", "at", F.col("t.type").alias("type"), F.col("t.value").alias("value"))


def thresholded(spark, d):
    nodes, e = bipartite(spark, d)
    projected = graph.monopartite_projection(nodes, e, "brand", "cosine")
    own = nodes.filter("part = 'brand'")
    edges = projected.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return graph.floatsam_sparsification(own, edges, start=0.9, step=0.01, max_drifter_size=2)


def urls(spark, d):
    return _read(spark, d, "pages").select(F.col("url").alias("value")).distinct()


def blocks_of_urls(spark, d):
    """Blocks of one and two edits, with and without swaps, by content."""
    kinds = {
        "1d": K.levenshtein_1d_blocks("value", flag="!"), "1d swaps": K.damerau_levenshtein_1d_blocks("value", flag="!"),
        "2d": K.levenshtein_2d_blocks("value", flags=("<", "=", ">")), "2d swaps": K.levenshtein_2d_blocks("value", True, ("<", "=", ">")),
    }
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("kind", "blocks")
    return urls(spark, d).select("value", each).select("value", "kind", F.explode("blocks").alias("block"))


def keys_of_urls(spark, d):
    """The wildcard neighbourhood by content, with and without swaps."""
    plain, swaps = K.levenshtein_1d_keys("value", flag="!"), K.damerau_levenshtein_1d_keys("value", flag="!")
    each = F.explode(F.array(F.struct(F.lit(False).alias("swaps"), plain.alias("keys")), F.struct(F.lit(True).alias("swaps"), swaps.alias("keys")))).alias("k")
    return urls(spark, d).select("value", each).select("value", "k.swaps", F.explode(F.array_distinct("k.keys")).alias("key"))


def set_projections(spark, d):
    return graph.monopartite_projections(*suppliers(spark, d), "supplier", ["dice", "overlap", "binary_cosine"], 0.05)


def bands(spark, d):
    """Bands for thresholds, what they find, and at which similarity, for signatures of 64 entries."""
    rows = [(t / 10, sketch.guess_bands(64, t / 10)) for t in range(2, 10)]
    rows = [(t, b, sketch.similarity_threshold(64, b), sketch.match_probability(64, b, t)) for t, b in rows]
    return spark.createDataFrame(rows, "threshold double, bands long, at double, found double").select("threshold", "bands", F.round("at", 9).alias("at"), F.round("found", 9).alias("found"))


def simhash_of_benchmark(spark, d):
    """Simhash signatures, their set bits and their likeness to the next item's."""
    b = benchmark_words(spark, d).select("id", sketch.simhash("value").alias("s"))
    both = b.join(b.select((F.col("id") - 1).alias("id"), F.col("s").alias("t")), "id")
    return both.select("id", *(F.lower(F.lpad(F.hex(F.col("s")[k]), 16, "0")).alias(f"s{k}") for k in (0, 1)),
                       M.simhash_distance("s", "t").alias("distance"), M.popcount(F.col("s")[0]).cast("long").alias("bits"))


def bucket_clusters(spark, d):
    """Components of URLs within two edits that share host and first folder; what follows these is compared."""
    key = F.substring_index("value", "/", 4)
    rest = F.substring("value", F.length(key) + 1, F.length("value"))
    df = urls(spark, d).select(F.col("value").alias("id"), rest.alias("value"), key.alias("key"))
    return _sized(C.clusters_from_buckets(df.select("key", "id"), df, edits=2))


def labels_of_clusters(spark, d):
    clusters = evaluate.labels_to_clusters(_read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("cluster")))
    return evaluate.clusters_to_labels(clusters).select("item", F.col("cluster").cast("long").alias("cluster"))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


QUERIES = {
    "jaccard_pairs": lambda s, d: _named(similarity_pairs(part_bigrams(s, d), "jaccard", 0.5)),
    "dice_pairs": lambda s, d: _named(similarity_pairs(part_bigrams(s, d), "dice", 0.6)),
    "binary_cosine_pairs": lambda s, d: _named(similarity_pairs(part_bigrams(s, d), "binary_cosine", 0.6)),
    "overlap_pairs": lambda s, d: _named(similarity_pairs(part_bigrams(s, d), "overlap", 0.7)),
    "intersection_index": lambda s, d: _named(P.count_pairs(part_bigrams(s, d), "jaccard", 0.5)),
    "pairwise_jaccard": lambda s, d: _named(P.naive_pairs(part_bigrams(s, d), "jaccard", 0.5)),
    "levenshtein_pairs_1": lambda s, d: similarity_pairs(part_names(s, d), "levenshtein", 1).select("id_a", "id_b", *_long("score")),
    "levenshtein_pairs_2": lambda s, d: similarity_pairs(part_names(s, d), "levenshtein", 2).select("id_a", "id_b", *_long("score")),
    "supplier_name_pairs": lambda s, d: P.segment_pairs(_read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value")), 1).select("id_a", "id_b", *_long("score")),
    "half_blocks_pairs": lambda s, d: P.half_pairs(part_names(s, d)),
    "damerau_pairs": lambda s, d: P.wildcard_pairs(part_names(s, d), True).select("id_a", "id_b"),
    "blocking_first_letter": lambda s, d: P.block_pairs(part_names(s, d), lambda a, b: F.levenshtein(a, b) <= 3, lambda v: F.substring(v, 1, 1)),
    "sorted_neighborhood": lambda s, d: P.sorted_neighborhood_pairs(part_names(s, d), lambda a, b: F.levenshtein(a, b) <= 4, [lambda v: v, F.reverse], 5),
    "adaptive_neighborhood": lambda s, d: P.adaptive_neighborhood_pairs(part_names(s, d), lambda a, b: F.substring(a, 1, 3) == F.substring(b, 1, 3), lambda x, y: x[:3] == y[:3], [lambda v: v], 2),
    "pivot_join": lambda s, d: P.pivot_pairs(part_names(s, d), F.levenshtein, 2).select("id_a", "id_b", *_long("score")),
    "minhash_pairs": lambda s, d: _named(P.minhash_pairs(part_bigrams(s, d), 0.5, 128, 64)),
    "simhash_pairs": lambda s, d: _named(P.simhash_pairs(part_bigrams(s, d), 0.7, 128, 32)),
    "nn_descent": lambda s, d: P.nn_descent(numbered_names(s, d), F.levenshtein, 4),
    "cosine_nearest": lambda s, d: P.cosine_nearest(benchmark_words(s, d).select("id", F.explode("value").alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))),
    "user_cosine_pairs": lambda s, d: _named(P.cosine_pairs(user_vectors(s, d), 0.99)),
    "sqrt_index": lambda s, d: P.sqrt_index_pairs(part_bigrams(s, d), M.jaccard_similarity),
    "metrics_of_names": metrics_of_names,
    "sparse_metrics": sparse_metrics,
    "keys_of_names": keys_of_names,
    "phonetics_of_names": phonetics_of_names,
    "ngram_keys": ngram_keys_of_names,
    "sketches": sketches_of_benchmark,
    "key_collision_first_word": lambda s, d: collisions(s, d, lambda v: F.split(v, " ")[0]),
    "key_collision_fingerprint": lambda s, d: collisions(s, d, T.fingerprint, turned=True),
    "key_collision_merged": lambda s, d: _sized(C.key_collision(numbered_names(s, d), keys=lambda v: F.split(v, " "), merge=True)),
    "components_levenshtein_2": lambda s, d: _sized(C.component_clusters(P.segment_pairs(numbered_names(s, d), 2))),
    "fuzzy_clusters": lambda s, d: greedy(s, d, "fuzzy_clusters"),
    "leader_clusters": lambda s, d: greedy(s, d, "leader"),
    "vp_tree": lambda s, d: C.vp_tree(numbered_names(s, d), F.levenshtein, 2),
    "laesa": lambda s, d: C.laesa(numbered_names(s, d), F.levenshtein, 2),
    "quickjoin": lambda s, d: C.quickjoin(numbered_names(s, d), F.levenshtein, 2),
    "hashjoin_key": lambda s, d: join.hashjoin(
        _read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("value")),
        _read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value")), key=F.lower).select("left_id", *_long("right_id")),
    "hashjoin_keys": lambda s, d: join.hashjoin(part_names(s, d), part_names(s, d), keys=lambda v: F.split(v, " ")).select("left_id", "right_id"),
    "projection_count": lambda s, d: graph.monopartite_projection(*suppliers(s, d), "supplier"),
    "projection_jaccard": lambda s, d: graph.monopartite_projection(*suppliers(s, d), "supplier", "jaccard", 0.1),
    "projection_cosine": lambda s, d: graph.monopartite_projection(*bipartite(s, d), "brand", "cosine"),
    "projection_sets": set_projections,
    "blocks_of_urls": blocks_of_urls,
    "keys_of_urls": keys_of_urls,
    "bands": bands,
    "simhash_of_benchmark": simhash_of_benchmark,
    "clusters_from_buckets": bucket_clusters,
    "clusters_to_labels": labels_of_clusters,
    "zig_zag": lambda s, d: urls(s, d).select("value", *(k.alias(f"key{i}") for i, k in enumerate(K.zig_zag("value")))),
    "floatsam": thresholded,
    "component_sizes": lambda s, d: (lambda n, e: graph.component_sizes(n, e).select("size"))(*suppliers(s, d)),
    "best_matching": evaluation,
    "labels_to_clusters": lambda s, d: evaluate.labels_to_clusters(_read(s, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("cluster"))).select(F.col("cluster").cast("long").alias("cluster"), F.size("items").cast("long").alias("n"), F.array_min("items").alias("first")),
    "split_column": lambda s, d: tables.split_column(_read(s, d, "part").select("p_partkey", "p_name"), "p_name", " "),
    "transform_column": lambda s, d: tables.transform_column(_read(s, d, "nation").select("n_name"), "n_name", ["strip", "lower"], "concat(value, '!')", "made", True),
    "word_tokens": typed_tokens,
    "key_counts": lambda s, d: online.key_counts(_read(s, d, "events"), F.upper, "event_type"),
    "online_mean": lambda s, d: _read(s, d, "events").groupBy("event_type").agg(*online.mean_state("value")).select("event_type", F.round(F.col("total") / F.col("n"), 6).alias("mean")),
}

_NAMES = "n AS (SELECT DISTINCT p_name AS s FROM part)"
_IDS = "n AS (SELECT p_name AS s, min(p_partkey) AS id FROM part GROUP BY 1)"
_GRAMS = _NAMES + ", g AS (SELECT s, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS v FROM n)"
_SET = {
    "jaccard": "m / (x + y - m)", "dice": "2 * m / (x + y)", "overlap": "m / least(x, y)", "binary_cosine": "m / sqrt(x * y)",
}


def _set_sql(metric: str, threshold: float) -> str:
    return f"""WITH {_GRAMS}, p AS (SELECT a.s AS id_a, b.s AS id_b, len(list_intersect(a.v, b.v)) AS m, len(a.v) AS x, len(b.v) AS y
        FROM g a JOIN g b ON a.s < b.s)
        SELECT id_a, id_b, {_SET[metric]} AS score FROM p WHERE {_SET[metric]} >= {threshold}"""


def _edit_sql(k: int, columns: str = "a.s AS id_a, b.s AS id_b, levenshtein(a.s, b.s) AS score") -> str:
    return f"WITH {_NAMES} SELECT {columns} FROM n a JOIN n b ON a.s < b.s WHERE levenshtein(a.s, b.s) <= {k}"


_COMPONENTS = """WITH RECURSIVE n AS (SELECT p_name AS s, min(p_partkey) AS id FROM part GROUP BY 1),
    e AS (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON a.id <> b.id AND {link}),
    r(id, c) AS (SELECT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
    SELECT min(c) AS cluster_id, id FROM r GROUP BY id"""

_SUPPLIERS = """e AS (SELECT DISTINCT 's' || l_suppkey AS s, l_partkey AS p FROM lineitem),
    k AS (SELECT s, count(*) AS n FROM e GROUP BY 1),
    m AS (SELECT a.s AS a, b.s AS b, count(*) AS m FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2)"""

_BIPARTITE = """e AS (SELECT p_brand AS s, p_type AS t, count(*)::DOUBLE AS w FROM part GROUP BY 1, 2)"""

_ALPHA = "regexp_replace(upper(s), '[^A-Z]', '', 'g')"


def _ordered(expr: str) -> str:
    """Distinct characters of a string by first appearance."""
    return f"list_filter(string_split({expr}, ''), lambda c, i: c <> '' AND list_position(string_split({expr}, ''), c) = i)"


_KEYS = f"""WITH {_NAMES}, l AS (SELECT s, {_ordered(_ALPHA)} AS k, string_split(s, '') AS ch FROM n)
    SELECT s AS value,
      array_to_string(list_concat(list_filter(string_split('{K.OMISSION_ORDER}', ''), lambda c: list_contains(k, c)),
        list_filter(k, lambda c: c IN ('A','E','I','O','U'))), '') AS omission,
      array_to_string(list_concat(k[1:1], list_concat(list_filter(k[2:], lambda c: c NOT IN ('A','E','I','O','U')),
        list_filter(k[2:], lambda c: c IN ('A','E','I','O','U')))), '') AS skeleton,
      array_to_string(list_sort(list_distinct(string_split(s, ' '))), ' ') AS fingerprint,
      array_to_string(list_filter(ch, lambda c, i: i = 1 OR c <> ch[i - 1]), '') AS squeezed,
      array_to_string(list_sort(list_distinct(list_transform(range(1, length(replace(s, ' ', ''))), lambda i: substr(replace(s, ' ', ''), i, 2)))), '') AS ngrams_fingerprint,
      s AS joined, length(s) - 2 AS n_trigrams,
      2 + 2 * length(s) - len(list_filter(ch, lambda c, i: i > 1 AND c = ch[i - 1])) AS n_keys,
      CASE WHEN length(s) % 2 = 0 THEN 2 ELSE 4 END AS n_blocks,
      CASE WHEN length(s) % 3 = 0 THEN 3 ELSE 7 END AS n_blocks_2d
    FROM l"""

_CHARS = "list_distinct(string_split({}, ''))"
_METRICS = f"""WITH {_NAMES}, p AS (SELECT a.s AS a, b.s AS b, {_CHARS.format("a.s")} AS u, {_CHARS.format("b.s")} AS v
      FROM n a JOIN n b ON a.s < b.s AND a.s[1] = b.s[1]),
    q AS (SELECT *, len(list_intersect(u, v)) AS m, len(u) AS x, len(v) AS y, levenshtein(a, b) AS l FROM p)
    SELECT a, b, m / (x + y - m) AS jaccard, 2 * m / (x + y) AS dice, m / least(x, y) AS overlap, m / sqrt(x * y) AS binary_cosine,
      m AS shared, l AS lev, CASE WHEN l > 3 THEN 4 ELSE l END AS lev3, l <= 1 AS lte1, damerau_levenshtein(a, b) <= 1 AS damerau_lte1 FROM q"""

_SPARSE = """WITH v AS (SELECT user_id AS id, event_type AS t, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2),
    u AS (SELECT id, sum(w * w) AS q FROM v GROUP BY 1),
    k AS (SELECT a.id, t.t FROM u a JOIN u b ON b.id = a.id + 1, (SELECT DISTINCT event_type AS t FROM events) t),
    z AS (SELECT k.id, sum(coalesce(a.w, 0) * coalesce(b.w, 0)) AS dot, sum(least(coalesce(a.w, 0), coalesce(b.w, 0))) AS lo,
        sum(greatest(coalesce(a.w, 0), coalesce(b.w, 0))) AS hi, max(CASE WHEN k.t = 'click' THEN coalesce(a.w, 0) END) AS c
      FROM k LEFT JOIN v a ON a.id = k.id AND a.t = k.t LEFT JOIN v b ON b.id = k.id + 1 AND b.t = k.t GROUP BY 1)
    SELECT z.id, dot / sqrt(x.q * y.q) AS cosine, lo / hi AS jaccard, dot, sqrt(x.q) AS norm, c / sqrt(x.q) AS click
    FROM z JOIN u x ON x.id = z.id JOIN u y ON y.id = z.id + 1"""

_COSINE = """WITH v AS ({v}), q AS (SELECT id, sum(w * w) AS q FROM v GROUP BY 1),
    p AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
    c AS (SELECT id_a, id_b, dot / sqrt(x.q * y.q) AS score FROM p JOIN q x ON x.id = id_a JOIN q y ON y.id = id_b) """
_BENCH = "SELECT item_id AS id, t, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS t FROM benchmark) GROUP BY 1, 2"
_USERS = "SELECT user_id AS id, event_type AS t, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2"

#: Greedy choices step by step: {members} of the next node in {order}, which is in no earlier group's {taken}.
_GREEDY = """WITH RECURSIVE n AS (SELECT p_name AS s, min(p_partkey) AS id FROM part GROUP BY 1),
    p AS (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON a.id < b.id AND levenshtein(a.s, b.s) <= 2),
    e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
    q AS (SELECT x AS id, x, y, 0 AS z FROM p UNION ALL SELECT y, x, y, 1 FROM p),
    o AS (SELECT id, min((x, y, z)) AS first FROM q GROUP BY id),
    g AS (SELECT row_number() OVER (ORDER BY {order}) AS r, id, (SELECT list(y) FROM e WHERE x = id) AS near FROM o),
    t(r, id, members, taken) AS (SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
      SELECT g.r, g.id, CASE WHEN list_contains(t.taken, g.id) THEN [] ELSE {members} END,
        CASE WHEN list_contains(t.taken, g.id) THEN t.taken ELSE list_concat(t.taken, list_concat([g.id], {members})) END
      FROM t JOIN g ON g.r = t.r + 1)
    SELECT id AS cluster_id, unnest(list_concat([id], members)) AS id FROM t WHERE len(members) > 0"""
_BALL = "g.near"
_LEAD = "list_filter(g.near, lambda y: y > g.id AND NOT list_contains(t.taken, y))"

# vowels and letters by their neighbours; runs are joined behind the first code, zeros go
_PHONETICS = f"""WITH {_NAMES}, l AS (SELECT s, string_split(regexp_replace(replace(upper(s), 'PH', 'F'), '[^A-Z]', '', 'g'), '') AS c FROM n),
    k AS (SELECT s, starts_with(ltrim(array_to_string(c, ''), 'H'), 'X') AS wide, array_to_string(list_transform(c, lambda x, i: CASE
        WHEN x IN ('A','E','I','O','U','J','Y') THEN '0' WHEN x = 'H' THEN '' WHEN x IN ('B','P') THEN '1'
        WHEN x IN ('D','T') THEN CASE WHEN c[i + 1] IN ('C','S','Z') THEN '8' ELSE '2' END
        WHEN x IN ('F','V','W') THEN '3' WHEN x IN ('G','K','Q') THEN '4' WHEN x = 'L' THEN '5' WHEN x IN ('M','N') THEN '6' WHEN x = 'R' THEN '7'
        WHEN x = 'X' THEN CASE WHEN i > 1 AND c[i - 1] IN ('C','K','Q') THEN '8' ELSE '48' END
        WHEN x = 'C' AND i = 1 THEN CASE WHEN c[2] IN ('A','H','K','L','O','Q','R','U','X') THEN '4' ELSE '8' END
        WHEN x = 'C' THEN CASE WHEN c[i - 1] NOT IN ('S','Z') AND c[i + 1] IN ('A','H','K','O','Q','U','X') THEN '4' ELSE '8' END
        ELSE '8' END), '') AS code FROM l),
    f AS (SELECT s, CASE WHEN wide THEN 2 ELSE 1 END AS m, code FROM k),
    r AS (SELECT s, substr(code, 1, m) AS first, string_split(substr(code, m + 1), '') AS rest FROM f),
    a AS (SELECT s, regexp_replace(lower(s), '[^a-z]', '', 'g') AS w FROM n),
    b AS (SELECT s, w, regexp_replace(regexp_replace(regexp_replace(replace(w, 'cz', 'ts'), 'i[jy]$', ''), '[fvw]|ph', 'f', 'g'), '^[jy]?e', 'J') AS v FROM a),
    c2 AS (SELECT s, w, replace(regexp_replace(regexp_replace(v, '[dt]?[cs]h|tz', 'ʃ', 'g'), '[dt]?(zh|j)', 'ʒ', 'g'), 'ks', 'x') AS v FROM b),
    d AS (SELECT s, w, replace(regexp_replace(replace(regexp_replace(v, '^y([aeiou])', 'j\\1'), 'iou', 'j'), '[cg]', 'k', 'g'), 'h', '') AS v FROM c2),
    h AS (SELECT s, w, string_split(v, '') AS v FROM d),
    j AS (SELECT s, w, lower(array_to_string(list_filter(v, lambda x, i: i = 1 OR x <> v[i - 1]), '')) AS v FROM h)
    SELECT s AS value, first || replace(array_to_string(list_filter(rest, lambda x, i: i = 1 OR x <> rest[i - 1]), ''), '0', '') AS cologne,
      CASE WHEN length(w) < 2 THEN w ELSE regexp_replace(v[1], '[aeiouy]', 'a') || regexp_replace(substr(v, 2), '[aeiouy]', '', 'g') END AS rusalka
    FROM r JOIN j USING (s)"""

_FLOATSAM = f"""WITH RECURSIVE {_BIPARTITE}, q AS (SELECT s, sum(w * w) AS q FROM e GROUP BY 1),
    p AS (SELECT a.s AS a, b.s AS b, sum(a.w * b.w) AS dot FROM e a JOIN e b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2),
    x AS (SELECT a, b, dot / sqrt(m.q * o.q) AS weight FROM p JOIN q m ON m.s = a JOIN q o ON o.s = b),
    y AS (SELECT a, b, weight FROM x UNION ALL SELECT b, a, weight FROM x),
    ts(k, t) AS (SELECT 0, 0.9::DOUBLE UNION ALL SELECT k + 1, t + 0.01::DOUBLE FROM ts WHERE t <= (SELECT max(weight) FROM x)),
    r(k, id, c) AS (SELECT ts.k, q.s, q.s FROM ts, q UNION SELECT r.k, y.b, r.c FROM r JOIN ts ON ts.k = r.k JOIN y ON y.a = r.id AND y.weight >= ts.t),
    z AS (SELECT k, c, count(*) AS n FROM (SELECT k, id, min(c) AS c FROM r GROUP BY 1, 2) GROUP BY 1, 2),
    u AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS i, n FROM z),
    bad AS (SELECT min(k) AS k FROM (SELECT k FROM u WHERE i = 2 AND n >= 2 UNION ALL SELECT k FROM ts WHERE t > (SELECT max(weight) FROM x)) WHERE k > 0)
    SELECT a AS src, b AS dst, weight FROM x WHERE weight >= (SELECT t FROM ts JOIN bad ON ts.k = bad.k - 1)"""

_URLS = "u AS (SELECT DISTINCT url AS s, length(url) AS n FROM pages)"
_BLOCKS = f"""WITH {_URLS}, h AS (SELECT *, n // 2 AS h, n // 3 AS t, n % 3 AS m FROM u),
    k AS (SELECT s, unnest(['1d', '1d swaps', '2d', '2d swaps']) AS kind, n, h, t, m FROM h),
    b AS (SELECT s, kind, unnest(CASE
      WHEN kind LIKE '1d%' THEN list_concat(['!' || s[:h], s[h + 1:] || '!'], CASE WHEN n % 2 = 1 THEN ['!' || s[:h + 1], s[h + 2:] || '!']
        WHEN kind = '1d swaps' THEN ['!' || s[:h - 1] || s[h + 1], s[h] || s[h + 2:] || '!'] ELSE [] END)
      WHEN m = 0 THEN list_concat(['<' || s[:t], '=' || s[t + 1:2 * t], '>' || s[2 * t + 1:]], CASE WHEN kind = '2d' THEN [] ELSE
        ['<' || s[:t - 1] || s[t + 1], '=' || s[t] || s[t + 2:2 * t], '>' || s[2 * t] || s[2 * t + 2:]] END)
      WHEN m = 1 THEN ['<' || s[:t + 1], '=' || s[t + 2:2 * t + 1], '>' || s[2 * t + 2:], '<' || s[:t], '=' || s[t + 1:2 * t + 1], '=' || s[t + 1:2 * t], '>' || s[2 * t + 1:]]
      ELSE ['<' || s[:t + 1], '=' || s[t + 2:2 * t + 2], '>' || s[2 * t + 3:], '<' || s[:t], '=' || s[t + 1:2 * t + 1], '>' || s[2 * t + 2:], '=' || s[t + 2:2 * t + 1]]
      END) AS block FROM k)
    SELECT s AS value, kind, block FROM b"""
_URL_KEYS = f"""WITH {_URLS}, i AS (SELECT s, unnest(range(1, n + 1)) AS i FROM u),
    k AS (SELECT s, unnest([false, true]) AS swaps, unnest([s, s]) AS key FROM u UNION SELECT s, unnest([false, true]), s || '!' FROM u
      UNION SELECT s, unnest([false, true]), s[:i - 1] || '!' || s[i + 1:] FROM i
      UNION SELECT s, unnest([false, true]), s[:i - 1] || '!' || s[i:] FROM i WHERE i = 1 OR s[i - 1] <> s[i]
      UNION SELECT s, true, s[:i - 2] || s[i] || s[i - 1] || s[i + 1:] FROM i WHERE i > 1 AND s[i - 1] <> s[i])
    SELECT s AS value, swaps, key FROM k"""
_SIMHASH = """WITH w AS (SELECT item_id AS id, md5(unnest(string_split(lower(text), ' '))) AS d FROM benchmark),
    v AS (SELECT id, j, sum(CASE WHEN ((instr('0123456789abcdef', d[j // 4 + 1]) - 1) >> (3 - j % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS b
      FROM w, range(128) AS r(j) GROUP BY 1, 2),
    h AS (SELECT id, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY j) AS bits FROM v GROUP BY id)
    SELECT a.id, {hex0} AS s0, {hex1} AS s1, hamming(a.bits, b.bits) / 128 AS distance, length(replace(a.bits[:64], '0', '')) AS bits
    FROM h a JOIN h b ON b.id = a.id + 1"""
_HEX = "array_to_string(list_transform(range({0}, {0} + 64, 4), lambda i: '0123456789abcdef'[1 + 8 * a.bits[i + 1]::INT + 4 * a.bits[i + 2]::INT + 2 * a.bits[i + 3]::INT + a.bits[i + 4]::INT]), '')"

ORACLES = {
    "jaccard_pairs": _set_sql("jaccard", 0.5),
    "dice_pairs": _set_sql("dice", 0.6),
    "binary_cosine_pairs": _set_sql("binary_cosine", 0.6),
    "overlap_pairs": _set_sql("overlap", 0.7),
    "intersection_index": _set_sql("jaccard", 0.5),
    "pairwise_jaccard": _set_sql("jaccard", 0.5),
    "levenshtein_pairs_1": _edit_sql(1),
    "levenshtein_pairs_2": _edit_sql(2),
    "supplier_name_pairs": "SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b, levenshtein(a.s_name, b.s_name) AS score FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE levenshtein(a.s_name, b.s_name) <= 1",
    "half_blocks_pairs": _edit_sql(1, "a.s AS id_a, b.s AS id_b"),
    "damerau_pairs": f"WITH {_NAMES} SELECT a.s AS id_a, b.s AS id_b FROM n a JOIN n b ON a.s < b.s WHERE damerau_levenshtein(a.s, b.s) <= 1",
    "blocking_first_letter": f"WITH {_NAMES} SELECT a.s AS id_a, b.s AS id_b FROM n a JOIN n b ON a.s < b.s AND a.s[1] = b.s[1] WHERE levenshtein(a.s, b.s) <= 3",
    "sorted_neighborhood": f"""WITH {_NAMES}, o AS (SELECT s, row_number() OVER (ORDER BY s) AS r, row_number() OVER (ORDER BY reverse(s)) AS q FROM n)
        SELECT a.s AS id_a, b.s AS id_b FROM o a JOIN o b ON a.s < b.s AND (abs(a.r - b.r) <= 4 OR abs(a.q - b.q) <= 4) WHERE levenshtein(a.s, b.s) <= 4""",
    "adaptive_neighborhood": f"WITH {_NAMES} SELECT a.s AS id_a, b.s AS id_b FROM n a JOIN n b ON a.s < b.s AND a.s[1:3] = b.s[1:3]",
    "pivot_join": _edit_sql(2),
    "minhash_pairs": _set_sql("jaccard", 0.5),
    "cosine_nearest": _COSINE.format(v=_BENCH) + """, b AS (SELECT id_a AS id, id_b AS o, score FROM c UNION ALL SELECT id_b, id_a, score FROM c)
        SELECT id, o AS nearest, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS r FROM b) WHERE r = 1""",
    "user_cosine_pairs": _COSINE.format(v=_USERS) + "SELECT * FROM c WHERE score >= 0.99",
    "metrics_of_names": _METRICS,
    "sparse_metrics": _SPARSE,
    "keys_of_names": _KEYS,
    "key_collision_first_word": f"WITH {_IDS}, k AS (SELECT *, min(id) OVER w AS c, count(*) OVER w AS m FROM n WINDOW w AS (PARTITION BY string_split(s, ' ')[1])) SELECT c AS cluster_id, id FROM k WHERE m > 1",
    "key_collision_fingerprint": f"""WITH {_IDS}, v AS (SELECT s, id FROM n UNION ALL SELECT array_to_string(list_reverse(string_split(s, ' ')), ' '), -1 - id FROM n WHERE array_to_string(list_reverse(string_split(s, ' ')), ' ') NOT IN (SELECT s FROM n)),
        k AS (SELECT *, min(id) OVER w AS c, count(*) OVER w AS m FROM v WINDOW w AS (PARTITION BY array_to_string(list_sort(list_distinct(string_split(s, ' '))), ' ')))
        SELECT c AS cluster_id, id FROM k WHERE m > 1""",
    "key_collision_merged": _COMPONENTS.format(link="len(list_intersect(string_split(a.s, ' '), string_split(b.s, ' '))) > 0"),
    "components_levenshtein_2": _COMPONENTS.format(link="levenshtein(a.s, b.s) <= 2"),
    "laesa": _COMPONENTS.format(link="levenshtein(a.s, b.s) <= 2"),
    "quickjoin": _COMPONENTS.format(link="levenshtein(a.s, b.s) <= 2"),
    "hashjoin_key": "SELECT c_custkey AS left_id, n_nationkey::BIGINT AS right_id FROM customer JOIN nation ON 'NATION_' || c_nationkey = n_name",
    "hashjoin_keys": f"WITH {_NAMES} SELECT a.s AS left_id, b.s AS right_id FROM n a JOIN n b ON len(list_intersect(string_split(a.s, ' '), string_split(b.s, ' '))) > 0",
    "projection_count": f"WITH {_SUPPLIERS} SELECT a, b, m::DOUBLE AS weight FROM m",
    "projection_jaccard": f"WITH {_SUPPLIERS} SELECT a, b, m / (x.n + y.n - m) AS weight FROM m JOIN k x ON x.s = a JOIN k y ON y.s = b WHERE m / (x.n + y.n - m) >= 0.1",
    "projection_cosine": f"""WITH {_BIPARTITE}, q AS (SELECT s, sum(w * w) AS q FROM e GROUP BY 1),
        p AS (SELECT a.s AS a, b.s AS b, sum(a.w * b.w) AS dot FROM e a JOIN e b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2)
        SELECT a, b, dot / sqrt(x.q * y.q) AS weight FROM p JOIN q x ON x.s = a JOIN q y ON y.s = b""",
    "best_matching": """WITH t AS (SELECT lang AS t, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source AS p, count(*) AS n FROM documents GROUP BY 1),
        m AS (SELECT lang AS t, source AS p, count(*) AS m FROM documents GROUP BY 1, 2),
        s AS (SELECT m.t, m.p, m / p.n AS precision, m / t.n AS recall FROM m JOIN t USING (t) JOIN p USING (p)),
        f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM s),
        b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f1 DESC, p) AS r FROM f)
        SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM b WHERE r = 1""",
    "labels_to_clusters": "SELECT label::BIGINT AS cluster, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1",
    "split_column": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part",
    "transform_column": "SELECT n_name, lower(trim(n_name)) || '!' AS made FROM nation",
    "ngram_keys": f"""WITH {_NAMES}, g AS (SELECT s, list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) AS g FROM n),
        m AS (SELECT s, g, unnest(range(1, (1 << len(g)))) AS mask FROM g)
        SELECT s AS value, array_to_string(list_filter(g, lambda x, i: ((mask >> (i - 1)) & 1) = 1), '') AS key FROM m
        WHERE bit_count(mask::BIGINT) >= greatest(1, floor(len(g) * 0.8::DOUBLE))""",
    "component_sizes": f"""WITH RECURSIVE {_SUPPLIERS.split(", k AS")[0].strip().rstrip(",")} , l AS (SELECT s AS x, 'p' || p AS y FROM e UNION ALL SELECT 'p' || p, s FROM e),
        t(id, step, c) AS (SELECT DISTINCT x, 0, x FROM l UNION ALL
          SELECT l.x, max(t.step) + 1, min(least(t.c, o.c)) FROM l JOIN t ON t.id = l.y JOIN t o ON o.id = l.x WHERE t.step < 8 GROUP BY l.x)
        SELECT count(*) AS size FROM t WHERE step = 8 GROUP BY c""",
    "leader_clusters": _GREEDY.format(order="id", members=_LEAD),
    "vp_tree": _GREEDY.format(order="id", members=_BALL),
    "fuzzy_clusters": _GREEDY.format(order="first", members=_BALL),
    "phonetics_of_names": _PHONETICS,
    "floatsam": _FLOATSAM,
    "projection_sets": f"""WITH {_SUPPLIERS}, z AS (SELECT a, b, m, x.n AS p, y.n AS q FROM m JOIN k x ON x.s = a JOIN k y ON y.s = b),
        w AS (SELECT 'dice' AS metric, a, b, 2 * m / (p + q) AS weight FROM z UNION ALL SELECT 'overlap', a, b, m / least(p, q) FROM z
          UNION ALL SELECT 'binary_cosine', a, b, m / sqrt(p * q) FROM z)
        SELECT * FROM w WHERE weight >= 0.05""",
    "simhash_of_benchmark": _SIMHASH.format(hex0=_HEX.format(0), hex1=_HEX.format(64)),
    "blocks_of_urls": _BLOCKS,
    "keys_of_urls": _URL_KEYS,
    "bands": """WITH t AS (SELECT unnest(range(2, 10)) / 10 AS threshold), b AS (SELECT unnest(range(1, 65)) AS b),
        g AS (SELECT threshold, min(b) AS bands FROM t JOIN b ON (1 / b) ** (b / 64) <= threshold GROUP BY 1)
        SELECT threshold, bands, round((1 / bands) ** (bands / 64), 9) AS at, round(1 - (1 - threshold ** (64 / bands)) ** bands, 9) AS found FROM g""",
    "clusters_from_buckets": """WITH RECURSIVE u AS (SELECT DISTINCT url AS s, array_to_string(string_split(url, '/')[:4], '/') AS h FROM pages),
        e AS (SELECT a.s AS x, b.s AS y FROM u a JOIN u b ON a.h = b.h AND a.s <> b.s AND levenshtein(a.s, b.s) <= 2),
        r(id, c) AS (SELECT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
        SELECT min(c) AS cluster_id, id FROM r GROUP BY id""",
    "clusters_to_labels": "SELECT vec_id AS item, label::BIGINT AS cluster FROM embeddings",
    "zig_zag": "SELECT DISTINCT url AS value, url AS key0, reverse(url) AS key1 FROM pages",
    "key_counts": "SELECT upper(event_type) AS key, count(*) AS n FROM events GROUP BY 1",
    "online_mean": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1",
}
