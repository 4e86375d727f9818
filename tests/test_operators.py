import random

import pytest
from kindred.functions import metrics as M, text as T
from kindred.operators import clusters as C, evaluate, graph, join, pairs as P, words
from kindred.plans.planner import similarity_pairs
from pyspark.sql import functions as F

CHAIN = ["abc", "bcd", "cde", "def", "efg", "fgh", "ghi"]


def items(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id long, value string")


def named(clusters, xs):
    return {tuple(sorted(xs[i] for i in r["ids"])) for r in C.as_lists(clusters).collect()}


def groups(*xs):
    return {tuple(sorted(g.split())) for g in xs}


def lev(a, b):
    return F.levenshtein(a, b)


def test_pairwise_modes(spark):
    df = items(spark, CHAIN)
    run = lambda mode, **k: named(C.pairwise(df, distance=lev, radius=2, mode=mode, **k), CHAIN)
    assert run("leader") == groups("abc bcd", "cde def", "efg fgh")
    assert run("fuzzy_clusters") == groups("abc bcd", "bcd cde def", "def efg fgh", "fgh ghi")
    assert run("fuzzy_clusters", min_size=3) == groups("abc bcd cde", "cde def efg", "efg fgh ghi")
    assert run("connected_components") == groups(" ".join(CHAIN))
    assert named(C.vp_tree(df, lev, 2), CHAIN) == groups("abc bcd", "bcd cde def", "def efg fgh", "fgh ghi")
    with pytest.raises(TypeError):
        C.pairwise(df, distance=lev, radius=2, mode="other")
    with pytest.raises(TypeError):
        P.make_similarity_function()


def test_blocking_and_neighborhoods(spark):
    xs = "Abelard Abelar Atrium Atrides Belgian Belgia Telgia".split()
    df, want = items(spark, xs), groups("Abelard Abelar", "Belgian Belgia")
    assert named(C.blocking(df, block=lambda v: F.substring(v, 1, 1), distance=lev, radius=1), xs) == want
    assert named(C.sorted_neighborhood(df, [lambda v: v], 2, distance=lev, radius=1), xs) == want
    near = lambda a, b: a[:4] == b[:4]
    assert named(C.adaptive_sorted_neighborhood(df, [lambda v: v], near, 2, distance=lev, radius=1), xs) == want
    for n, w in ((1, 2), (7, 3), (20, 5)):
        seen = [i for s, e in P.adaptive_windows(list(range(n)), lambda a, b: a // 4 == b // 4, w) for i in range(s, e + 1)]
        assert seen == list(range(n))


def test_key_collision(spark):
    xs = ["Hello", "hello", "heLLo", "gooDbye", "Goodbye"]
    df = items(spark, xs)
    assert named(C.key_collision(df, key=F.lower), xs) == groups("Hello hello heLLo", "gooDbye Goodbye")
    nothing = lambda v: F.when(v != "Hello", F.lower(v))
    assert named(C.key_collision(df, key=nothing), xs) == groups("hello heLLo", "gooDbye Goodbye")
    ys = ["John Doe", "John Doe Jr.", "Mary S.", "Mary Silva", "John D."]
    merged = C.key_collision(items(spark, ys), keys=lambda v: T.ngrams(5, v), merge=True)
    assert named(merged, ys) == {("John D.", "John Doe", "John Doe Jr."), ("Mary S.", "Mary Silva")}


def test_intersection_and_minhash(spark):
    xs = ["abcde", "abcdeg", "abcdegfjexge", "zyx"]
    df = items(spark, xs).select("id", M.chars("value").alias("value"))
    assert named(C.intersection_index(df), xs) == groups("abcde abcdeg")
    assert named(C.intersection_index(df, "overlap"), xs) == groups("abcde abcdeg abcdegfjexge")
    assert named(C.minhash(df, 0.8, 64, 32), xs) == groups("abcde abcdeg")
    with pytest.raises(TypeError):
        C.intersection_index(df, "cosine")


def test_passjoin(spark):
    xs = ["benjamin", "paule", "paul", "pa", "benja", "benjomon", "ab", "a", ""]
    df = items(spark, xs)
    want = {
        1: {("paul", "paule"), ("", "a", "ab", "pa")},
        2: {("benjamin", "benjomon"), ("", "a", "ab", "pa", "paul", "paule")},
        3: {("benja", "benjamin", "benjomon"), ("", "a", "ab", "pa", "paul", "paule")},
    }
    for k, w in want.items():
        assert named(C.passjoin(df, k), xs) == w
    assert P.segments(3, "vankatesh") == ["va", "nk", "at", "esh"] and P.segments(3, "avaterasha") == ["av", "at", "era", "sha"]
    starts = {(i, start, size): P.probe_interval(3, 1, i, 10, start, size) for i, start, size in P.partition(3, 9)}
    assert starts == {(0, 0, 2): (0, 0), (1, 2, 2): (1, 3), (2, 4, 2): (4, 6), (3, 6, 3): (7, 7)}


def test_fast_joins_equal_naive(spark):
    rng = random.Random(7)
    xs = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(90)})
    df = items(spark, xs)
    key = lambda d: sorted((r["id_a"], r["id_b"]) for r in d.collect())
    for k in (1, 2, 3):
        want = key(P.naive_pairs(df, "levenshtein", k))
        assert key(P.segment_pairs(df, k)) == want
        assert key(P.pivot_pairs(df, F.levenshtein, k)) == want
        if k == 1:
            assert key(P.wildcard_pairs(df)) == want and key(P.half_pairs(df)) == want
    sets = df.select("id", F.array_distinct(T.ngrams(2, "value")).alias("value")).filter("value[0] <> ''")
    for metric in ("jaccard", "dice", "binary_cosine"):
        for t in (0.4, 0.7):
            want = key(P.naive_pairs(sets, metric, t))
            assert key(P.prefix_pairs(sets, metric, t)) == want == key(P.count_pairs(sets, metric, t))
            assert key(P.prefix_pairs(sets, metric, t, "crc32")) == want
    with pytest.raises(TypeError):
        similarity_pairs(sets, "nothing", 0.5)


def test_common_segments_make_no_pairs(spark):
    """Names that all share a segment, some of them repeated: as many pairs as brute force, by few comparisons."""
    rng = random.Random(5)
    xs = ["Supplier#%09d" % rng.randrange(3000) for _ in range(300)] + ["x", "xy", "", "Suplier#000000001", "Supplier#00000001"]
    df = items(spark, xs)
    for k in (1, 2):
        want = {(i, j): d for i in range(len(xs)) for j in range(i + 1, len(xs)) if (d := edits(xs[i], xs[j])) <= k}
        got = P.segment_pairs(df, k)
        rows = got.collect()
        assert len(rows) == len(want) and {(r["id_a"], r["id_b"]): r["score"] for r in rows} == want
    assert most_rows_of_a_join(P.segment_pairs(df, 1), "piece") < 20 * len(xs)


def test_clusters_from_buckets_by_edits(spark):
    """As with the condition, but a large bucket makes few pairs; values meet within their bucket only."""
    rng = random.Random(3)
    xs = sorted({"/%06d%s" % (rng.randrange(10**6), rng.choice((".html", "#top"))) for _ in range(400)} | {f"/{i}/" for i in range(9)})
    df = items(spark, xs)
    keyed = df.select(F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("key"), "id")
    got = C.as_lists(C.clusters_from_buckets(keyed, df, edits=2)).collect()
    want = C.as_lists(C.clusters_from_buckets(keyed, df, lambda a, b: F.levenshtein(a, b) <= 2)).collect()
    assert want and sorted(r["ids"] for r in got) == sorted(r["ids"] for r in want)
    rows = keyed.join(df, "id").withColumnRenamed("key", "block")
    assert most_rows_of_a_join(P.segment_pairs(rows, 2, "block"), "piece") < 30 * len(xs)
    with pytest.raises(TypeError):
        C.clusters_from_buckets(keyed, df, lambda a, b: a == b, edits=1)


def test_nn_descent_and_quickjoin(spark):
    xs = ["Mister Hyde", "Mister Hide", "Claudia Loc", "Cladia Loc"]
    want = {("Mister Hide", "Mister Hyde"), ("Cladia Loc", "Claudia Loc")}
    df = items(spark, xs)
    assert named(C.nn_descent(df, lev, 1, 2), xs) == want
    assert named(C.quickjoin(df, lev, 1), xs) == want and named(C.laesa(df, lev, 1), xs) == want
    sim = lambda a, b: M.jaccard_similarity(M.chars(a), M.chars(b))
    assert named(C.quickjoin(df, similarity=sim, radius=0.75), xs) == want


def test_cosine_nearest(spark):
    v = [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 0.9), (3, "b", 1.0), (3, "c", 5.0)]
    got = {r["id"]: r["nearest"] for r in P.cosine_nearest(spark.createDataFrame(v, "id long, term string, weight double")).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_equal_vectors_are_compared_once(spark):
    """Copies cost no comparisons of their own: the join on terms makes rows for different vectors only."""
    v = [(100 * c + i, t, float(1 + (i + 1) * (t == "a"))) for c in range(12) for i in range(3) for t in "ab"]
    got = P.cosine_pairs(spark.createDataFrame(v, "id long, term string, weight double"), 0.97)
    cos = lambda i, j: ((i + 2) * (j + 2) + 1) / (((i + 2) ** 2 + 1) * ((j + 2) ** 2 + 1)) ** 0.5
    ids = [100 * c + i for c in range(12) for i in range(3)]
    want = {(a, b): cos(a % 100, b % 100) for a in ids for b in ids if a < b and cos(a % 100, b % 100) >= 0.97}
    rows = got.collect()
    assert len(rows) == len(want) and {(r["id_a"], r["id_b"]) for r in rows} == set(want)
    assert all(r["score"] == pytest.approx(want[r["id_a"], r["id_b"]]) for r in rows)
    made = most_rows_of_a_join(got, "term")
    assert 0 < made <= 2 * 3 * 3


def most_rows_of_a_join(df, on):
    """Rows that the joins on a column made, by the metrics of the plan that ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if "Join" in name and on in p.simpleString(10_000):
            found.append(p.metrics().apply("numOutputRows").value())
        if "AdaptiveSparkPlan" in name:
            walk(p.executedPlan())
        if "QueryStage" in name:
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return max(found, default=0)


def test_hashjoin(spark):
    left = spark.createDataFrame([(1, "Ron The Turtel"), (2, "John Mirage"), (3, None)], "id long, value string")
    right = spark.createDataFrame([(1, "Ron Wisley"), (2, "John Doe"), (3, None)], "id long, value string")
    first = lambda v: F.lower(F.split(v, " ")[0])
    got = {(r["left_value"], r["right_value"]) for r in join.hashjoin(left, right, key=first).collect()}
    assert got == {("Ron The Turtel", "Ron Wisley"), ("John Mirage", "John Doe"), (None, None)}
    many = join.hashjoin(left, left, keys=lambda v: F.split(F.lower(v), " "))
    assert sorted((r["left_id"], r["right_id"]) for r in many.collect()) == [(1, 1), (2, 2)]
    with pytest.raises(TypeError):
        join.hashjoin(left, right)


def test_projection(spark):
    nodes = [(n, "people") for n in "ABCDM"] + [(c, "color") for c in ("red", "blue", "green", "black", "white")]
    edges = [("A", "red"), ("A", "blue"), ("B", "blue"), ("B", "green"), ("C", "green"), ("D", "black"), ("A", "black")]
    n, e = spark.createDataFrame(nodes, "id string, part string"), spark.createDataFrame(edges, "src string, dst string")
    got = lambda *a: {(r["a"], r["b"]): r["weight"] for r in graph.monopartite_projection(n, e, "people", *a).collect()}
    assert got() == {("A", "B"): 1, ("B", "C"): 1, ("A", "D"): 1}
    assert got("overlap", 0.6) == {("B", "C"): 1.0, ("A", "D"): 1.0}
    assert got("jaccard")[("A", "B")] == pytest.approx(1 / 4)
    with pytest.raises(TypeError):
        got("other")
    with pytest.raises(TypeError):
        graph.monopartite_projection(n, spark.createDataFrame([("A", "B")], "src string, dst string"), "people")


def test_projection_counts_where_arrays_lie(spark):
    """All metrics against brute force; pairs of single neighbours are not exchanged."""
    rng = random.Random(9)
    edges = sorted({(f"s{rng.randrange(60)}", f"p{rng.randrange(40)}") for _ in range(700)})
    near = {}
    for s, p in edges:
        near.setdefault(s, set()).add(p)
    n = spark.createDataFrame([(s, "s") for s in near] + [(p, "p") for p in {p for _, p in edges}], "id string, part string")
    e = spark.createDataFrame(edges, "src string, dst string")
    want = {(a, b): len(near[a] & near[b]) for a in near for b in near if a < b and near[a] & near[b]}
    got = lambda m: {(r["a"], r["b"]): r["weight"] for r in graph.monopartite_projection(n, e, "s", m).collect()}
    assert got(None) == want
    ratio = {k: m / (len(near[k[0]]) * len(near[k[1]])) ** 0.5 for k, m in want.items()}
    assert got("cosine") == pytest.approx(ratio)
    several = graph.monopartite_projections(n, e, "s", ["binary_cosine", "overlap"]).collect()
    assert {(r["a"], r["b"]): r["weight"] for r in several if r["metric"] == "binary_cosine"} == pytest.approx(ratio)
    assert len(several) == 2 * len(want)
    assert most_rows_of_a_join(graph.monopartite_projection(n, e, "s"), "via") == 0


def test_component_sizes_and_floatsam(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    pairs = [(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (6, 7), (6, 8)]
    edges = spark.createDataFrame([(a, b, 0.1 * i) for i, (a, b) in enumerate(pairs)], "src long, dst long, weight double")
    assert sorted(r["size"] for r in graph.component_sizes(nodes, edges).collect()) == [1, 3, 5]
    assert graph.second_largest_component_size(nodes, edges) == 3
    assert graph.floatsam_threshold(nodes, edges, max_drifter_size=3) == 0.0
    assert graph.floatsam_threshold(nodes, edges.limit(0)) == 0.0


def test_components_contract_their_links(spark, monkeypatch):
    """Random graphs, a long path and loops against a search; after the first round few links are left."""
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (17, 17)]
    edges += [(1000 + rng.randrange(30), 2000 + rng.randrange(60)) for _ in range(600)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    written, put = [], C.materialise

    def watch(df, tag):
        got = put(df, tag)
        if tag == "links":
            written.append(got.count())
        return got

    monkeypatch.setattr(C, "materialise", watch)
    got = C.connected_components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()
    assert len(got) == len(parent) and {r["id"]: r["component"] for r in got} == {x: root(x) for x in parent}
    assert len(written) > 1 and written[1] < 60 and written[-1] == 0


def test_evaluation(spark):
    f = lambda rows: spark.createDataFrame(rows, "item string, cluster long")
    truth = f([("a", 1), ("b", 1), ("c", 2), ("d", 2)])
    same = evaluate.best_matching_macro_average(truth, truth).first()
    assert tuple(same) == (1.0, 1.0, 1.0)
    one = evaluate.best_matching_macro_average(truth, f([("a", 1), ("b", 1), ("c", 1), ("d", 1)])).first()
    assert tuple(one) == pytest.approx((0.5, 1.0, 2 / 3))
    more = f([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)])
    assert evaluate.best_matching_macro_average(truth, more, True).first()["f1"] == 1.0
    for bad in (more, f([("a", 1)]), f([]), f([("a", 1), ("a", 2), ("b", 1), ("c", 2), ("d", 2)])):
        with pytest.raises(ValueError):
            evaluate.best_matching_macro_average(truth, bad)


def test_word_tokens(spark):
    texts = {
        "Good muffins cost $3.88\nin New York.": "Good muffins cost $ 3.88 in New York .",
        "They'll can't 90's!": "They 'll can't 90 's !",
        "L'amour de l’amour O.N.U. La vie.est": "L' amour de l’ amour O.N.U. La vie . est",
        "va-t-on est-il 15-20-minute mother-in-law": "va t on est il 15-20-minute mother-in-law",
        "🙏,🙏 2.3.4 :-) @f_i #x email:john@whatever.net": "🙏 , 🙏 2.3 . 4 :-) @f_i #x email : john@whatever.net",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in texts] + [(None,)], "text string").coalesce(1)
    got = [[t["value"] for t in r[0]] for r in df.select(words.tokenize("text")).collect()]
    assert [" ".join(g) for g in got] == [*texts.values(), ""]
    assert words.split_hashtag("#ExampleTo45") == ["Example", "To", "45"]
    with pytest.raises(TypeError):
        words.Options(keep=("word",), drop=("punct",))
    with pytest.raises(TypeError):
        words.Options(min_word_length=4, max_word_length=4)


def test_word_tokens_of_many_texts_are_not_held_in_python():
    """A batch of texts takes less memory of Python than its tokens as objects, and gives the same tokens."""
    import tracemalloc

    import pyarrow as pa

    texts = [f"word{i} and some more words, {i} of them" for i in range(3000)] + [None, ""]
    tracemalloc.start()
    got = words.token_lists(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    assert [[(t["type"], t["value"]) for t in r] for r in got.to_pylist()] == [words.tokenize_text(t) for t in texts]


def test_recall_of_approximate_neighbours_and_leaders(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdefg") for _ in range(9)) for _ in range(30)]
    xs = sorted({s[:i] + rng.choice("abcdefg") + s[i + 1 :] for s in stems for i in (1, 4, 7)})
    df = items(spark, xs)
    brute = lambda a, b: edits(xs[a], xs[b])
    got = {}
    for r in P.nn_descent(df, lev, 3).collect():
        got.setdefault(r["id_a"], []).append(r["score"])
    hits = 0
    for i in range(len(xs)):
        best = sorted(brute(i, j) for j in range(len(xs)) if j != i)[:3]
        assert len(got[i]) == 3
        hits += sum(s <= best[-1] for s in got[i])
    assert hits >= 0.9 * 3 * len(xs)
    sets = df.select("id", F.array_distinct(T.ngrams(2, "value")).alias("value"))
    want = {(r["id_a"], r["id_b"]) for r in P.naive_pairs(sets, "jaccard", 0.5).collect()}
    found = {(r["id_a"], r["id_b"]) for r in P.sqrt_index_pairs(sets, M.jaccard_similarity).collect()}
    assert want and len(want & found) >= 0.9 * len(want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_leaders_leave_no_row_without_partners(spark):
    """Rows that share no token with any leader meet by their own tokens; empty arrays meet nobody."""
    rows = [(i, ["x", str(i)]) for i in range(20)] + [(100 + i, ["lonely", f"l{i}"]) for i in range(3)] + [(200, [])]
    df = spark.createDataFrame(rows, "id long, value array<string>")
    for seed in range(4):
        found = {(r["id_a"], r["id_b"]) for r in P.sqrt_index_pairs(df, M.jaccard_similarity, seed=seed).collect()}
        assert {(100, 101), (100, 102), (101, 102)} <= found and all(200 not in p for p in found)
    assert P.sqrt_index_pairs(df.limit(0), M.jaccard_similarity).count() == 0
