"""MinHash near-dedup with ProbMinHash: weighted shingles, probability Jaccard, bands, verification.

A text's elements are its distinct shingles of five words, weighted by how often they stand. Each
element is a Poisson process whose rate is its weight; an arrival goes to a register at random, and
a register keeps its earliest arrival's element. An element stops as soon as its next arrival is
later than every register's, so a text costs about n + m log m arrivals for n elements and m
registers. Two texts agree in a register with probability J_P, their probability Jaccard.

Texts with the same words are one node (copies are never paired). Registers are cut into bands; a
bucket is a band's value. Nothing emits all pairs of a bucket:

1. each member is verified (exact J_P) against the bucket's pivot, its smallest member by a hash
   that changes every few bands, so a text meets several pivots, and components of the links follow;
2. buckets that hold more than one component form groups (buckets that share members are one). A group
   has a *base*: the elements that over half of its texts have. Texts are compared by what sets them
   apart from the base, which for near copies is the few shingles around their edits. Two texts differ
   by at most the sum of their distances from the base, so all that are surely alike are linked to the
   group's closest text, with no comparison;
3. any other two that are alike must have differences from the base in common, and how many follows
   from their sizes. So differences are joined by prefix and position filters, across components only;
   the pairs' differences then give bounds of J_P, and pairs between the bounds are verified.

So every two texts that share a bucket and have J_P >= t end in one class, whatever the bucket's
size, and copies of one text cost rows by their edits, not by their pairs. With 24 bands of 5 a pair
at J_P = 0.8 shares no bucket with probability 7e-5.

Defined results: null is the empty text; texts without words are alike only if equal; a text of
fewer than five words is one shingle; rows that share an id are one document; rows with a null id
get the class of rows with the same words (null if they have no id either). Extra columns are not
read. ``keep_one`` keeps one row without an id of those with the same words, if no row with an id has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import components, give_back, let_go, materialise, mix64, shingles, shingles_of, word_hashes, word_spans

_STEP = np.uint64(0xD1342543DE82EF95)
PIVOT_CHANGES = 6
#: Differences are listed with what stands before them up to this place; behind it a pair may meet twice.
BEFORE = 48


def probminhash(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The element of the earliest arrival in each of ``m`` registers (zeros for no elements)."""
    best = np.full(m, np.inf)
    out = np.zeros(m, np.uint64)
    active, w = elements, weights.astype(float)
    time = np.zeros(len(active))
    turn = 0
    while len(active):
        turn += 1
        bits = mix64(active + np.uint64(turn * int(_STEP) % 2**64))
        time = time - np.log1p(-(bits >> np.uint64(11)).astype(float) / 2.0**53) / w
        register = (mix64(bits ^ _STEP) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(time < best[register])
        early = early[np.argsort(-time[early], kind="stable")]
        best[register[early]] = time[early]
        out[register[early]] = active[early]
        on = time < best.max()
        active, w, time = active[on], w[on], time[on]
    return out


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact J_P of two shingle lists (weights are counts); 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    if len(ua) == len(a) and len(ub) == len(b):
        both = len(np.intersect1d(ua, ub, assume_unique=True))
        return both / (len(ua) + len(ub) - both)
    union = np.union1d(ua, ub)
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, ua)] = ca
    wb[np.searchsorted(union, ub)] = cb
    with np.errstate(divide="ignore"):
        ratio = wb / wa
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    low = np.searchsorted(ratio, ratio, "left")
    below = np.concatenate(([0], np.cumsum(wa)))[low]
    above = (np.concatenate((np.cumsum(wb[::-1])[::-1], [0])))[low]
    common = (wa > 0) & (wb > 0)
    return float((1 / (below[common] / wa[common] + above[common] / wb[common])).sum())


def band_keys(text: str | None, bands: int, rows: int) -> tuple[bytes, np.ndarray]:
    """(digest of the words, band values); a text without words has its own digest and no bands."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    if not len(words):
        return hashlib.md5(b"\0" + data).digest(), np.zeros(0, np.int64)
    elements, weights = np.unique(shingles(words, 5), return_counts=True)
    sketch = probminhash(elements, weights, bands * rows).reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for column in sketch.T:
        keys = mix64(keys * np.uint64(0x9FB21C651E98DF25) + column)
    return hashlib.md5(words.tobytes()).digest(), keys.view(np.int64)


def signatures(docs: DataFrame, bands: int = 24, rows: int = 5) -> DataFrame:
    """(doc_id, same, bands)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            got = [band_keys(t.as_py(), bands, rows) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g for g, _ in got], pa.binary()),
                    pa.array([k.tolist() for _, k in got], pa.list_(pa.int64())),
                ],
                ["doc_id", "same", "bands"],
            )
        give_back()

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ready.mapInArrow(run, "doc_id long, same binary, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of pairs (a, b); texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sims = []
            b_ids = batch.column("b").to_pylist()
            for i, b in enumerate(b_ids):
                if b not in held:
                    held.clear()
                    held[b] = shingles_of(batch.column("text_b")[i].as_py())
                sims.append(probability_jaccard(shingles_of(batch.column("text_a")[i].as_py()), held[b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"]
            )
        held.clear()
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.mapInArrow(run, "a long, b long, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _elements(text: str | None) -> np.ndarray:
    """A text's shingles as a set: (shingle, occurrence) pairs, the lowest bit set for second and later ones."""
    every = np.sort(shingles_of(text))
    first = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    nth = np.arange(len(every)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(every)]))))
    mixed = mix64(every + nth.astype(np.uint64) * _STEP)
    return ((mixed & ~np.uint64(1)) | (nth > 0).astype(np.uint64)).view(np.int64)


def _apart(sets: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, grp, n_apart, sure, high, apart): what sets each text apart from its group's base.

    With H elements of difference between two texts of n and m elements, J_P is at least
    (n + m - H) / (n + m + H), and at most (n + m - H + 2 X) / (n + m + H) where X counts the differences in
    shingles that both have, which are second or later occurrences. So J_P >= t if H is at most the sum
    of both texts' (1 - t) n / (1 + t), and only if it is at most that of ((1 - t) n + 2 x) / (1 + t). ``sure``
    and ``high`` are these numbers less the text's own differences. ``apart`` has the differences in one order
    for all texts of the group: added elements, then missing ones, those that are missing least first.
    """
    schema = "rep long, root long, grp long, n_apart long, sure double, high double, apart array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rep, root, grp, own, of_base in zip(*(b.column(c).to_pylist() for c in ("rep", "root", "grp")), b.column("own"), b.column("base"), strict=True):
                own = own.values.to_numpy()
                common = of_base.values.to_numpy() if of_base.is_valid else own[:0]
                added = np.sort(own[~np.isin(own, common)])
                gone = common[~np.isin(common, own)]
                apart = np.concatenate((added, gone))
                free = (1 - threshold) * len(own) / (1 + threshold)
                later = 2 * int((apart & 1).sum()) / (1 + threshold)
                rows.append((rep, root, grp, len(apart), free - len(apart), free + later - len(apart), apart))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (*[pa.int64()] * 4, pa.float64(), pa.float64(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return sets.join(base, "grp", "left").select("rep", "root", "grp", "own", "base").mapInArrow(run, schema)


def _across(nodes: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, pairs that the bounds leave open), both (a, b), between components of nodes (rep, root, grp)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_elements(t.as_py()) for t in b.column("text")]
            at = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            flat = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("rep", "root", "grp")), pa.ListArray.from_arrays(pa.array(at), flat)],
                ["rep", "root", "grp", "own"],
            )

    wanted = texts.withColumnRenamed("id", "rep").join(nodes, "rep").select("rep", "root", "grp", "text")
    sets = materialise(wanted.mapInArrow(sets_of, "rep long, root long, grp long, own array<long>"), "sets")
    sizes = sets.groupBy("grp").agg(F.count("*").alias("size"))
    common = sets.select("grp", F.explode("own").alias("element")).groupBy("grp", "element").agg(F.count("*").alias("n"))
    common = common.filter("n > 1").join(sizes, "grp").filter("2 * n > size")
    base = common.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "element"))).alias("base"))
    base = base.select("grp", F.col("base.element").alias("base"))
    apart = materialise(_apart(sets, base, threshold), "apart")
    hubs = apart.groupBy("grp").agg(F.max(F.struct("sure", "rep", "root")).alias("hub"), F.max("high").alias("top"))
    near = (F.col("sure") + F.col("hub.sure") >= 1e-9) & (F.col("rep") != F.col("hub.rep"))
    told = apart.join(hubs, "grp").withColumn("near", near)
    sure = told.filter("near").select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
    # components that a sure link joins with the hub's are one
    mains = told.groupBy("grp", "root").agg(F.max(F.col("near") | (F.col("root") == F.col("hub.root"))).alias("main"))
    still = mains.groupBy("grp").agg(F.min("main").alias("one")).filter("not one").select("grp")
    told = told.join(mains, ["grp", "root"]).join(still, "grp")
    told = told.withColumn("root", F.when(F.col("main"), F.col("hub.root")).otherwise(F.col("root")))
    least = F.greatest(F.lit(1.0), (-F.col("high") - F.col("top")) / 2 - 1e-6)
    heads = told.withColumn("least", least).select(
        "grp", "rep", "root", "main", "high", "n_apart", "apart",
        F.posexplode(F.expr("slice(apart, 1, greatest(0, 1 + cast(floor(n_apart - least) as int)))")).alias("at", "element"),
    )
    # what stands before lets a pair meet only at the first difference that both have
    before = F.when(F.col("at") <= BEFORE, F.expr("slice(apart, 1, at)"))
    heads = heads.select("grp", "rep", "root", "main", "high", "element", (F.col("n_apart") - F.col("at")).alias("left"), before.alias("before"))
    heads = materialise(heads, "heads")
    x = heads.filter("not main").select("grp", "element", *(F.col(c).alias(c + "_x") for c in ("rep", "root", "high", "left", "before")))
    y = heads.select("grp", "element", *(F.col(c).alias(c + "_y") for c in ("rep", "root", "main", "high", "left", "before")))
    other = (F.col("root_x") != F.col("root_y")) & (F.col("main_y") | (F.col("rep_x") < F.col("rep_y")))
    fits = 2 * F.least("left_x", "left_y") >= -(F.col("high_x") + F.col("high_y")) - 1e-6
    first = ~F.coalesce(F.arrays_overlap("before_x", "before_y"), F.lit(False))
    pair = (F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))
    one = x.join(y, ["grp", "element"]).filter(other & fits & first).select("grp", *pair)
    # texts whose repeated shingles differ from the base's may be alike with no difference in common
    odd = told.filter("high > sure").select("grp", *(F.col(c).alias(c + "_x") for c in ("rep", "root", "high", "main")))
    any_ = told.select("grp", *(F.col(c).alias(c + "_y") for c in ("rep", "root", "high", "main")))
    apart_roots = (F.col("root_x") != F.col("root_y")) & (F.col("high_x") + F.col("high_y") >= -1e-6)
    two = odd.join(any_, "grp").filter(apart_roots).select("grp", *pair)
    # the differences of both tell the bounds of their likeness, which are one number if nothing repeats
    pairs = one.union(two).distinct()
    for side in ("a", "b"):
        own = apart.select(F.col("rep").alias(side), "grp", *(F.col(c).alias(f"{c}_{side}") for c in ("sure", "high", "apart")))
        pairs = pairs.join(own, ["grp", side])
    common = F.array_intersect("apart_a", "apart_b")
    pairs = pairs.withColumn("common", common).withColumn("both", 2 * F.size("common"))
    later = F.size(F.filter("common", lambda e: e.bitwiseAND(F.lit(1)) == 1)) * (4 / (1 + threshold))
    alike = F.col("both") >= -(F.col("sure_a") + F.col("sure_b")) + 1e-9
    pairs = pairs.filter(F.col("both") - later >= -(F.col("high_a") + F.col("high_b")) - 1e-6)
    pairs = materialise(pairs.select("a", "b", alike.alias("alike")).distinct(), "alike")
    return sure.union(pairs.filter("alike").select("a", "b")), pairs.filter("not alike").select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """(doc_id, class_id, class_size) of every row; class_id is the class's smallest id."""
    sig = materialise(signatures(docs, bands, rows), "sig")
    nodes = materialise(
        sig.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nodes"
    )
    posts = nodes.filter("rep is not null").select("rep", F.posexplode("bands").alias("band", "key"))
    turn = F.xxhash64("rep", F.col("band") % PIVOT_CHANGES)
    buckets = posts.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct(turn.alias("turn"), "rep")).alias("pivot")
    )
    members = materialise(
        posts.select("key", "rep").join(buckets.filter("n > 1").select("key", F.col("pivot.rep").alias("pivot")), "key"),
        "members",
    )
    pairs = members.filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(wanted, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), "text"),
        "texts",
    )
    first = materialise(_verify(pairs.distinct(), texts), "sims")
    links = first.filter(F.col("sim") >= threshold)
    roots = components(links)
    root_of = roots.select(F.col("id").alias("rep"), "root")
    placed = members.join(root_of, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    open_ = materialise(placed.join(split.filter("lo <> hi and n > 2").select("key"), "key").select("rep", "pivot", "root").distinct(), "open")
    if not open_.isEmpty():
        groups = components(open_.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "groups")
        grouped = open_.select("rep", "root").distinct().join(groups.select(F.col("id").alias("rep"), F.col("root").alias("grp")), "rep")
        sure, more = _across(grouped, texts, threshold)
        second = _verify(more.join(first.select("a", "b"), ["a", "b"], "left_anti"), texts).filter(F.col("sim") >= threshold)
        new = materialise(sure.union(second.select("a", "b")), "links")
        if not new.isEmpty():
            roots = components(links.select("a", "b").union(new))
    reps = nodes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select(
        "same", F.coalesce("root", "rep").alias("class_id")
    )
    told = sig.select("doc_id", "same").join(reps, "same").select("doc_id", "class_id")
    sizes = told.groupBy(F.col("class_id").alias("c")).agg(F.count("*").alias("class_size"))
    return told.join(sizes, F.col("class_id").eqNullSafe(F.col("c"))).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest id.

    Of rows without an id one stays of those with the same words, if no row with an id has these words.
    """
    gone = near_duplicates(docs, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.filter("doc_id is not null").join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return kept
    at = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([band_keys(t, 1, 1)[0] for t in b.column(0).field(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["row", "same"])

    rows = nameless.select(F.struct(*docs.columns).alias("row"))
    rows = rows.mapInArrow(mark, StructType([*rows.schema.fields, StructField("same", BinaryType())]))
    named = signatures(docs.filter("doc_id is not null"), 1, 1).select(F.col("same").alias("theirs"))
    left = rows.join(named, F.col("same") == F.col("theirs"), "left_anti").dropDuplicates(["same"])
    return kept.unionByName(left.select("row.*"))
