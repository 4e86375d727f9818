import hashlib
from collections import defaultdict

from kindred.llm import exact_dedup as E
from kindred.llm.common import fresh_path

from .corpora import SCHEMA, corpus, frame


def test_equals_brute_force(spark):
    rows = corpus(0)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = {
        (i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    }
    assert {tuple(r) for r in E.exact_dedup(frame(spark, rows)).collect()} == want


def test_index_persists_and_later_batches_meet_it(spark):
    path = fresh_path(spark, "index")
    first = spark.createDataFrame([(1, "a"), (7, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string")
    E.DigestIndex(spark, path, 4).add(first).collect()
    again = E.DigestIndex(spark, path, 4)
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in again.add(second).collect()}
    assert got == {(9, 7, 1, False), (10, 11, 2, False), (11, 11, 2, True)}
    assert again.table().count() == 3


def test_nulls_ties_and_empty(spark):
    rows = [(None, "x", "a", "b", 1, "s", 1), (None, "x", "a", "b", 1, "s", 1), (3, "y", "a", "b", 1, "s", 1), (3, "y", "a", "b", 1, "s", 1), (4, None, "a", "b", 1, "s", 1), (5, "", "a", "b", 1, "s", 1)]
    told = [tuple(r)[:4] for r in E.exact_dedup(frame(spark, rows)).collect()]
    assert sorted(told, key=str) == sorted([(None, None, 2, True), (None, None, 2, False), (3, 3, 2, True), (3, 3, 2, False), (4, 5, 2, False), (5, 5, 2, True)], key=str)
    kept = E.keep_first(frame(spark, rows))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 5] and kept.columns == frame(spark, rows).columns
    empty = spark.createDataFrame([], SCHEMA)
    assert E.exact_dedup(empty).count() == 0 and E.keep_first(empty).count() == 0


def test_clashing_columns_stay_as_they_are(spark):
    schema = "doc_id long, text string, times int, _d string, _digest string, _i long, digest string, kept boolean, row int, id int"
    rows = [(1, "a", 5, "d", "x", 7, "q", None, 3, 4), (2, "a", 6, "e", "y", 8, "r", True, 3, 4), (2, "a", 6, "e", "y", 8, "r", True, 3, 4), (3, "b", 7, "f", "z", 9, "s", False, 3, 4)]
    df = spark.createDataFrame(rows, schema)
    kept = E.keep_first(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == [rows[1], rows[3]]
    assert E.exact_dedup(df).count() == 4


def test_an_index_is_reopened_with_its_own_buckets(spark):
    path = fresh_path(spark, "index")
    texts = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert E.DigestIndex(spark, path, 8).add(texts).filter("kept").count() == 200
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    again = E.DigestIndex(other, path)
    assert again.buckets == 8
    assert again.add(other.range(200).selectExpr("id + 1000 AS doc_id", "concat('text ', id) AS text")).filter("kept").count() == 0
    assert again.table().count() == 200


def test_a_batch_can_be_added_again(spark):
    index = E.DigestIndex(spark, fresh_path(spark, "index"), 4)
    index.add(spark.createDataFrame([(1, "old")], "doc_id long, text string"), batch="first")
    docs = spark.createDataFrame([(5, "a"), (7, "a"), (8, "old")], "doc_id long, text string")
    told = [sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in index.add(docs, batch="second").collect()) for _ in range(2)]
    assert told[0] == told[1] == [(5, 7, False), (7, 7, True), (8, 1, False)]
    assert index.table().count() == 2
