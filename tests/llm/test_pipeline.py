import random

import pytest

from .corpora import SCHEMA, words

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_take_effect_and_keep_clean_rows(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = [], []
    add = lambda t: rows.append((len(rows), t, "en", "s", len(t)))
    for i in range(400):
        t = words(rng, rng.randrange(60, 120), 10**6).split()
        if i % 4 == 0:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(["grubbel", "plonker"]))
        labels.append((i, 0, int(i % 4 == 0)))
        add(" ".join(t))
    copied, passage = rows[1][1], words(rng, 70, 10**6)
    add(copied)
    near = rows[2][1].split()
    near[5] = "other"
    add(" ".join(near))
    for _ in range(2):
        add(words(rng, 80, 10**6) + " " + passage + " " + words(rng, 80, 10**6))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    bad = {i for i, _, y in labels if y}
    assert len(bad & seen["toxicity"]) <= 3 and len(seen["toxicity"]) >= 404 - 100 - 6
    assert 1 not in seen["exact_dedup"] and 400 in seen["exact_dedup"]
    assert 2 in seen["minhash_near_dedup"] and 401 not in seen["minhash_near_dedup"]
    cut = spark.read.parquet(f"{d}/substring_dedup").filter("doc_id in (402, 403)").collect()
    assert sorted(passage in r["text"] for r in cut) == [False, True] and all(r["n_chars"] == len(r["text"]) for r in cut)
    assert seen["substring_dedup"] == seen["minhash_near_dedup"] == seen["best_fit_packing"]


def test_run_on_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert pipeline.run(spark, d).count() == 0
