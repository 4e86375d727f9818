import random

import numpy as np
from kindred.llm import toxicity as X
from pyspark.sql import functions as F

from .corpora import SCHEMA, words

INSULTS = ["grubbel", "snarkface", "plonker"]


def labelled(n=700, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(5, 60), 2000).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, " ".join(w), "en", "s", 1, "x", 1))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_ranked_well(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(None, None, None, None, None, None, None), (9000, "", "", "", 0, "", 0)], SCHEMA)
    model = X.fit_on(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    out = X.score(docs, model).collect()
    assert len(out) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    held = [(r["score"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.97
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    kept = X.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.filter(F.col("doc_id") < 700).count() in range(500, 550)


def test_isotonic_and_missing_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * x))).astype(float)
    at, to = X.isotonic(x, y)
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all()
    docs = spark.createDataFrame([(1, "a", None, None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs, X.fit_on(docs, none)).first()["score"] == 0.0
    assert X.score(spark.createDataFrame([], SCHEMA), X.fit_on(docs, none)).count() == 0


def test_nearness_is_of_all_hits():
    lexicon = X.Lexicon({"plonker": 1.0}, {})
    calm = "a plonker is a tool " + "for the workshop and the garden " * 4
    text = calm * 100 + "you plonker " * 300
    near = X.features(text, lexicon)[7]
    assert near == np.float64(300 / 400)
    assert X.features(calm * 100, lexicon)[7] == 0 and X.features("you fool", lexicon)[7] == 0
    # whole words only, at most 80 characters away
    for gap, want in ((70, 1.0), (90, 0.0)):
        assert X.features("you " + "x" * gap + " plonker", lexicon)[7] == want


def test_long_runs_take_linear_time():
    import time

    lexicon = X.Lexicon({"bad": 1.0}, {"stem": 1.0})
    for text in ("x" * 1_000_000 + "1", "a1" * 300_000, "$" * 1_000_000, "bad you " * 100_000, "a-" * 300_000 + " 7"):
        began = time.time()
        X.features(text, lexicon)
        assert time.time() - began < 20, text[:20]
