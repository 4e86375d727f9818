import random
from collections import Counter

import numpy as np
from kindred.llm import common as C, minhash_dedup as D
from kindred.llm.common import shingles_of

from .corpora import SCHEMA, corpus, frame, words


def exact(a, b):
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    if not ca or not cb:
        return 0.0
    every = {*ca, *cb}
    return sum(1 / sum(max(ca[e] / ca[d], cb[e] / cb[d]) for e in every) for d in every if ca[d] and cb[d])


def classes(rows, t=0.8):
    ids = [r[0] for r in rows]
    sh = {r[0]: shingles_of(r[1]) for r in rows}
    texts = {r[0]: r[1] or "" for r in rows}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            alike = texts[a] == texts[b] if not len(sh[a]) or not len(sh[b]) else exact(sh[a], sh[b]) >= t
            if alike:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_estimate_and_exact_similarity():
    rng = random.Random(0)
    for _ in range(20):
        a = np.array([rng.randrange(60) for _ in range(80)], np.uint64)
        b = np.array([rng.randrange(20, 80) for _ in range(70)], np.uint64)
        want = exact(a, b)
        assert abs(D.probability_jaccard(a, b) - want) < 1e-9
        sketch = lambda x: D.probminhash(*np.unique(x, return_counts=True), 2048)
        assert abs(float((sketch(a) == sketch(b)).mean()) - want) < 0.06
    s = np.arange(50, dtype=np.uint64)
    assert D.probability_jaccard(s, s[:40]) == 0.8


def test_classes_equal_brute_force(spark):
    for seed in (0, 3):
        rows = corpus(seed)
        got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(frame(spark, rows)).collect()}
        assert got == classes(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = words(rng, 150, 10**6).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w), "en", "s", 1, "x", 1))
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)
    assert D.keep_one(frame(spark, rows)).count() == len(set(got.values()))


def test_nulls_and_empty(spark):
    rows = [(None, "a b c d e f", *[None] * 5), (4, "a b c d e f", *[None] * 5), (4, "a b c d e f", *[None] * 5), (6, None, *[None] * 5), (5, "", *[None] * 5)]
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in D.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4, 3), (4, 4, 3), (4, 4, 3), (5, 5, 2), (6, 5, 2)], key=str)
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_by_differences_hold():
    """J_P >= t if the sum of both texts' sure slack is enough, and only if that of the high slack is."""
    rng = random.Random(4)
    t = 0.8
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(40)]
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            b[rng.randrange(len(b))] = rng.randrange(60)
        b += [rng.randrange(30)] * rng.randrange(0, 3)
        (ca, cb), n = (Counter(a), Counter(b)), len(a) + len(b)
        apart = {(k, i) for k in {*ca, *cb} for i in range(max(ca[k], cb[k])) if i >= min(ca[k], cb[k])}
        later = sum(i > 0 for _, i in apart)
        sim = exact(np.array(a, np.uint64), np.array(b, np.uint64))
        if len(apart) <= (1 - t) * n / (1 + t) - 1e-9:
            assert sim >= t - 1e-9
        if sim >= t:
            assert len(apart) <= ((1 - t) * n + 2 * later) / (1 + t) + 1e-9


def test_near_copies_with_repeated_lines_equal_brute_force(spark):
    rng = random.Random(12)
    line = words(rng, 8, 10**6)
    rows = []
    for f in range(2):
        base = (line + " " + words(rng, 60, 10**6) + " " + line + " " + words(rng, 40, 10**6) + " " + line).split()
        for i in range(18):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(30))
            w += line.split() * rng.choice([0, 0, 0, 1, 2])
            rows.append((100 * f + i, " ".join(w), "en", "s", 1, "x", 1))
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_keep_one_and_null_ids(spark):
    text = "a b c d e f"
    rows = [(None, text, *[None] * 5)] * 3 + [(None, "g h", *[None] * 5)] * 2 + [(9, "g h", *[None] * 5)]
    kept = [(r["doc_id"], r["text"]) for r in D.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == [(9, "g h"), (None, text)]


def test_components_of_a_path_join_few_rows_a_round(spark, monkeypatch):
    """A path, a ring, a star and a loop, by rounds alone and with the driver's help; links go as rounds go on."""
    rng = random.Random(4)
    names = rng.sample(range(10**4, 10**6), 400)
    links = [(i, i + 1) for i in range(2000, 2200)] + [(x, y) for x, y in zip(names, names[1:] + names[:1], strict=True)]
    links += [(10**7 + i, 10**7) for i in range(100)] + [(-5, -5)]
    want = {**{i: 2000 for i in range(2000, 2201)}, **{10**7 + i: 10**7 for i in range(100)}, -5: -5}
    want |= dict.fromkeys(names, min(names))
    written = []
    keep = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, tag: written.append((tag, kept := keep(df, tag))) or kept)
    edges = spark.createDataFrame(links, "a long, b long")
    for few in (0, 10_000):
        assert {r["id"]: r["root"] for r in C.components(edges, few=few).collect()} == want
    drawn = [df.count() for tag, df in written if tag == "cc-e"]
    assert sum(drawn[:-1]) < 2 * len(links)
