import hashlib
import random

import numpy as np
import pytest
from kindred.llm import suffix_dedup as S

from .corpora import SCHEMA, corpus, frame


def brute(rows, length=50):
    """First id of every window; a window of a larger id is removed."""
    data = [(i, (r[1] or "").encode()) for r in rows if (i := r[0]) is not None or True]
    first = {}
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = S.remove_repeats(frame(spark, rows), bucket_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_nulls_ties_and_empty(spark):
    text = "0123456789" * 6
    rows = [(None, text, None, None, None, None, None), (5, text, None, None, None, None, None), (5, text, None, None, None, None, None), (9, text + "!", None, None, None, None, None)]
    got = S.remove_repeats(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_is_a_sorted_merge_with_right_prefixes():
    rng = random.Random(3)
    runs, every = [], []
    for k in range(5):
        keys = sorted({bytes(rng.choice(b"ab") for _ in range(S._KEY)) if rng.random() < 0.5 else bytes([97] * 40 + [rng.choice(b"abc") for _ in range(S._KEY - 40)]) for _ in range(30 * k)})
        every += keys
        m = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), S._KEY)
        runs.append(S.Run(S.front_code(m, np.zeros(len(keys)), np.zeros(len(keys)))))
    out, before = [], None
    for r, prefix in S.merge(runs):
        key = runs[r].key
        if before is not None:
            want = next((i for i in range(S._KEY) if key[i] != before[i]), S._KEY)
            assert prefix == want
        out.append(key)
        before = key
    assert out == sorted(every)


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, y = part(400), part(500)
    rows = [(1, a, *[None] * 5), (5, part(50) + a + part(50), *[None] * 5), (5, y, *[None] * 5), (5, part(200) + y[:100], *[None] * 5)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 400, 0), (5, 300, 0), (5, 500, 0), (5, 500, 400)]
