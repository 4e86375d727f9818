"""Small corpora with copies, near copies, shared passages, ties, nulls and odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, same string, key int"


def words(rng, n, size=400):
    return " ".join("w" + format(rng.randrange(size), "x") + rng.choice(["", "", "é", "."]) for _ in range(n))


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 8, 60, 200, 400]), 50_000) for _ in range(n)]
    passage = words(rng, 80, 50_000)
    base = texts[2] + " " + words(rng, 120, 50_000)
    for i in range(0, n, 6):
        texts[i] += " " + passage + " " + words(rng, 30, 50_000)
    for i in range(1, n, 9):
        edited = base.split()
        edited[rng.randrange(len(edited))] = "changed" + str(i)
        texts[i] = " ".join(edited)
    for i in range(3, n, 10):
        texts[i] = texts[4]
    texts += [None, "", "", " \n ", "a", "ab " * 700, "x" * 3000, "the same line\n" * 40, "日本語テキスト" * 30, texts[0].upper()]
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
