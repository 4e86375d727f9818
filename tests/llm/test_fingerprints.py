import hashlib
import random

from kindred.llm import fingerprints as P
from pyspark.sql import functions as F

from .corpora import SCHEMA, corpus, frame, words


def test_edits_and_neighbours(spark):
    rows = corpus(1)
    out = {r["doc_id"]: r for r in P.fingerprint_edits(frame(spark, rows)).collect()}
    ids = sorted(out, reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    assert len(out) == len(rows)
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        m = len(text[i]) // 3
        edited = text[i][: len(text[i]) - m] + text[nxt][:m]
        assert out[i]["n_chars"] == len(text[i])
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same = lambda a, b: a == b and 1.0
        if edited == text[i]:
            assert out[i]["near_edited"] == same(out[i]["fingerprint"], out[i]["edited_fingerprint"]) == 1.0
        if text[i] == text[nxt]:
            assert out[i]["near_next"] == 1.0 and out[i]["fingerprint"] == out[nxt]["fingerprint"]
        assert 0 <= out[i]["near_next"] <= 1 and 0 <= out[i]["near_edited"] <= 1
    long = [i for i in ids if len(text[i].split()) > 150 and len(set(text[i].split())) > 100]
    assert sum(out[i]["near_edited"] > out[i]["near_next"] for i in long) > 0.9 * len(long)


def test_likeness_falls_with_edits_and_order(spark):
    rng = random.Random(8)
    base = words(rng, 400, 10**6).split()
    few, many = list(base), list(base)
    for k in range(0, 400, 100):
        few[k] = "x"
    for k in range(0, 400, 10):
        many[k] = "x"
    turned = base[200:] + base[:200]
    rows = [(" ".join(base), " ".join(o)) for o in (base, few, many, turned, words(rng, 400, 10**6).split())]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    df = df.withColumn("x", P.fingerprint("a")).withColumn("y", P.fingerprint("b"))
    got = [r[0] for r in df.select(P.likeness("x", "y")).collect()]
    assert got[0] == 1.0 and got[0] > got[1] > got[2] and got[1] > got[3] > got[4] and got[4] < 0.1


def test_repeats_count_by_occurrence_and_small_samples_are_exact(spark):
    one = "a b c d e f g h"
    df = spark.createDataFrame([(one,), (one + " " + one,), ("z " * 3000,), ("z " * 6000,), ("",), ("q" * 5000,)], "t string").coalesce(1)
    prints = [r[0] for r in df.select(P.fingerprint("t")).collect()]
    assert len(set(prints)) == 6 and all(len(p) == 8 * P.BINS for p in prints)
    assert prints[4].count("-" * 8) == P.BINS - 1


def test_nulls_ties_and_empty(spark):
    assert P.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "abc def", *[None] * 5), (1, None, *[None] * 5), (1, None, *[None] * 5), (2, "x", *[None] * 5)]
    out = P.fingerprint_edits(frame(spark, rows))
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in out.collect()) == [(0, 7), (1, 0), (1, 0), (2, 1)]
    assert P.fingerprint_edits(frame(spark, rows[:1])).filter(F.col("near_next") == 1).count() == 1


def _print_by_hand(text):
    """Order MinHash by its definition: (k-mer, occurrence) pairs, the smallest L of each bin in text order."""
    import re

    import xxhash

    def chain(*values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else v
            h = xxhash.xxh64_intdigest(raw, seed=h)
        return h

    pattern = P.TOKEN.replace("\\\\", "\\").replace("\\x{0250}", "\u0250").replace("\\x{10FFFF}", "\U0010ffff")
    pieces = re.findall(pattern, text, re.ASCII) or [""]
    seen, elements = {}, []
    for i in range(len(pieces)):
        kmer = chain(*pieces[i : i + P.K]) >> 28
        signed = kmer - (1 << 36) if kmer >> 35 else kmer
        seen[kmer] = n = seen.get(kmer, 0) + 1
        h = kmer if n == 1 else chain(signed.to_bytes(8, "little", signed=True), (n - 1).to_bytes(4, "little")) >> 28
        elements.append((h >> 31, h & (2**31 - 1), i, h))
    out = []
    for b in range(P.BINS):
        chosen = sorted((r, i, h) for own, r, i, h in elements if own == b)[: P.L]
        order = [h - (1 << 36) if h >> 35 else h for _, i, h in sorted(chosen, key=lambda x: x[1])]
        entry = f"{chain(*(h.to_bytes(8, 'little', signed=True) for h in order)):016x}"[-8:]
        out.append(entry if chosen else "-" * 8)
    return "".join(out)


def test_equals_order_minhash_by_its_definition(spark):
    rng = random.Random(2)
    texts = ["", "a b c", "the " * 900, words(rng, 30, 10), words(rng, 2000, 10**6), words(rng, 1500, 6), "日本語" * 200, "q" * 500, "x y " * 50 + words(rng, 100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["p"] for r in df.select("i", P.fingerprint("t").alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _print_by_hand(t), t[:40]


def test_texts_without_spaces_or_with_long_words_keep_their_likeness(spark):
    rng = random.Random(1)
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    cjk, plain = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000)), run(letters, 3000)
    long_words = " ".join(run(letters, 39) for _ in range(200))
    pairs = [(cjk, "x" + cjk), (plain, "q" + plain), (long_words, long_words + " " + "z" * 60)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", P.fingerprint("a")).withColumn("y", P.fingerprint("b"))
    assert all(r[0] > 0.9 for r in df.select(P.likeness("x", "y")).collect())
