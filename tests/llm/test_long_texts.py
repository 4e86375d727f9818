"""Very long texts with and without words, spaces and digits, and columns with clashing names, through every operator and stage."""

import random

import pytest
from kindred.llm import exact_dedup, fingerprints, licenses, minhash_dedup, packing, sentencepieces, substring_dedup, suffix_dedup, toxicity

N = 200_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, times int, _d int, _digest int, _n int, _id int, _spans int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(5000):x}" for _ in range(N // 6))
    return {
        1: "a" * N, 2: "".join(rng.choice("abcdefgh") for _ in range(N)), 3: base, 4: base[: N // 2] + " changed " + base[N // 2 :],
        5: "日本語テキスト" * (N // 20), 6: "0" * N, 7: "." * N, 8: " " * N, 9: "you idiot " * (N // 10), 10: "\n" * N, 11: "a1" * (N // 2),
        12: "", 13: None, 14: base,
    }


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, 1, 1, 1, 1, 1) for i, t in texts.items()]
    path = f"file://{tmp_path_factory.mktemp('long')}/docs"
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([rng.choice(["some", "plain", "words"]) for _ in range(30)] + ["grubbel"] * (i % 2 * 3)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.fit_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def by_id(df):
    found = {r["doc_id"]: r for r in df.collect()}
    assert len(found) == 14
    return found


def test_reports_give_a_row_per_document(docs, model, texts):
    exact = by_id(exact_dedup.exact_dedup(docs))
    assert [i for i, r in exact.items() if not r["kept"]] in ([3, 12], [12, 3])
    near = by_id(minhash_dedup.near_duplicates(docs))
    assert set(near) == set(texts)
    suffix = by_id(suffix_dedup.remove_repeats(docs))
    assert suffix[14]["n_removed"] == suffix[14]["n_bytes"] and suffix[3]["n_removed"] == 0
    assert all(r["n_bytes"] == len((texts[i] or "").encode()) for i, r in suffix.items())
    by_id(substring_dedup.report(docs))
    scores = by_id(toxicity.score(docs, model))
    assert all(0 <= r["score"] <= 1 for r in scores.values())
    by_id(licenses.scan_licenses(docs))
    likeness = by_id(fingerprints.fingerprint_edits(docs))
    assert all(r["n_chars"] == len(texts[i] or "") and 0 <= r["near_edited"] <= 1 for i, r in likeness.items())
    assert likeness[4]["near_next"] > 0.9


def test_stages_keep_the_columns(docs, model):
    stages = (lambda: toxicity.keep_clean(docs, model), lambda: exact_dedup.keep_first(docs), lambda: minhash_dedup.keep_one(docs), lambda: substring_dedup.cut_repeats(docs))
    for stage in stages:
        out = stage()
        assert out.columns == docs.columns and out.filter("_digest <> 1 OR times <> 1").isEmpty()
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).select("doc_id").collect()} == set(range(1, 15)) - {3, 12}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(docs).select("doc_id", "text").collect()}
    assert 3 in cut and 4 not in cut and 14 not in cut


def test_tokens_of_long_texts(docs, texts):
    public = pytest.importorskip("public_tokenizers")
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    got = {}
    for r in packing.pack(docs, public.path("word_bpe_49k.json"), 2048, 0).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    by_id(sentencepieces.encode_report(docs, public.path("piece_bpe_32k.model")))
