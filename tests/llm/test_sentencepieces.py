import random

import pytest
from kindred.llm import sentencepieces as S

from .corpora import SCHEMA, corpus, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "", " ", "Hello world", "  two  spaces  ", "naïve café über", "日本語テキスト", "tabs\tand\nlines", "emoji 🙏🏽 x",
    "the of and therelation anotherthing", "a" * 50, "x▁y", "Erenth*** oned### lyannt$$$", "1234567 89.01",
]


def as_unigram():
    """The model with its type set to unigram: same pieces and scores, the library's Viterbi."""
    with open(PATH, "rb") as f:
        data = f.read()
    out, at = b"", 0
    while at < len(data):
        tag, body = S._varint(data, at)
        size, body = S._varint(data, body)
        if tag >> 3 == 2:
            spec, k, new = data[body : body + size], 0, b""
            while k < len(spec):
                t, b = S._varint(spec, k)
                if t & 7 == 0:
                    v, e = S._varint(spec, b)
                elif t & 7 == 2:
                    n, b2 = S._varint(spec, b)
                    e = b2 + n
                else:
                    e = b + {1: 8, 5: 4}[t & 7]
                new += bytes([t, 1]) if t >> 3 == 3 else spec[k:e]
                k = e
            size_bytes, n = b"", len(new)
            while n > 127:
                size_bytes += bytes([n & 127 | 128])
                n >>= 7
            out += data[at : at + 1] + size_bytes + bytes([n]) + new
        else:
            out += data[at : body + size]
        at = body + size
    return out


def random_texts():
    rng = random.Random(4)
    parts = ["the", "tion", "er", "ou", "le", "é", "ß", " ", " ", " ", "and", "q", "1", ".", "over", "ing", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("how", ["unigram", "bpe"])
def test_equals_the_library(how):
    library = sentencepiece.SentencePieceProcessor(
        model_proto=as_unigram() if how == "unigram" else open(PATH, "rb").read()
    )
    e = S.Encoder(PATH, how)
    for t in [*(x for x in TEXTS if "▁" not in x), *random_texts()]:
        # the library's lattice search; its faster encode() loses score to rounding with this model
        want = library.encode(t) if how == "bpe" else (library.nbest_encode_as_ids(t, 2) or [[]])[0]
        got = e.encode(t)
        if how == "unigram" and want != got:  # equal best scores may be split differently
            score = lambda ids: sum(e.unknown_score if e.model.types[i] == S.BYTE else e.model.scores[i] for i in ids)
            # the library adds in single precision, which is coarse beside the unknown score
            assert score(got) >= score(want) - 1e-3 * len(want), t
            assert score(got) < -1e6 or abs(score(want) - score(got)) < 1e-3 * len(want), t
        else:
            assert want == got, t


def test_round_trip_and_report(spark):
    e = S.Encoder(PATH)
    for t in TEXTS + random_texts():
        assert e.decode(e.encode(t)) == t.replace("▁", " ")
    rows = corpus(1)
    out = S.encode_report(frame(spark, rows), PATH).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    back = S.decode(S.encode(frame(spark, rows), PATH), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r[0]: r[1] or "" for r in rows}
    assert S.encode_report(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_automaton_follows_output_links():
    a = S.Automaton({"he": 0, "she": 1, "hers": 2, "e": 3})
    s = 0
    for ch in "she":
        s = a.step(s, ch)
    found, at = [], s
    while at:
        found.append(a.out[at])
        at = a.up[at]
    assert found == [1, 0, 3]
