import math

import pytest
from kindred.functions import keys as K, metrics as M, sketch, text as T
from pyspark.sql import functions as F


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_set_metrics(spark):
    rows = [("night", "nacht"), ("context", "contact"), ("ht", "nacht"), ("", ""), ("abc", ""), ("abc", "abcde"), (None, "a")]
    x, y = M.chars("a"), M.chars("b")
    got = values(spark, rows, "a string, b string", M.jaccard_similarity(x, y), M.overlap_coefficient(x, y), M.binary_cosine_similarity(x, y), M.dice_coefficient(x, y))
    assert [g[0] for g in got[:6]] == pytest.approx([3 / 7, 4 / 7, 2 / 5, 1.0, 0.0, 3 / 5])
    assert got[3][1:] == (1.0, 0.0, 1.0) and got[4][1:] == (0.0, 0.0, 0.0) and got[5][1] == 1.0
    b = [("healed", "sealed", 0.8), ("healed", "healthy", 6 / 11), ("healed", "heard", 4 / 9), ("h", "g", 0.0)]
    got = values(spark, b, "a string, b string, e double", M.dice_coefficient(T.bigrams("a"), T.bigrams("b")), "e")
    assert all(math.isclose(g, e) for g, e in got)


def test_sparse_metrics(spark):
    rows = [({"0": 1.0, "1": 3.0}, {"0": 4.0, "1": 5.0}), ({}, {}), ({"0": 2.0}, {"0": 4.0}), ({"0": 0.0}, {"0": 0.0})]
    got = values(spark, rows, "a map<string,double>, b map<string,double>", M.sparse_cosine_similarity("a", "b"), M.weighted_jaccard_similarity("a", "b"))
    assert got[0][0] == pytest.approx(0.94, abs=0.005) and got[1] == (0.0, 0.0) and got[2] == (1.0, 0.5) and got[3] == (0.0, 0.0)
    n = values(spark, [({"A": 34.0, "B": 78.0, "C": -16.0},)], "a map<string,double>", M.sparse_normalize("a"))[0][0]
    assert n == pytest.approx({"A": 0.3927, "B": 0.9009, "C": -0.1848}, abs=1e-4)
    words = F.split("a", " "), F.split("b", " ")
    got = values(spark, [("the cat sat on the mat", "the cat sat on a mat")], "a string, b string", M.cosine_similarity(*words))
    assert got[0][0] == pytest.approx(0.866, abs=0.01)
    counts = values(spark, [("contexte", "contact"), ("contexte", "contactant")], "a string, b string", M.weighted_jaccard_similarity(M.frequencies(M.chars("a")), M.frequencies(M.chars("b"))))
    assert [c[0] for c in counts] == pytest.approx([0.5, 0.385], abs=0.001)


def test_edit_distances(spark):
    rows = [("book", "back", 2), ("sturgeon", "urgently", 6), ("levenshtein", "frankenstein", 6), ("good sir", "baal", 8), ("aa", "abc", 2)]
    got = values(spark, rows, "a string, b string, e int", M.levenshtein_distance("a", "b"), M.limited_levenshtein_distance(2, "a", "b"), "e")
    assert all(d == e and k == min(e, 3) for d, k, e in got)
    words = [("BONJOUR", "BONJOUR", 1, 1), ("BONJOUR", "BNOJOUR", 0, 1), ("BONJOUR", "OBNJOUR", 0, 1), ("BONJOUR", "ONJOUR", 1, 1), ("BONJOUR", "BONJOURES", 0, 0), ("abc", "bca", 0, 0), ("", "", 1, 1), ("a", "b", 1, 1), ("ab", "ba", 0, 1)]
    got = values(spark, words, "a string, b string, x int, y int", M.levenshtein_distance_lte1("a", "b").cast("int"), M.damerau_levenshtein_distance_lte1("a", "b").cast("int"), "x", "y")
    assert all((p, q) == (x, y) for p, q, x, y in got)


def test_text(spark):
    one = lambda s, c: values(spark, [(s,)], "s string", c)[0][0]
    assert one("Ellement", T.squeeze("s")) == "Element" and one("GGgrr", T.squeeze("s")) == "Ggr"
    assert one("King Setis XXII", T.squeeze("s")) == "King Setis XI" and one("King Setis XXII", T.squeeze("s", True)) == "King Setis XXII"
    assert one("Bonjour", T.ngrams(4, "s")) == ["Bonj", "onjo", "njou", "jour"] and one("yop", T.ngrams(5, "s")) == ["yop"]
    assert one("", T.ngrams(2, "s")) == [""] and one("Bonjour", T.join_ngrams(T.trigrams("s"))) == "Bonjour"
    assert one("The mouse is a mouse", T.fingerprint("s")) == "a is mouse the"
    assert one("« très bien ! »", T.fingerprint("s")) == "bien tres" and one("\x00Hello", T.fingerprint("s")) == "hello"
    assert one("maïß", T.fold("s")) == "maiss" and one("électricité", T.fold("s")) == "electricite"
    assert one("Paris", T.ngrams_fingerprint(2, "s")) == "arispari" and one("bébé", T.ngrams_fingerprint(2, "s")) == "beeb"
    assert one("PariS", T.ngrams_fingerprint(3, "s")) == "ariparris" and one("Paris", T.ngrams_fingerprint(1, "s")) == "aiprs"
    assert one("looooool", T.reduce_lengthening("s")) == "loool"


HELLO = "hello !ello h!llo he!lo hel!o hell! !hello h!ello he!llo hell!o hello!".split()


def test_keys(spark):
    one = lambda s, c: values(spark, [(s,)], "s string", c)[0][0]
    omission = {"hello": "HLEO", "Christopher": "PHCTSRIOE", "cœlomic": "MCLOEI", "Carlson": "CLNSRAO", "": ""}
    skeleton = {"hello": "HLEO", "Chemically": "CHMLYEIA", "chemomagnetic": "CHMGNTEOAI", "": ""}
    for s, e in omission.items():
        assert one(s, K.omission_key("s")) == e
    for s, e in skeleton.items():
        assert one(s, K.skeleton_key("s")) == e
    assert sorted(one("hello", K.levenshtein_1d_keys("s", flag="!"))) == sorted(HELLO)
    assert set(one("hello", K.levenshtein_1d_keys("s", True, "!"))) == {*HELLO, "ehllo", "hlelo", "helol"}
    assert one("", K.levenshtein_1d_keys("s", flag="!")) == ["", "!"]
    family = ["BONJOUR", "BINJOUR", "BONTOUR", "NONJOUR", "ONJOUR", "BONJOU", "BONJOURE", "BONTJOUR", "TBONJOUR", "BONJUR"]
    blocks = {w: set(one(w, K.levenshtein_1d_blocks("s"))) for w in family}
    assert all(blocks[w] & blocks["BONJOUR"] for w in family)
    swaps = ["OBNJOUR", "BNOJOUR", "BOJNOUR", "BONOJUR", "BONJUOR", "BONJORU"]
    base = set(one("BONJOUR", K.damerau_levenshtein_1d_blocks("s")))
    assert all(base & set(one(w, K.damerau_levenshtein_1d_blocks("s"))) for w in swaps)
    two = lambda w: set(one(w, K.levenshtein_2d_blocks("s")))
    for a, b in (("abcdef", "abcxyf"), ("abcdefg", "bcdefgh"), ("abcdefgh", "abdefg"), ("abcdef", "abcdefgh")):
        assert two(a) & two(b), (a, b)
    assert one("smith", K.ngram_keys(2, "s")) == ["smmiitth", "smmiit", "smmith", "smitth", "miitth"]
    assert one("smith", K.ngram_keys(2, "s", 1.0)) == ["smmiitth"] and len(one("smith", K.ngram_keys(2, "s", 0.7))) == 11


def test_phonetics(spark):
    one = lambda s, c: values(spark, [(s,)], "s string", c)[0][0]
    for s, e in {"Müller-Lüdenscheidt": "65752682", "Wikipedia": "3412", "Xavier": "4837", "Mac": "68", "Mack": "64", "45639": ""}.items():
        assert one(s, K.cologne("s")) == e, s
    for s, e in {"Tchekov": "ʃkf", "Ekaterina": "jktrn", "Youri": "jr", "Aleksandr": "alxndr", "hh": ""}.items():
        assert one(s, K.rusalka("s")) == e, s


def test_sketches(spark):
    pairs = [("abcdefghijklmnop", "abcdefghijklmnop"), ("abcdefghijklmnopqrst", "abcdefghijklmnopqruv"), ("abcdefgh", "stuvwxyz")]
    x, y = M.chars("a"), M.chars("b")
    got = values(spark, pairs, "a string, b string", M.jaccard_similarity(x, y), M.minhash_similarity(sketch.minhash(x, 256), sketch.minhash(y, 256)), M.lsb_minhash_similarity(sketch.lsb_minhash(x, 8), sketch.lsb_minhash(y, 8)), M.minhash_similarity(sketch.super_minhash(x, 256), sketch.super_minhash(y, 256)), M.simhash_similarity(sketch.simhash(x), sketch.simhash(y)))
    for exact, *estimates in got:
        assert all(abs(exact - e) < 0.13 for e in estimates[:3])
    assert got[0][4] == 1.0 and got[2][4] < 0.7
    assert values(spark, [([],)], "a array<string>", sketch.minhash("a", 4))[0][0] == [0] * 4
    assert sketch.guess_bands(256, 0.8) == 20 and sketch.is_power_of_two(8) and not sketch.is_power_of_two(6)
    with pytest.raises(ValueError):
        sketch.guess_bands(4, 0.01)
