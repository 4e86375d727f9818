import random
import re

from kindred.llm import licenses as L

from .corpora import SCHEMA, corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = [(i, label) for p, label in L.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(2)
    bits = ["GNU General", "Public License", "gnu general public license", "Apache", "License", "apache license", "CC", "BY", "cc by", "MIT license", "mit", "the", "É", "x1", "Version 2.0"]
    made = [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    return made + [*L.TEMPLATES.values(), "", None, "CC-BY cc_by cc BY", "Apache\nLicense apache\x00license"]


def test_base_places_equal_brute_force():
    scanner = L.LicenseScanner()
    for t in texts():
        f = scanner.scan(t)
        starts = [s for s, _ in f.base]
        got = (f.n_words, len(f.base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in f.base})))
        assert got == brute(t), t


def test_automaton_gives_matching_statistics():
    rng = random.Random(6)
    seqs = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    a = L.SuffixAutomaton()
    for n, s in enumerate(seqs):
        a.add(s, n)
    subs = {tuple(s[i:j]) for s in seqs for i in range(12) for j in range(i + 1, 13)}
    for text in ([rng.randrange(3) for _ in range(40)] for _ in range(30)):
        state = length = 0
        for i, x in enumerate(text):
            while state and x not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if x in a.next[state]:
                state, length = a.next[state][x], length + 1
            want = max(k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in subs)
            assert length == want


def test_templates_with_gaps_are_covered_and_clean_text_is_not():
    scanner = L.LicenseScanner()
    for label, t in L.TEMPLATES.items():
        words = t.split()
        words[len(words) // 2] = "CHANGED"
        f = scanner.scan("some words before " + " ".join(words) + " and words after it")
        assert label in {s[2] for s in f.spans}
        start, end = next((s[0], s[1]) for s in f.spans if s[2] == label)
        assert start <= 4 and end >= f.n_words - 5
    assert not scanner.scan("a licence is a text, and the software is not in it. use it as you like").spans


def test_matches_of_every_template_equal_brute_force():
    rng = random.Random(8)
    names = ["a", "b", "c"]
    for _ in range(20):
        templates = {f"t{n}": " ".join(rng.choice(names) for _ in range(14)) for n in range(4)}
        scanner = L.LicenseScanner(templates, {"a b": "p"}, min_match=3)
        words = [rng.choice([*names, "x"] if rng.random() < 0.2 else names) for _ in range(60)]
        got = scanner.matches([w.encode() for w in words], [])
        for t, template in enumerate(templates.values()):
            v = template.split()
            longest = lambda i: max(k for k in range(i + 1) if k == 0 or any(v[j - k : j] == words[i - k : i] for j in range(k, 15)))  # noqa: B023, E731
            ends = [longest(i) for i in range(len(words) + 1)] + [0]
            want = [(i, n) for i, n in enumerate(ends[:-1]) if n >= 3 and ends[i + 1] != n + 1]
            assert [(end, size) for end, size, _ in got.get(t, [])] == want
            for end, size, places in got.get(t, []):
                assert places == [j - 1 for j in range(size, 15) if v[j - size : j] == words[end - size : end]]


def test_words_that_templates_share_count_for_each():
    """A template is found although most of its matches also stand in another one."""
    scanner = L.LicenseScanner(min_match=3)
    for label, t in L.TEMPLATES.items():
        words = t.split()
        words[4::5] = ["changed"] * len(words[4::5])
        assert label in {s[2] for s in scanner.scan(" ".join(words)).spans}
    twins = L.LicenseScanner({"one": "p q r s t u v w", "two": "p q r s t u v z"})
    assert {s[2] for s in twins.scan("p q r s t u v").spans} == {"one", "two"}


def test_very_long_texts_and_repeated_rows(spark):
    long = [("the software " * 80_000) + L.TEMPLATES["isc"], "x" * 1_000_000, "0" * 500_000 + "." * 500_000 + " MIT license", ""]
    rows = [(1, long[0], "en", "s", 1, "x", 1), (2, long[1], "en", "s", 1, "x", 1), (2, long[2], "en", "s", 1, "x", 1), (None, long[3], "en", "s", 1, "x", 1), (None, None, "en", "s", 1, "x", 1)]
    out = [(r["doc_id"], r["n_words"], r["labels"]) for r in L.scan_licenses(frame(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, 160_000 + len(L.words_of(L.TEMPLATES["isc"])), "isc"), (2, 1, ""), (2, 3, "mit"), (None, 0, ""), (None, 0, "")], key=str)


def test_frame(spark):
    rows = corpus(0) + [(900, L.TEMPLATES["mit"] + " MIT License", "en", "s", 1, "x", 1)]
    out = {r["doc_id"]: r for r in L.scan_licenses(frame(spark, rows)).collect()}
    assert len(out) == len(rows) and out[900]["labels"] == "mit" and out[900]["n_base"] == 1 and out[900]["score"] == 1.0
    assert all((r["n_words"], r["n_base"]) == brute(t)[:2] for i, t, *_ in rows for r in [out[i]])
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
