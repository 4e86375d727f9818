import random
from collections import Counter

import numpy as np
import pytest
from kindred.llm import packing as P

from .corpora import SCHEMA, corpus, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[i]}):
            k = rooms.index(room)
            place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_inputs():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 20, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        packed = P.bin_completion(counts, capacity)
        got = Counter()
        for pattern, n in packed:
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                got[s] += k * n
        assert got == counts
        best = brute(list(counts.elements()), capacity)
        assert P.lower_bound(counts, capacity) <= best == sum(n for _, n in packed)


def test_cached_ids_equal_the_tokenizer():
    tok = P.CachedTokenizer(PATH, room=50)
    texts = [r[1] or "" for r in corpus(3)] + ["it's, ok... U.S.A., x², a_b. ., <|endoftext|>. a\x01b \x1c y", "Σας, ΟΔΟΣ. İx", "é́ à,\n1,5. 3.", "\x85a\xa0b　c"]
    for t in texts * 2:
        want = tok.inner.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == want, t


def test_words_of_latin_letters_go_to_the_model_alone():
    rng = random.Random(8)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", ","]) for _ in range(3000)]
    words += [chr(c) for c in (*range(65, 91), *range(0xC0, 0x100))] + ["ªº", "µm", "İx", "STRAẞE", "e\u0301.", "s", "don't", "x_.", "5.", "a.,", "²,"]
    text = " ".join(words)
    tok = P.CachedTokenizer(PATH, room=500)
    assert np.frombuffer(tok.ids(text), "<u4").tolist() == tok.inner.encode(text, add_special_tokens=False).ids

    class Spy:
        def encode(self, text, **_):
            raise AssertionError(text[:80])

    tok = P.CachedTokenizer(PATH)
    tok.inner = Spy()
    assert tok.ids("Ein schöner Tag, été FAÇADE. Qwzx") and len(tok.young) == 8


def test_pieces_are_placed_once_without_gaps(spark):
    rows = corpus(4) + [(500, "word " * 5000, "en", "s", 1, "x", 1), (500, "word " * 5000, "en", "s", 1, "x", 1), (None, "a b", None, None, None, None, None)]
    out = P.pack(frame(spark, rows), PATH, capacity=256).collect()
    tok = P.CachedTokenizer(PATH)
    want = Counter()
    for r in rows:
        ids = np.frombuffer(tok.ids(r[1] or ""), "<u4").tolist() + [0]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], "<u4").tobytes()
            want[r[0], k // 256, k, len(part) // 4, __import__("zlib").crc32(part)] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    counts = Counter(r["length"] for r in out)
    assert len(by) <= P.lower_bound(counts, 256) + 1
    assert P.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_fillings_are_all_undominated_ones_least_waste_first():
    rng = random.Random(6)
    for _ in range(60):
        room = rng.randint(5, 30)
        counts = Counter(rng.randint(1, 12) for _ in range(9))
        sizes = sorted(counts, reverse=True)
        sets = {()}
        for s in sizes:
            sets = {(*x, *[s] * k) for x in sets for k in range(counts[s] + 1) if sum(x) + k * s <= room}
        want = set()
        for x in sets:
            used, waste = Counter(x), room - sum(x)
            free = [s for s in sizes if counts[s] > used[s]]
            if not any(s <= waste for s in free) and not any(s < t <= s + waste for s in used for t in free):
                want.add(x)
        got = list(P.fillings(counts, sizes, room))
        assert set(got) == want and len(got) == len(want)
        assert [sum(x) for x in got] == sorted((sum(x) for x in got), reverse=True)


def test_fillings_reach_the_exact_one_behind_many_dominated_sizes():
    counts = {s: 40 for s in range(600, 901)}
    assert next(P.fillings(counts, sorted(counts, reverse=True), 2048 - 848)) == (600, 600)


def test_bin_completion_improves_on_best_fit_over_many_lengths():
    counts = {s: 5 for s in range(300, 701)}
    count = lambda packing: sum(n for _, n in packing)
    packed = P.bin_completion(counts, 2048)
    got = Counter()
    for pattern, n in packed:
        assert sum(s * k for s, k in pattern) <= 2048
        got.update({s: k * n for s, k in pattern})
    assert got == counts
    assert P.lower_bound(counts, 2048) == 490 and count(P.best_fit(counts, 2048)) == 513 and count(packed) <= 496
