"""Best-fit packing by bin completion, at any number of documents.

Texts are tokenised, closed by an end id, and cut into pieces of at most ``capacity`` tokens. The
number of pieces grows with the corpus, but the number of piece *lengths* is at most ``capacity``.
So the packing is solved over the histogram of lengths, which is all that reaches the driver:

1. best-fit decreasing in bulk (all pieces of one length at a time) gives the first incumbent;
2. if it needs more sequences than the bound ceil(tokens / capacity) shows, bin completion runs:
   depth first, each step takes the largest length left, enumerates its undominated fillings,
   least waste first, uses one as often as the counts allow, and drops a branch whose waste so far
   is more than an incumbent with one sequence less could have. A branch is finished by best fit,
   and that is an incumbent if it is better. ``max_nodes`` bounds the search, not the packing.

The result is a list of patterns with multiplicities. Pieces get their rank within their length by
a count per (length, bucket) and a window inside each bucket, so a length that a third of all pieces
have is ranked by many tasks, and the rank leads to a place by a lookup in the patterns' runs.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import KEPT, materialise

Pattern = tuple[tuple[int, int], ...]
#: (pattern as ((length, times), ...) with falling lengths, multiplicity)
Packing = list[tuple[Pattern, int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and (Martello and Toth's L2) by large pieces."""
    sizes = sorted(counts)
    best = -(-sum(s * c for s, c in counts.items()) // capacity)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        over = sum(counts[s] for s in sizes if s > capacity - k)
        half = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        small = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        free = sum((capacity - s) * counts[s] for s in half)
        best = max(best, over + sum(counts[s] for s in half) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over a histogram; work grows with lengths, not with pieces."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in open_:
            rooms.insert(bisect_left(rooms, room), room)
            open_[room] = []
        open_[room].append((pattern, n))

    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, n = capacity, (), left
            else:
                room = rooms[at]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            fit = room // size
            full = min(n, left // fit)
            if full:
                put(room - fit * size, (*pattern, (size, fit)), full)
                left -= full * fit
            if left and full < n and left < fit:
                put(room - left * size, (*pattern, (size, left)), 1)
                full, left = full + 1, 0
            if pattern and full < n:
                put(room, pattern, n - full)
    return [x for groups in open_.values() for x in groups]


def fillings(counts: dict[int, int], sizes: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """All undominated sets of pieces for ``room``, least waste first, then largest pieces first.

    A filling is dropped if an unused piece fits beside it, or if one of its pieces can be changed
    for a larger unused one that still fits (Martello and Toth's dominance for single pieces). The
    sums that the sizes from each one on can reach, as bits, keep the walk off dead ends.
    """
    sizes = [s for s in sizes if s <= room and counts[s]]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)
    for j in range(len(sizes) - 1, -1, -1):
        sums, left, step = reach[j + 1], min(counts[sizes[j]], room // sizes[j]), 1
        while left:
            step = min(step, left)
            sums |= (sums << step * sizes[j]) & mask
            left, step = left - step, 2 * step
        reach[j] = sums

    def sets(at: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while at < len(sizes):
            size = sizes[at]
            for times in range(min(counts[size], total // size), 0, -1):
                if reach[at + 1] >> (total - times * size) & 1:
                    for rest in sets(at + 1, total - times * size):
                        yield (size,) * times + rest
            at += 1
            if not reach[at] >> total & 1:
                return

    least = None
    for waste in range(room + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        least = waste if least is None else least
        for chosen in sets(0, room - waste):
            if waste > least:
                used = Counter(chosen)
                if any(s <= waste and counts[s] > used[s] for s in sizes):
                    continue
                if any(s < t <= s + waste and counts[t] > used[t] for s in used for t in sizes):
                    continue
            yield chosen


def bin_completion(counts: dict[int, int], capacity: int, max_nodes: int | None = None) -> Packing:
    """Bin completion branch-and-bound with best-fit incumbents; optimal if the search ends in time.

    Without ``max_nodes`` the search has 200 nodes and eight more a length.
    """
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit(counts, capacity)
    max_nodes = 200 + 8 * len(counts) if max_nodes is None else max_nodes
    goal, total = lower_bound(counts, capacity), sum(s * c for s, c in counts.items())
    need = lambda p: sum(n for _, n in p)
    if need(best) == goal:
        return best

    def branches(left: dict[int, int]) -> Iterator[tuple[Pattern, int]]:
        first = max(left)
        after = left | {first: left[first] - 1}
        sizes = sorted((s for s, c in after.items() if c), reverse=True)
        for filling in fillings(after, sizes, capacity - first):
            pattern = tuple(sorted(Counter((first, *filling)).items(), reverse=True))
            often = min(left[s] // n for s, n in pattern)
            for times in dict.fromkeys((often, 1)):
                yield pattern, times

    def use(pattern: Pattern, times: int) -> None:
        for s, n in pattern:
            left[s] = left.get(s, 0) - times * n
            if not left[s]:
                del left[s]

    # One node's counts are kept, and per level only the number of its branch, which is listed
    # again on the way back: a search may be thousands of levels deep.
    left, nodes, used, waste = dict(counts), 0, 0, 0
    done: Packing = []
    tried = [0]
    while tried and nodes < max_nodes:
        if not tried[-1]:
            nodes += 1
            rest = best_fit(left, capacity)
            if used + need(rest) < need(best):
                best = done + rest
                if need(best) == goal:
                    break
        step = None
        for pattern, times in islice(branches(left), tried[-1], None) if left else ():
            tried[-1] += 1
            lost = times * (capacity - sum(s * n for s, n in pattern))
            if waste + lost <= (need(best) - 1) * capacity - total:
                step = pattern, times
                break
        if step:
            use(*step)
            done.append(step)
            used, waste = used + times, waste + lost
            tried.append(0)
        else:
            tried.pop()
            if done:
                pattern, times = done.pop()
                use(pattern, -times)
                used, waste = used - times, waste - times * (capacity - sum(s * n for s, n in pattern))
    return best


def runs(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: (first rank, first sequence, offset, times per sequence) of its runs, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    base = 0
    for pattern, n in packing:
        offset = 0
        for size, times in pattern:
            out.setdefault(size, []).append((given[size], base, offset, times))
            given[size] += n * times
            offset += size * times
        base += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


class CachedTokenizer:
    """Ids of a Hugging Face tokenizer whose tokens never cross white space, by cached chunks.

    A chunk between white space is encoded once and kept; a text is the chunks' ids in order, which
    equals encoding it whole. Of a chunk that ends in a full stop or comma behind a letter or digit the rest
    is encoded, as the stop is a token of its own. Chunks of Latin letters alone are one word to the tokenizers of
    ``_PLAIN``, so its model gets them at once. The cache has two generations: when the young one is
    full it becomes the old one, and what is met again is taken over, so common words stay.
    """

    #: What the tokenizers' \\s is; str.split() also splits at \\x1c-\\x1f.
    _SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
    _ODD = re.compile("[\x1c-\x1f]")
    _MARK = "\x01"
    _LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    #: Normalizer and pre-tokenizer by which a chunk of such letters, in lower case and as bytes, is a word of the model.
    _PLAIN = (
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    )

    def __init__(self, path: str, room: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner, self.young, self.old, self.room = Tokenizer.from_file(path), {}, {}, room
        self.mark = self._only(self._MARK)
        self.stops = {c: self._bytes_of(c) for c in ".,"}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kinds = tuple((told.get(k) or {}).get(n) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = kinds == self._PLAIN and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
        plain = plain and not any(self._LETTERS.fullmatch(x["content"]) for x in told.get("added_tokens") or ())
        self.model = self.inner.model if plain else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.raw = [i.to_bytes(4, "little") for i in range(self.inner.get_vocab_size())] if plain else []

    def _bytes_of(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _only(self, text: str) -> bytes | None:
        ids = self._bytes_of(text)
        return ids if len(ids) == 4 else None

    def chunks(self, text: str) -> list[str]:
        return [x for x in self._SPACE.split(text) if x] if self._ODD.search(text) else text.split()

    def _encode(self, chunks: list[str]) -> None:
        """Encode new chunks in one text, with a mark between them whose id no other text has."""
        marked = [c for c in chunks if self._MARK not in c] if self.mark is not None else []
        if marked:
            ids = self._bytes_of(f" {self._MARK} ".join(marked))
            cuts = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == int.from_bytes(self.mark, "little"))).tolist()
            for c, start, end in zip(marked, [-4, *cuts], [*cuts, len(ids)], strict=True):
                self.young[c] = ids[start + 4 : end]
        for c in chunks:
            if c not in self.young:
                self.young[c] = self._bytes_of(c)

    def _learn(self, chunks: Iterable[str]) -> None:
        """Take new chunks into the young generation."""
        young, old, raw, model = self.young, self.old, self.raw, self.model
        stopped, others = [], []
        for c in chunks:
            got = old.get(c)
            if got is not None:
                young[c] = got
            elif c[-1] in ".," and c[-2:-1].isalnum():
                stopped.append(c)
            elif model is not None and self._LETTERS.fullmatch(c):
                low = c.lower() if c.isascii() else c.lower().translate(self.as_bytes)
                young[c] = b"".join([raw[t.id] for t in model.tokenize(low)])
            else:
                others.append(c)
        for at in range(0, len(others), 4096):
            self._encode(others[at : at + 4096])
        if stopped:
            self._learn({c[:-1] for c in stopped}.difference(young))
            for c in stopped:
                young[c] = young[c[:-1]] + self.stops[c[-1]]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = self.chunks(text)
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            pass
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        self._learn(set(words).difference(self.young))
        return b"".join(map(self.young.__getitem__, words))


def tokenizer_at(path: str) -> CachedTokenizer:
    """One per worker process, until another operator's tasks let it go."""
    if ("tokenizer", path) not in KEPT:
        KEPT["tokenizer", path] = CachedTokenizer(path)
    return KEPT["tokenizer", path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, width = tokenizer_at(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tok.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def place(cut: DataFrame, capacity: int = 2048, max_nodes: int | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``cut`` must be a written table.

    Only the histogram of lengths (at most ``capacity`` rows) is collected.
    """
    spark = cut.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    table = runs(bin_completion(counts, capacity, max_nodes))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = per.select("length", "bucket", before.alias("before"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            kinds, first = np.unique(size[order], return_index=True)
            for s, rows in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
                starts, base, at, times = table[s]
                k = np.searchsorted(starts, rank[rows], "right") - 1
                nth = rank[rows] - starts[k]
                sequence[rows] = base[k] + nth // times[k]
                offset[rows] = at[k] + nth % times[k] * s
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, (F.col("before") + F.col("nth") - 1).alias("rank")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Pack all rows of ``docs``: one row per piece with its sequence and its place there.

    Null text is the empty text (its piece is the end id alone). Rows that repeat an id are
    documents of their own. Null ids are kept. An empty table gives no row. Extra columns are not
    read.
    """
    return place(materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, **options)
