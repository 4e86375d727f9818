"""Suffix-array dedup: byte strings of ``LENGTH`` that also start in a document with a smaller id.

Texts are dealt into buckets of a few MB. Which suffixes are sorted is chosen by their content: every
window of ``LENGTH`` bytes has an anchor, the leftmost smallest of its k-mers' hashes, so equal windows
have equal anchors, and about one position in sixteen is an anchor. Then:

1. Buckets send the sorted, delta-coded hashes of their anchors' k-mers; a k-mer seen in one text
   only cannot begin a repeat, so only anchors that come back are sorted at all. This loses nothing:
   a hash collision can only let a suffix through that then finds no partner.
2. A bucket sorts the suffixes at these anchors (with the bytes before the anchor, read backwards,
   as the second part of the key), merges equal keys to one item with its smallest and largest id,
   and exchanges them as front-coded runs: common prefix length, then the rest.
3. Runs of one part of the k-mers are merged by a loser tree that knows each candidate's common
   prefix with the last output: of two candidates the one with the longer prefix is smaller, and only
   equal prefixes are compared, from there on. Neighbours with a common prefix of a k-mer or more
   form the interval in which windows can be equal; each window's smallest id is taken there.
4. The answers go back to the buckets, which give them to their own occurrences. So a string that a
   third of all texts share costs the merge one item per bucket, not one per text.

Exact copies are one text here (each task sends a text once), and whole copies of a smaller id are
removed whole. Defined results: null is the empty text; texts under ``LENGTH`` bytes lose nothing,
copies too; rows with a null id neither lose nor take anything; rows that repeat an id and a text
get the same result each; different texts of one id are judged one by one, and none repeats another
of its own id; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import _BYTE, _powers, fresh_path, materialise, mix64

LENGTH = 50
KMER = 20
_LEFT = LENGTH - KMER
_KEY = LENGTH + _LEFT + 2
_HASH_BITS = 40


def kmer_hashes(data: bytes) -> np.ndarray:
    """A hash of every k-mer of bytes."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n], dtype=np.uint64)))
    return mix64((total[KMER:] - total[: n - KMER + 1]) * down[: n - KMER + 1])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of its k-mer) for every anchor, ascending."""
    h = kmer_hashes(data)
    at = np.arange(len(h))
    width, seen = LENGTH - KMER + 1, 1
    while seen < width:
        step = min(seen, width - seen)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        seen += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    where = at[first]
    return where, first, last, h[where]


def _deltas(x: np.ndarray) -> bytes:
    """Sorted hashes as zstd of byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(len(x).to_bytes(8, "little") + d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _undelta(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1).cumsum(dtype=np.uint64)


def _texts(table: pa.Table) -> list[tuple[int, bytes, bytes]]:
    """(smallest id, digest, bytes) of each distinct text of a bucket, by digest."""
    ids: dict[bytes, int] = {}
    packed: dict[bytes, bytes] = {}
    for digest, doc_id, text in zip(*(table.column(c).to_pylist() for c in ("digest", "doc_id", "packed")), strict=True):
        ids[digest] = min(ids.get(digest, doc_id), doc_id)
        if text is not None:
            packed[digest] = text
    return [(ids[d], d, zstandard.decompress(packed[d])) for d in sorted(ids)]


def _deal(buckets: int):
    """Each task sends each of its texts once, and the smallest id it has seen of it at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        first: dict[bytes, int] = {}
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
        names = ("g", "digest", "doc_id", "packed")
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )
        bucket = lambda d: int.from_bytes(d[:8], "little") % buckets
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if doc_id is None or len(data) < LENGTH:
                    continue
                digest = hashlib.md5(data).digest()
                if digest in seen:
                    seen[digest] = min(seen[digest], doc_id)
                    continue
                seen[digest] = first[digest] = doc_id
                rows.append((bucket(digest), digest, doc_id, squeeze(data)))
            if rows:
                yield pack(rows)
        rest = [(bucket(d), d, i, None) for d, i in seen.items() if i != first[d]]
        if rest:
            yield pack(rest)

    return run


def _send_hashes(parts: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        each = [np.unique(anchors(data)[3] >> np.uint64(64 - _HASH_BITS)) for _, _, data in _texts(table)]
        found, times = np.unique(np.concatenate(each), return_counts=True)
        bounds = np.searchsorted(found, (np.arange(parts + 1, dtype=np.float64) * 2.0**_HASH_BITS / parts).astype(np.uint64))
        rows = []
        for p in range(parts):
            part = slice(bounds[p], bounds[p + 1])
            if bounds[p] < bounds[p + 1]:
                rows.append((p, g, _deltas(found[part]), _deltas(found[part][times[part] > 1])))
        cols = list(zip(*rows, strict=True))
        return pa.table({"p": pa.array(cols[0], pa.int32()), "g": pa.array(cols[1], pa.int32()), "once": cols[2], "again": cols[3]})

    return run


def _answer_hashes(table: pa.Table) -> pa.Table:
    """Per bucket, which of its hashes are in more than one text."""
    sent = [_undelta(x) for x in table.column("once").to_pylist()]
    again = [_undelta(x) for x in table.column("again").to_pylist()]
    found, times = np.unique(np.concatenate(sent), return_counts=True)
    repeated = np.union1d(found[times > 1], np.concatenate(again))
    out = [_deltas(x[np.isin(x, repeated, assume_unique=True)]) for x in sent]
    return pa.table({"g": table.column("g"), "repeated": pa.array(out, pa.binary())})


def _keys(data: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fixed-width keys: the suffix from the anchor, then the bytes before it backwards, both padded, then their lengths."""
    raw = np.frombuffer(data, np.uint8)
    right, left = last + LENGTH - at, at - first
    out = np.zeros((len(at), _KEY), np.uint8)
    j = np.arange(LENGTH)
    on = j < right[:, None]
    out[:, :LENGTH][on] = raw[(at[:, None] + j)[on]]
    j = np.arange(_LEFT)
    on = j < left[:, None]
    out[:, LENGTH : LENGTH + _LEFT][on] = raw[(at[:, None] - 1 - j)[on]]
    out[:, -2], out[:, -1] = left, right
    return out


def front_code(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """A sorted run: common prefix lengths, the rest of the keys, smallest and largest ids."""
    n = len(keys)
    prefix = np.zeros(n, np.uint8)
    if n > 1:
        prefix[1:] = (keys[1:] != keys[:-1]).argmax(1)
    rest = keys[np.arange(_KEY) >= prefix[:, None]]
    return zstandard.compress(
        n.to_bytes(8, "little") + prefix.tobytes() + low.astype("<i8").tobytes() + high.astype("<i8").tobytes() + rest.tobytes(), 1
    )


class Run:
    """A front-coded run read item by item; ``key`` is the current key, ``prefix`` its common prefix with the last."""

    __slots__ = ("at", "high", "key", "lows", "n", "prefix", "prefixes", "rest", "rests")

    def __init__(self, blob: bytes):
        raw = zstandard.decompress(blob)
        self.n = n = int.from_bytes(raw[:8], "little")
        self.prefixes = raw[8 : 8 + n]
        self.lows = np.frombuffer(raw, "<i8", n, 8 + n).tolist()
        self.high = np.frombuffer(raw, "<i8", n, 8 + 9 * n).tolist()
        self.rests, self.rest = raw, 8 + 17 * n
        self.at, self.key, self.prefix = -1, b"", 0

    def step(self) -> bool:
        self.at += 1
        if self.at >= self.n:
            self.key = None
            return False
        self.prefix = p = self.prefixes[self.at]
        end = self.rest + _KEY - p
        self.key = self.key[:p] + self.rests[self.rest : end]
        self.rest = end
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the output before) in key order, by a loser tree over common prefixes.

    Each candidate carries its common prefix with the last output. A longer one means a smaller
    candidate, with no byte compared; at equal ones comparison starts behind the prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    prefix = [0] * k
    live = [r.step() for r in runs] + [False] * (k - len(runs))

    def beats(a: int, b: int) -> bool:
        """Whether a wins; the loser's prefix becomes that with the winner."""
        if not live[b]:
            return True
        if not live[a]:
            return False
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        h = prefix[a]
        x, y = runs[a].key[h:], runs[b].key[h:]
        odd = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        if not odd:
            same, won = _KEY, True
        else:
            same, won = h + (8 * len(x) - odd.bit_length()) // 8, x < y
        prefix[b if won else a] = same
        return won

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        if beats(a, b):
            winners[i], losers[i] = a, b
        else:
            winners[i], losers[i] = b, a
    top = winners[1] if k > 1 else 0
    last = 0
    while live[top]:
        yield top, last
        run = runs[top]
        live[top] = run.step()
        prefix[top] = run.prefix
        node = (top + k) // 2
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node] = top
                top = other
            node //= 2
        last = prefix[top]


def _windows(items: list[tuple[int, int, bytes, int, int]], tell) -> None:
    """Smallest id of every window of items (run, item, key, low, high) that begin with one k-mer."""
    if len({i[2] for i in items}) == 1:
        low, high = min(i[3] for i in items), max(i[4] for i in items)
        if low < high:
            count = items[0][2][-1] + items[0][2][-2] - LENGTH + 1
            for run, item, _, _, top in items:
                if low < top:
                    tell(run, item, 0, count - 1, low)
        return
    smallest: dict[bytes, int] = {}
    contents = []
    for _, _, key, low, _ in items:
        left, right = key[-2], key[-1]
        whole = key[LENGTH : LENGTH + left][::-1] + key[:right]
        cut = [whole[i : i + LENGTH] for i in range(len(whole) - LENGTH + 1)]
        contents.append(cut)
        for c in cut:
            if smallest.get(c, low) >= low:
                smallest[c] = low
    for (run, item, _, _, high), cut in zip(items, contents, strict=True):
        begin, before = 0, smallest[cut[0]]
        for i in range(1, len(cut) + 1):
            now = smallest[cut[i]] if i < len(cut) else None
            if now != before:
                if before < high:
                    tell(run, item, begin, i - 1, before)
                begin, before = i, now


def _merge_runs(table: pa.Table) -> pa.Table:
    """Merge the runs of one part; per bucket (item, first window, last window, smallest id)."""
    buckets, part = table.column("g").to_pylist(), table.column("p")[0].as_py()
    runs = [Run(x) for x in table.column("run").to_pylist()]
    told: list[list[tuple[int, int, int, int]]] = [[] for _ in runs]
    tell = lambda run, *what: told[run].append(what)
    group: list[tuple[int, int, bytes, int, int]] = []
    for r, prefix in merge(runs):
        run = runs[r]
        if prefix < KMER and group:
            _windows(group, tell)
            group = []
        group.append((r, run.at, run.key, run.lows[run.at], run.high[run.at]))
    if group:
        _windows(group, tell)
    rows = [(g, part, np.array(t, "<i8").tobytes()) for g, t in zip(buckets, told, strict=True) if t]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"g": pa.array(cols[0], pa.int32()), "p": pa.array(cols[1], pa.int32()), "told": pa.array(cols[2], pa.binary())})


def _send_runs(parts: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"g": pa.array([], pa.int32()), "p": pa.array([], pa.int32()), "run": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})
        if not texts.num_rows or not answers.num_rows:
            return empty
        repeated = np.sort(np.concatenate([_undelta(x) for x in answers.column("repeated").to_pylist()]))
        if not len(repeated):
            return empty
        keys, ids, rows_of_text, starts, hashes = [], [], [], [], []
        for row, (doc_id, _, data) in enumerate(_texts(texts)):
            at, first, last, h = anchors(data)
            short = h >> np.uint64(64 - _HASH_BITS)
            k = np.minimum(np.searchsorted(repeated, short), len(repeated) - 1)
            on = repeated[k] == short
            keys.append(_keys(data, at[on], first[on], last[on]))
            ids.append(np.full(int(on.sum()), doc_id, np.int64))
            rows_of_text.append(np.full(int(on.sum()), row, np.int64))
            starts.append(first[on])
            hashes.append(h[on])
        keys, ids, rows_of_text, starts, hashes = (np.concatenate(x) for x in (keys, ids, rows_of_text, starts, hashes))
        part = (hashes % np.uint64(parts)).astype(np.int64)
        flat = np.ascontiguousarray(keys).view(f"S{_KEY}").reshape(-1)
        order = np.argsort(flat, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        rows = []
        for p, rows_of in zip(*_groups(part[order], order), strict=True):
            own = flat[rows_of]
            fresh = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            low, high = np.minimum.reduceat(ids[rows_of], fresh), np.maximum.reduceat(ids[rows_of], fresh)
            counts = np.diff(np.concatenate((fresh, [len(own)])))
            places = np.stack((np.repeat(np.arange(len(fresh)), counts), ids[rows_of], rows_of_text[rows_of], starts[rows_of]))
            rows.append((int(p), front_code(keys[rows_of[fresh]], low, high), zstandard.compress(places.astype("<i8").tobytes(), 1)))
        g = texts.column("g")[0].as_py()
        cols = list(zip(*rows, strict=True))
        return pa.table({"g": pa.array([g] * len(rows), pa.int32()), "p": pa.array(cols[0], pa.int32()), "run": pa.array(cols[1], pa.binary()), "places": pa.array(cols[2], pa.binary())}) if rows else empty

    return run


def _groups(ranked: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    kinds, first = np.unique(ranked, return_index=True)
    return kinds, np.split(order, first[1:])


def _give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, spans): the answers given to the occurrences; spans are (text's number in its bucket, start, end) of 8 bytes each."""
    for b in batches:
        out = []
        for told, places in zip(b.column("told").to_pylist(), b.column("places").to_pylist(), strict=True):
            item, first, last, low = np.frombuffer(told, "<i8").reshape(-1, 4).T
            of, ids, texts, starts = np.frombuffer(zstandard.decompress(places), "<i8").reshape(4, -1)
            lo, hi = np.searchsorted(of, item), np.searchsorted(of, item, "right")
            n = hi - lo
            k = np.repeat(np.arange(len(item)), n)
            at = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            on = ids[at] > low[k]
            at, k = at[on], k[on]
            spans = np.stack((texts[at], starts[at] + first[k], starts[at] + last[k] + LENGTH))
            out.append(zstandard.compress(spans.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(out, pa.binary())], ["g", "spans"])


def union_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return list(zip(s[new].tolist(), e[np.concatenate((new[1:] - 1, [len(e) - 1]))].tolist(), strict=True))


def _finish(texts: pa.Table, spans: pa.Table) -> pa.Table:
    by: dict[int, np.ndarray] = {}
    blobs = [np.frombuffer(zstandard.decompress(x), "<i8").reshape(3, -1) for x in spans.column("spans").to_pylist()]
    if blobs:
        every = np.concatenate(blobs, axis=1)
        every = every[:, np.argsort(every[0], kind="stable")]
        numbers, first = np.unique(every[0], return_index=True)
        by = dict(zip(numbers.tolist(), np.split(every, first[1:], axis=1), strict=True))
    rows = []
    for row, (doc_id, digest, data) in enumerate(_texts(texts) if texts.num_rows else ()):
        cut = union_spans(by[row][1], by[row][2]) if row in by else []
        kept, at = hashlib.sha256(), 0
        for s, e in cut:
            kept.update(data[at:s])
            at = e
        kept.update(data[at:])
        rows.append((digest, doc_id, sum(e - s for s, e in cut), len(cut), kept.hexdigest()))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("digest", "rep", "removed", "spans", "kept")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


def remove_repeats(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-total // max(bucket_bytes, min(16 * bucket_bytes, total // 4000))))
    table = "texts_" + uuid.uuid4().hex
    dealt = rows.mapInArrow(_deal(buckets), "g int, digest binary, doc_id long, packed binary")
    (
        dealt.repartition(buckets, "g")
        .write.bucketBy(buckets, "g")
        .option("path", fresh_path(spark, table))
        .format("parquet")
        .saveAsTable(table)
    )
    texts = spark.table(table)
    sent = texts.groupBy("g").applyInArrow(_send_hashes(buckets), "p int, g int, once binary, again binary")
    answers = sent.groupBy("p").applyInArrow(_answer_hashes, "g int, repeated binary")
    runs = texts.groupBy("g").cogroup(answers.groupBy("g"))
    runs = materialise(runs.applyInArrow(_send_runs(buckets), "g int, p int, run binary, places binary"), "runs")
    told = runs.select("g", "p", "run").groupBy("p").applyInArrow(_merge_runs, "g int, p int, told binary")
    spans = told.join(runs.select("g", "p", "places"), ["g", "p"]).mapInArrow(_give_back, "g int, spans binary")
    cut = materialise(
        texts.groupBy("g")
        .cogroup(spans.groupBy("g"))
        .applyInArrow(_finish, "digest binary, rep long, removed long, spans long, kept string"),
        "cut",
    )
    each = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.when((F.octet_length("text") < LENGTH) | F.col("doc_id").isNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("own"))
    joined = each.join(cut, "digest", "left")
    copy = F.col("own").isNull() & (F.col("doc_id") > F.col("rep"))
    zero = F.lit(0).cast("long")
    pick = lambda whole, part: F.when(F.col("own").isNotNull(), zero).when(copy, whole).otherwise(F.col(part))
    return joined.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "removed").alias("n_removed"),
        pick(F.lit(1).cast("long"), "spans").alias("n_spans"),
        F.when(F.col("own").isNotNull(), F.col("own")).when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept")).alias("kept_sha256"),
    )
