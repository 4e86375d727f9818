"""Shared pieces: the shared work folder, word splitting, hashing and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to lower case, digits, letters and every byte from 0x80 kept, all else to a space.
WORD_TABLE = bytes(
    _LOWER[c] if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder and any other an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps from task to task: tokenizers and the ids that they have met.
KEPT: dict = {}


def give_back() -> None:
    """Return freed memory to the system (Arrow, glibc): workers outlive their tasks, and many small arrays leave heaps behind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go() -> None:
    """Drop what tasks of another operator kept in this worker."""
    if KEPT:
        KEPT.clear()
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_IS_WORD = np.frombuffer(WORD_TABLE, np.uint8) != 32
_FOLD = np.frombuffer(_LOWER, np.uint8)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for base in (_BASE, _INV):
            p = np.full(size, base & (2**64 - 1), np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words."""
    is_word = _IS_WORD[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; A-Z folded."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    terms = _BYTE[_FOLD[np.frombuffer(data, np.uint8)]] * up[: len(data)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    raw = (total[ends] - total[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; fewer than k words: one shingle of all, none if no word."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + words[j : n - k + 1 + j])
    return out


def shingles_of(text: str | None, k: int = 5) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return shingles(word_hashes(data, *word_spans(data)), k)


def _joined(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node that it is linked with, by others too) of all nodes."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up)]


def components(edges: DataFrame, tag: str = "cc", few: int = 10_000) -> DataFrame:
    """(a, b) links to (id, root) with root the smallest id of the component.

    Each round every node joins its neighbour that is smallest by a hash that changes with the rounds, and what that
    one joins. Links are drawn between what nodes have joined, so links within go and the others become fewer, in a
    path too; each round is written to the shared folder. The driver joins the last ones, ``few`` links at most.
    Nulls must not occur. Only nodes that have a link are returned.
    """
    spark = edges.sparkSession
    every = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-e")
    left, rounds = every.filter("a <> b"), []
    while len(rest := left.limit(few + 1).collect()) > few:
        by = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("turn"), F.col(c).alias("id"))
        ends = [left.select(F.col(c).alias("node"), F.least(by("a"), by("b")).alias("lowest")) for c in ("a", "b")]
        near = ends[0].union(ends[1]).groupBy("node").agg(F.min("lowest").alias("lowest"))
        near = materialise(near.select("node", F.col("lowest.id").alias("to")), f"{tag}-n")
        far = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        rounds.append(materialise(near.join(far, "to").select("node", F.col("far").alias("to")), f"{tag}-j"))
        for side in ("a", "b"):
            left = left.join(rounds[-1].select(F.col("node").alias(side), F.col("to").alias(f"to_{side}")), side)
        left = left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = materialise(left.filter("a <> b").distinct(), f"{tag}-e")
    found = spark.createDataFrame(_joined(rest), "node long, to long")
    for joined in reversed(rounds):
        after = found.select(F.col("node").alias("to"), F.col("to").alias("root"))
        found = joined.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    nodes = every.select(F.col("a").alias("id")).union(every.select(F.col("b").alias("id"))).distinct()
    found = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("group"))
    smallest = found.groupBy("group").agg(F.min("id").alias("root"))
    return materialise(found.join(smallest, "group").select("id", "root"), f"{tag}-l")
