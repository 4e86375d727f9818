"""LSH sketches of token arrays: MinHash, one-bit MinHash, SuperMinHash and simhash."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .metrics import _col

#: The prime behind 2^32.
PRIME = 4294967311
MAX = 2**32 - 1


def crc32(s: Column | str) -> Column:
    return F.crc32(_col(s).cast("binary"))


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def _parameters(h: int, seed: int | None) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    seen: set[int] = set()
    draw = lambda: next(x for x in iter(lambda: rng.randint(1, MAX), None) if not (x in seen or seen.add(x)))
    return [(draw(), draw()) for _ in range(h)]


def _hashed(token: Column, a: Column, b: Column) -> Column:
    """(a t + b) mod the prime without overflow, for 32-bit t and a."""
    high = F.pmod(a * F.shiftright(token, 16), F.lit(PRIME))
    return F.pmod(high * 65536 + a * token.bitwiseAND(F.lit(65535)) + b, F.lit(PRIME))


def _minima(tokens: Column, h: int, seed: int | None) -> Column:
    params = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in _parameters(h, seed)))
    values = F.array_distinct(F.transform(tokens, crc32))
    least = lambda p: F.array_min(F.transform(values, lambda t: _hashed(t, p["a"], p["b"])))
    none = F.transform(params, lambda p: F.lit(0).cast("long"))
    return F.when(F.size(tokens) == 0, none).otherwise(F.transform(params, lambda p: F.least(least(p), F.lit(MAX).cast("long"))))


def minhash(tokens: Column | str, h: int = 256, seed: int | None = 0) -> Column:
    """``h`` minima of universal hashes of the tokens' CRC-32; zeros for no tokens."""
    return _minima(_col(tokens), h, seed)


def lsb_minhash(tokens: Column | str, precision: int = 8, seed: int | None = 0) -> Column:
    """The lowest bit of 64 * precision minima, as ``precision`` 64-bit words."""
    word = lambda bits, k: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.get(bits, k * 64 + i).bitwiseAND(F.lit(1).cast("long")), i)),
    )
    spots = F.sequence(F.lit(0), F.lit(precision - 1))
    # bound once, as the minima are costly
    bound = F.array(_minima(_col(tokens), 64 * precision, seed))
    return F.get(F.transform(bound, lambda bits: F.transform(spots, lambda k: word(bits, k))), F.lit(0))


def super_minhash(tokens: Column | str, h: int = 256) -> Column:
    """SuperMinHash: each token draws a random permutation of the entries; an Arrow-batched UDF."""

    def sketch(values) -> list[int]:
        best = np.full(h, np.inf)
        for t in sorted({str(v) for v in values}):
            import zlib

            rng = np.random.Generator(np.random.PCG64(zlib.crc32(t.encode())))
            order = rng.permutation(h)
            best[order] = np.minimum(best[order], np.arange(h) + rng.random(h))
        return [0 if np.isinf(b) else int(b * (MAX / (h + 1))) for b in best]

    @F.pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else sketch(v))

    return run(_col(tokens))


def simhash(tokens: Column | str, f: int = 128) -> Column:
    """Bit votes over the token multiset, as f / 64 words; digests are md5 to 128 bits, else SHA-2."""
    if f not in (64, 128, 256, 512):
        raise ValueError("f must be 64, 128, 256 or 512")
    t = _col(tokens)
    digest = F.md5 if f <= 128 else (lambda x: F.sha2(x, f))
    digests = F.transform(t, lambda x: digest(x.cast("binary")))
    half = lambda d, k, j: F.conv(F.substring(d, k * 16 + j * 8 + 1, F.lit(8)), 16, 10).cast("long")
    words = F.transform(
        F.sequence(F.lit(0), F.lit(f // 64 - 1)),
        lambda k: F.transform(digests, lambda d: F.call_function("shiftleft", half(d, k, 0), F.lit(32)).bitwiseOR(half(d, k, 1))),
    )
    vote = lambda column, i: F.aggregate(
        column, F.lit(0), lambda s, x: s + F.when(F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)
    )
    pack = lambda column: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, i: F.when(vote(column, i) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc),
    )
    return F.transform(words, pack)


def match_probability(h: int, bands: int, s: float) -> float:
    """Chance that two items of similarity s share a band."""
    return 1 - (1 - s ** (h / bands)) ** bands


def similarity_threshold(h: int, bands: int) -> float:
    """Similarity at which sharing a band becomes likely."""
    return (1 / bands) ** (bands / h)


def guess_bands(h: int, threshold: float) -> int:
    """The fewest bands whose threshold is at most the given one."""
    for bands in range(1, h + 1):
        if similarity_threshold(h, bands) <= threshold:
            return bands
    raise ValueError(f"no number of bands up to {h} reaches the threshold {threshold}")
