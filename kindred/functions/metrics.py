"""Similarities and distances of two columns.

Set metrics take arrays (repeats do not count), sparse metrics take maps of term to weight, edit
distances take strings. Two empty sets are alike only where the metric says so below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(s: Column | str) -> Column:
    """The code points of a string, as an array; none for the empty string."""
    s = _col(s)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def frequencies(tokens: Column | str) -> Column:
    """How often each token stands in an array, as a map of doubles."""
    ranked = F.array_sort(_col(tokens))
    kinds = F.array_distinct(ranked)
    first = lambda t: F.array_position(ranked, t)
    last = lambda t: F.size(ranked) - F.array_position(F.reverse(ranked), t) + 1
    return F.map_from_entries(F.transform(kinds, lambda t: F.struct(t, (last(t) - first(t) + 1).cast("double"))))


def intersection_size(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b)))


def _sizes(a, b) -> tuple[Column, Column, Column]:
    a, b = _col(a), _col(b)
    return intersection_size(a, b), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))


def jaccard_similarity(a: Column | str, b: Column | str, empty_equal: bool = True) -> Column:
    """|A n B| / |A u B|; two empty sets give 1 (0 without ``empty_equal``), one gives 0."""
    both, n, m = _sizes(a, b)
    return F.when((n == 0) & (m == 0), F.lit(1.0 if empty_equal else 0.0)).otherwise(both / (n + m - both))


def dice_coefficient(a: Column | str, b: Column | str) -> Column:
    """2 |A n B| / (|A| + |B|); two empty sets give 1."""
    both, n, m = _sizes(a, b)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(2 * both / (n + m))


def overlap_coefficient(a: Column | str, b: Column | str, empty_equal: bool = True) -> Column:
    """|A n B| / min(|A|, |B|); two empty sets give 1 (0 without ``empty_equal``), one gives 0."""
    both, n, m = _sizes(a, b)
    same = F.when((n == 0) & (m == 0), F.lit(1.0 if empty_equal else 0.0))
    return same.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(both / F.least(n, m))


def sparse_binary_cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """|A n B| / sqrt(|A| |B|); 0 if a set is empty."""
    both, n, m = _sizes(a, b)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(both / F.sqrt((n * m).cast("double")))


binary_cosine_similarity = sparse_binary_cosine_similarity


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def _folded(a: Column, b: Column, fold) -> Column:
    zero = F.lit(0.0)
    zipped = F.map_zip_with(a, b, lambda _, x, y: fold(F.coalesce(x, zero), F.coalesce(y, zero)))
    return _sum(F.map_values(zipped))


def sparse_dot_product(a: Column | str, b: Column | str) -> Column:
    return _folded(_col(a), _col(b), lambda x, y: x * y)


def sparse_norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(_col(a)), lambda w: w * w)))


def sparse_normalize(a: Column | str) -> Column:
    """Weights over the norm; an empty map where the norm is 0."""
    a = _col(a)
    norm = sparse_norm(a)
    return F.when(norm == 0, F.map_filter(a, lambda k, v: F.lit(False))).otherwise(
        F.transform_values(a, lambda _, w: w / norm)
    )


def sparse_cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """dot / sqrt(a.a b.b); 0 if a map is empty or has no weight."""
    a, b = _col(a), _col(b)
    square = lambda m: _sum(F.transform(F.map_values(m), lambda w: w * w))
    return F.coalesce(F.try_divide(sparse_dot_product(a, b), F.sqrt(square(a) * square(b))), F.lit(0.0))


def weighted_jaccard_similarity(a: Column | str, b: Column | str) -> Column:
    """Sum of minima over sum of maxima; 0 if a map is empty or has no weight."""
    a, b = _col(a), _col(b)
    ratio = F.try_divide(_folded(a, b, F.least), _folded(a, b, F.greatest))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of token arrays, by token frequencies."""
    return sparse_cosine_similarity(frequencies(a), frequencies(b))


def levenshtein_distance(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_col(a), _col(b))


def limited_levenshtein_distance(k: int, a: Column | str, b: Column | str) -> Column:
    """The distance, or k + 1 if it is more than k."""
    d = F.levenshtein(_col(a), _col(b), k)
    return F.when(d < 0, F.lit(k + 1)).otherwise(d)


def levenshtein_distance_lte1(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_col(a), _col(b), 1) >= 0


def damerau_levenshtein_distance_lte1(a: Column | str, b: Column | str) -> Column:
    """Distance of at most 1 where swapping two neighbours counts as one edit."""
    a, b = _col(a), _col(b)
    x, y = chars(a), chars(b)
    odd = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) != F.get(y, i))
    i, j = F.get(odd, F.lit(0)), F.get(odd, F.lit(1))
    swap = (
        (F.length(a) == F.length(b))
        & (F.length(a) > 1)
        & (F.size(odd) == 2)
        & (j == i + 1)
        & (F.get(x, i) == F.get(y, j))
        & (F.get(x, j) == F.get(y, i))
    )
    return levenshtein_distance_lte1(a, b) | F.coalesce(swap, F.lit(False))


def popcount(x: Column | str) -> Column:
    return F.bit_count(_col(x))


def minhash_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal entries of two signatures."""
    a, b = _col(a), _col(b)
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def _hamming(a: Column, b: Column) -> Column:
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, n: s + n)


def lsb_minhash_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - 2 h / bits for h differing bits of signatures of 64-bit words."""
    a, b = _col(a), _col(b)
    return 1 - 2.0 * _hamming(a, b) / (64 * F.size(a))


def simhash_distance(a: Column | str, b: Column | str, f: int = 128) -> Column:
    return _hamming(_col(a), _col(b)) / F.lit(f)


def simhash_similarity(a: Column | str, b: Column | str, f: int = 128) -> Column:
    return 1 - simhash_distance(a, b, f)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x | y, conditions)
