"""Blocking, collision and sort keys, and phonetic codes, as Columns (``ngram_keys`` is a pandas UDF)."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, functions as F

from .metrics import _col, chars
from .text import fold

# Consonants, the most often misspelt first.
OMISSION_ORDER = "JKQXZVWYBFMGPDHCLNTSR"
VOWELS = ("A", "E", "I", "O", "U")


def _letters(s: Column) -> Column:
    return chars(F.regexp_replace(F.upper(fold(s)), "[^A-Z]", ""))


def omission_key(s: Column | str) -> Column:
    """Consonants present, in fixed order, then vowels by first appearance."""
    letters = _letters(_col(s))
    order = F.array(*(F.lit(c) for c in OMISSION_ORDER))
    kinds = F.array_distinct(letters)
    vowels = F.filter(kinds, lambda c: c.isin(*VOWELS))
    return F.array_join(F.concat(F.array_intersect(order, kinds), vowels), "")


def skeleton_key(s: Column | str) -> Column:
    """First letter, then other consonants and other vowels by first appearance."""
    kinds = F.array_distinct(_letters(_col(s)))
    rest = F.slice(kinds, 2, F.greatest(F.size(kinds) - 1, F.lit(0)))
    vowel = lambda c: c.isin(*VOWELS)
    parts = F.concat(F.slice(kinds, 1, 1), F.filter(rest, lambda c: ~vowel(c)), F.filter(rest, vowel))
    return F.array_join(parts, "")


def zig_zag(s: Column | str) -> list[Column]:
    """Sort keys for two passes: the string, and the string reversed."""
    return [_col(s), F.reverse(_col(s))]


def _cut(s: Column, start, size=None) -> Column:
    """Characters from ``start`` (counted from 0), ``size`` of them or all that are left."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.length(s) if size is None else (F.lit(size) if isinstance(size, int) else size)
    return F.substring(s, start + 1, F.greatest(size, F.lit(0)))


def levenshtein_1d_keys(
    s: Column | str, transpositions: bool = False, flag: str = "\x00", skip_doubled: bool = True
) -> Column:
    """The wildcard neighbourhood: strings at distance 1 at most share a key.

    With ``skip_doubled`` there is no wildcard inside a doubled letter, which saves keys and loses
    pairs that differ by a letter put just there. With transpositions, swapped neighbours share a
    key too; such pairs must be verified.
    """
    s = _col(s)
    n, wild = F.length(s), F.lit(flag)
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    doubled = lambda i: (i > 0) & (_cut(s, i - 1, 1) == _cut(s, i, 1))
    replaced = F.transform(spots, lambda i: F.concat(_cut(s, 0, i), wild, _cut(s, i + 1)))
    gaps = F.filter(spots, lambda i: ~doubled(i)) if skip_doubled else spots
    added = F.transform(gaps, lambda i: F.concat(_cut(s, 0, i), wild, _cut(s, i)))
    parts = [F.array(s), replaced, added, F.array(F.concat(s, wild))]
    if transpositions:
        swaps = F.filter(spots, lambda i: (i > 0) & ~doubled(i))
        parts.append(
            F.transform(swaps, lambda i: F.concat(_cut(s, 0, i - 1), _cut(s, i, 1), _cut(s, i - 1, 1), _cut(s, i + 1)))
        )
    return F.concat(*parts)


def damerau_levenshtein_1d_keys(s: Column | str, flag: str = "\x00") -> Column:
    return levenshtein_1d_keys(s, True, flag)


def levenshtein_1d_blocks(s: Column | str, transpositions: bool = False, flag: str = "\x00") -> Column:
    """Halves of the string, marked by side: strings at distance 1 at most share a half."""
    s = _col(s)
    n, wild = F.length(s), F.lit(flag)
    h = F.floor(n / 2).cast("int")
    front = lambda size: F.concat(wild, _cut(s, 0, size))
    back = lambda start: F.concat(_cut(s, start), wild)
    even = [front(h), back(h)]
    if transpositions:
        even += [
            F.concat(front(h - 1), F.substring(back(h), 1, 1)),
            F.concat(F.right(front(h), F.lit(1)), back(h + 1)),
        ]
    odd = F.array(front(h), back(h), front(h + 1), back(h + 1))
    return (
        F.when(n == 1, F.array(F.concat(wild, s), F.concat(s, wild), wild))
        .when(n % 2 == 0, F.array(*even))
        .otherwise(odd)
    )


def damerau_levenshtein_1d_blocks(s: Column | str, flag: str = "\x00") -> Column:
    return levenshtein_1d_blocks(s, True, flag)


def levenshtein_2d_blocks(
    s: Column | str, transpositions: bool = False, flags: tuple[str, str, str] = ("\x00", "\x01", "\x02")
) -> Column:
    """Thirds of the string, marked by place; with transpositions also thirds whose ends are swapped."""
    s = _col(s)
    n, t = F.length(s), F.floor(F.length(s) / 3).cast("int")
    part = lambda k, start, size=None: F.concat(F.lit(flags[k]), _cut(s, start, size))
    basic = [part(0, 0, t), part(1, t, t), part(2, 2 * t)]
    swapped = [
        F.concat(part(0, 0, t - 1), _cut(s, t, 1)),
        F.concat(part(1, t - 1, 1), _cut(s, t + 1, t - 1)),
        F.concat(part(2, 2 * t - 1, 1), _cut(s, 2 * t + 1)),
    ]
    one = [
        part(0, 0, t + 1), part(1, t + 1, t), part(2, 2 * t + 1), part(0, 0, t), part(1, t, t + 1),
        part(1, t, t), part(2, 2 * t),
    ]
    two = [
        part(0, 0, t + 1), part(1, t + 1, t + 1), part(2, 2 * t + 2), part(0, 0, t), part(1, t, t + 1),
        part(2, 2 * t + 1), part(1, t + 1, t),
    ]
    thirds = F.array(*basic)
    if transpositions:
        thirds = F.when(n == 0, thirds).otherwise(F.array(*basic, *swapped))
    return F.when(n % 3 == 0, thirds).when(n % 3 == 1, F.array(*one)).otherwise(F.array(*two))


def damerau_levenshtein_2d_blocks(s: Column | str) -> Column:
    return levenshtein_2d_blocks(s, True)


def ngram_keys(n: int, s: Column | str, threshold: float = 0.8) -> Column:
    """All ways to leave out grams while a ``threshold`` of them stays; for short strings."""

    def of(text: str | None) -> list[str] | None:
        if text is None:
            return None
        k = len(text) - n + 1
        grams = [text] if k < 1 else [text[i : i + n] for i in range(k)]
        sizes = range(k - 1, max(1, math.floor(k * threshold)) - 1, -1)
        return ["".join(grams)] + ["".join(g) for size in sizes for g in combinations(grams, size)]

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return keys(_col(s))


# The code of every letter whose code needs no context.
COLOGNE_CODES = ("AEIOUJYBPFVWGKQLMNRSZ", "000000011333444566788")


def cologne(name: Column | str) -> Column:
    """Cologne phonetics."""
    s = F.upper(_col(name))
    for a, b in (("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("ß", "SS"), ("PH", "F")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.upper(fold(s)), "[^A-Z]", "")
    wide = s.rlike("^H*X")
    # letters are looked at before any is coded, so codes are set as lower-case marks first
    for pattern, mark in (
        ("[DT](?=[CSZ])", "e"),
        ("[DT]", "b"),
        ("(?<=[CQK])X", "e"),
        ("^C(?=[AHKLOQRUXe])", "d"),
        ("(?<!^)(?<![SZ])C(?=[AHKOQUXe])", "d"),
        ("C", "e"),
        ("X", "de"),
    ):
        s = F.regexp_replace(s, pattern, mark)
    code = F.translate(F.translate(F.replace(s, F.lit("H"), F.lit("")), *COLOGNE_CODES), "bde", "248")
    first = F.when(wide, 2).otherwise(1)
    rest = F.regexp_replace(F.substring(code, first + 1, F.length(code)), r"(.)\1+", "$1")
    return F.concat(F.substring(code, F.lit(1), first), F.replace(rest, F.lit("0"), F.lit("")))


# Ordered rules of the transliteration key.
RUSALKA_NOTATION = (("[čšŝ]", "ch"), ("û", "iou"), ("ž", "zh"))
RUSALKA_RULES = (
    ("cz", "ts"), ("i[jy]$", ""), ("[fvw]|ph", "f"), ("^[jy]?e", "J"), ("[dt]?[cs]h|tz", "ʃ"), ("[dt]?(?:zh|j)", "ʒ"),
    ("ks", "x"), ("^y(?=[aeiou])|iou", "j"), ("[cg]", "k"), ("h", ""),
)


def rusalka(name: Column | str) -> Column:
    """A key for transliterated Russian names; the empty string where the rules leave nothing."""
    s = F.lower(_col(name))
    for pattern, to in RUSALKA_NOTATION:
        s = F.regexp_replace(s, pattern, to)
    s = F.regexp_replace(F.lower(fold(s)), "[^a-z]", "")
    key = s
    for pattern, to in RUSALKA_RULES:
        key = F.regexp_replace(key, pattern, to)
    key = F.lower(F.regexp_replace(key, r"(.)\1+", "$1"))
    first = F.regexp_replace(F.substring(key, 1, 1), "[aeiouy]", "a")
    rest = F.regexp_replace(F.substring(key, F.lit(2), F.length(key)), "[aeiouy]", "")
    return F.when(F.length(s) < 2, s).otherwise(F.concat(first, rest))
