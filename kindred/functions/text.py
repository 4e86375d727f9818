"""String normalising, n-grams and fingerprint tokenizers as Columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from .metrics import _col

# Letters and marks whose ASCII form is longer than one character or not a base letter.
SPECIAL = {
    "œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "Th", "«": "<<", "»": ">>",
    "…": "...", "™": "(tm)", "©": "(c)", "®": "(r)", "€": "EUR", "ĳ": "ij", "Ĳ": "IJ", "ﬁ": "fi", "ﬂ": "fl", "№": "No",
}
# Single characters that have no decomposition.
SINGLE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i",
    "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-",
    "—": "-", "‐": "-", "−": "-", "·": "*", " ": " ", " ": " ", " ": " ",
}


@cache
def _fold_table() -> tuple[str, str]:
    """From and to: Latin letters with marks to their base letter, by decomposition."""
    pairs = dict(SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and ch not in SPECIAL:
            pairs.setdefault(ch, base)
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(pairs) + marks, "".join(pairs.values())


def fold(s: Column | str) -> Column:
    """ASCII form of Latin text: marks dropped, ligatures and typographic signs spelt out.

    Other scripts are left as they are.
    """
    s = _col(s)
    plain = F.translate(s, *_fold_table())
    for ch, to in SPECIAL.items():
        plain = F.replace(plain, F.lit(ch), F.lit(to))
    return F.when(s.rlike(r"[^\x00-\x7F]"), plain).otherwise(s)


def squeeze(s: Column | str, keep_roman_numerals: bool = False) -> Column:
    """One of every run of the same character; with the flag, runs of I, X, C and M stay."""
    pattern = r"([^\nIXCM])\1+" if keep_roman_numerals else r"([^\n])\1+"
    return F.regexp_replace(_col(s), pattern, "$1")


def reduce_lengthening(s: Column | str) -> Column:
    """A letter that stands five times or more in a row stands three times."""
    return F.regexp_replace(_col(s), r"(\p{L})\1{4,}", "$1$1$1")


def ngrams(n: int, tokens: Column | str, is_string: bool = True) -> Column:
    """n-grams of a string (as strings) or an array (as arrays); what is shorter than n is one gram."""
    t = _col(tokens)
    size = F.length(t) if is_string else F.size(t)
    at = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    cut = (lambda i: F.substring(t, i, F.lit(n))) if is_string else (lambda i: F.slice(t, i, F.lit(n)))
    return F.when(size < n, F.array(t)).otherwise(F.transform(at, cut))


def bigrams(tokens: Column | str, is_string: bool = True) -> Column:
    return ngrams(2, tokens, is_string)


def trigrams(tokens: Column | str, is_string: bool = True) -> Column:
    return ngrams(3, tokens, is_string)


def quadrigrams(tokens: Column | str, is_string: bool = True) -> Column:
    return ngrams(4, tokens, is_string)


def join_ngrams(grams: Column | str) -> Column:
    """The string whose n-grams these are: the first gram and the last character of each other one."""
    g = _col(grams)
    rest = F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1)))
    return F.concat(F.get(g, F.lit(0)), F.array_join(rest, ""))


def _cleaned(s: Column, keep_digits, min_token_size, split, stopwords, squeezed) -> Column:
    for ch in split:
        s = F.replace(s, F.lit(ch), F.lit(" "))
    for word in stopwords:
        s = F.regexp_replace(s, rf"(?iU)\b\Q{word}\E\b", "")
    if not keep_digits:
        s = F.regexp_replace(s, r"[0-9]", "")
    s = F.lower(s)
    if min_token_size > 1:
        s = F.regexp_replace(s, rf"(?U)\b\S{{1,{min_token_size}}}\b", "")
    s = F.trim(F.regexp_replace(fold(s), r"[^a-z0-9\s]", ""))
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    return squeeze(s) if squeezed else s


def fingerprint_tokens(
    s: Column | str,
    keep_digits: bool = True,
    min_token_size: int = 1,
    split: str = "",
    stopwords: tuple[str, ...] = (),
    squeezed: bool = False,
) -> Column:
    """Distinct cleaned tokens in order; ``min_token_size`` drops tokens of that size and less if over 1."""
    s = _cleaned(_col(s), keep_digits, min_token_size, split, stopwords, squeezed)
    return F.array_sort(F.array_distinct(F.split(s, r"\s+")))


def fingerprint(s: Column | str, **options) -> Column:
    return F.array_join(fingerprint_tokens(s, **options), " ")


def ngrams_fingerprint_tokens(n: int, s: Column | str, **options) -> Column:
    defaults = {
        "keep_digits": True, "min_token_size": 1, "split": "", "stopwords": (), "squeezed": False,
    } | options
    s = F.regexp_replace(_cleaned(_col(s), *defaults.values()), r"\s", "")
    return F.array_sort(F.array_distinct(ngrams(n, s)))


def ngrams_fingerprint(n: int, s: Column | str, **options) -> Column:
    return F.array_join(ngrams_fingerprint_tokens(n, s, **options), "")
