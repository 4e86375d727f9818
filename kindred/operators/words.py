"""Typed word tokens of social and French or English text, by one pattern per type; an Arrow-batched UDF.

At each place the first pattern that matches gives a token; words are then taken apart where a
contraction, an elision or an inversion joins two.
"""

from __future__ import annotations

import html
import unicodedata
from dataclasses import dataclass, fields

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from kindred.functions.text import SINGLE, SPECIAL

TYPES = ("word", "number", "punct", "emoji", "smiley", "url", "email", "hashtag", "mention")

# Abbreviations that keep their dot, and pronouns that an inversion puts behind a verb.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "mme", "mlle", "mm", "etc", "vs", "inc", "jr", "sr", "av", "env", "cf", "ex", "fig", "vol")
INVERTED = ("je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "moi", "toi", "le", "la", "les", "lui", "leur", "y", "en", "ce")

_L = r"[\p{L}\p{M}]"
_EMOJI = (
    r"[\U0001F1E6-\U0001F1FF]{2}|[0-9#*]️?⃣"
    r"|(?![0-9#*©®™‼⁉↔-↪])\p{Extended_Pictographic}[️\U0001F3FB-\U0001F3FF]*"
    r"(?:‍\p{Extended_Pictographic}[️\U0001F3FB-\U0001F3FF]*)*"
)
_SMILEY = r"[:;=8xX][-o'^]?[()\[\]DPp3/\\|*](?![\p{L}\p{N}])|:'[()]|<3|\^\^|[-^][_.][-^]|\\o/"
_PARTS = (
    ("skip", r"[\s\p{Cc}]+"),
    ("url", r"(?:https?://|www\.)[^\s,]+"),
    ("email", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("smiley", r"(?<![\p{L}\p{N}])(?:" + _SMILEY + ")|(?<=\\s)" + "<3"),
    ("emoji", _EMOJI),
    ("arrow", r"<-+|-+>"),
    ("hashtag", rf"[#$]{_L}[\p{{L}}\p{{M}}\p{{N}}_]*"),
    ("mention", r"@[0-9A-Za-z_]+"),
    ("archaic", r"(?i)(?<!\p{L})['’](?:tis|twas)(?!\p{L})"),
    ("clitic", r"(?i)(?<=[\p{L}\p{N}])['’](?:ll|re|ve|m|s|d)(?![\p{L}\p{N}])"),
    ("abbreviation", r"(?i)(?<!\p{L})(?:" + "|".join(ABBREVIATIONS) + r")\.(?!\p{L})"),
    ("acronym", r"(?<!\p{L})\p{Lu}(?:\.\p{Lu})+\.?(?![\p{L}\p{N}])"),
    ("number", r"(?:(?<![^\s])-)?\p{Nd}++(?:[.,]\p{Nd}++)?+(?![\p{L}\p{M}º]|-\p{L}|-\p{Nd}+-\p{L})"),
    ("word", rf"(?:{_L}|[\p{{N}}_])[\p{{L}}\p{{M}}\p{{N}}_º]*(?:(?:[-·](?:{_L}|[\p{{N}}_])|['’](?!\p{{Lu}}\.\p{{Lu}}){_L})[\p{{L}}\p{{M}}\p{{N}}_º]*)*(?:['’](?=[#@\p{{L}}\p{{N}}]))?"),
    ("punct", r"(?s:.)"),
)
_SCAN = regex.compile("|".join(f"(?P<{n}>{p})" for n, p in _PARTS))
_CLITIC = regex.compile(r"(?i)^(.+?)(['’](?:ll|re|ve|m|s|d))$")
_INVERSION = regex.compile(rf"(?i)^({_L}+)-(?:(t)-)?({'|'.join(INVERTED)})$")
_APOSTROPHE = regex.compile(rf"^({_L}+['’])(.+)$")
_VOWEL = frozenset("aeiouyh")


def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", SPECIAL.get(ch, ch))[0].lower()


def ascii_form(text: str) -> str:
    out = "".join(SPECIAL.get(c, SINGLE.get(c, c)) for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))


def _pieces(word: str) -> list[str]:
    """A matched word, taken apart where it joins two."""
    if word.lower().replace("’", "'") == "aujourd'hui":
        return [word]
    m = _CLITIC.match(word)
    if m and "'" not in m[1].replace("’", "'"):
        return [*_pieces(m[1]), m[2]]
    m = _APOSTROPHE.match(word)
    if m and "-" not in m[1]:
        before, after = m[1][:-1], m[2]
        irish = before.lower() == "o"
        consonants = _base(before[-1]) not in _VOWEL and _base(after[0]) not in _VOWEL and after[0].isalpha()
        negated = before[-1].lower() == "n" and after.lower() == "t"
        if not irish and not consonants and not negated:
            return [m[1], *_pieces(after)]
    m = _INVERSION.match(word)
    if m:
        return [x for x in m.groups() if x]
    return [word]


def tokens_of(text: str) -> list[tuple[str, str]]:
    """(type, token) in order."""
    out = []
    for m in _SCAN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "word":
            if token.isdecimal():
                out.append(("number", token))
            else:
                out += [("word", t) for t in _pieces(token)]
        elif kind == "number":
            lone = len(token) == 1 and text[m.end() : m.end() + 1] not in (".", ",")
            out.append(("punct" if lone else "number", token))
        elif kind in ("archaic", "clitic", "abbreviation", "acronym"):
            out.append(("word", token))
        elif kind == "punct" and token in "️‍":
            continue
        else:
            out.append(("punct" if kind == "arrow" else kind, token))
    return out


_HASHTAG_PARTS = regex.compile(r"\p{Nd}+|\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{L}+")


def split_hashtag(tag: str) -> list[str]:
    """Words and numbers of a camel-case hashtag."""
    return _HASHTAG_PARTS.findall(tag.lstrip("#$"))


@dataclass(frozen=True)
class Options:
    lower: bool = False
    unidecode: bool = False
    min_word_length: int | None = None
    max_word_length: int | None = None
    stoplist: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    reduce_words: bool = False
    decode_html_entities: bool = False
    normalize_hashtags: bool = False
    normalize_mentions: bool = False
    hashtags_as_words: bool = False
    mentions_as_words: bool = False
    split_hashtags: bool = False

    def __post_init__(self):
        if self.keep and self.drop:
            raise TypeError("give keep or drop, not both")
        for t in (*self.keep, *self.drop):
            if t not in TYPES:
                raise TypeError(f"unknown token type {t!r}")
        low, high = self.min_word_length, self.max_word_length
        if low is not None and high is not None and low >= high:
            raise TypeError("min_word_length must be under max_word_length")


def tokenize_text(text: str | None, options: Options = Options()) -> list[tuple[str, str]]:
    o = options
    text = text or ""
    if o.decode_html_entities:
        text = html.unescape(text)
    if o.unidecode:
        text = ascii_form(text)
    if o.reduce_words:
        text = regex.sub(r"(\p{L})\1{4,}", r"\1\1\1", text)
    stop = {w.lower() if o.lower else w for w in o.stoplist}
    out = []
    for kind, token in tokens_of(text):
        if (o.keep and kind not in o.keep) or kind in o.drop:
            continue
        made = [(kind, token)]
        if kind == "hashtag":
            if o.split_hashtags:
                made = [("number" if t.isdecimal() else "word", t) for t in split_hashtag(token)]
            elif o.hashtags_as_words:
                made = [("word", token[1:])]
            elif o.normalize_hashtags:
                made = [(kind, ascii_form(token).lower())]
        elif kind == "mention":
            if o.mentions_as_words:
                made = [("word", token[1:])]
            elif o.normalize_mentions:
                made = [(kind, token.lower())]
        for k, t in made:
            if k == "word":
                t = t.lower() if o.lower else t
                if (o.min_word_length and len(t) < o.min_word_length) or (o.max_word_length and len(t) > o.max_word_length):
                    continue
            if t not in stop:
                out.append((k, t))
    return out


_TOKENS = pa.struct([("type", pa.string()), ("value", pa.string())])


def token_lists(texts: pa.Array, options: Options = Options(), at_once: int = 256) -> pa.Array:
    """list<struct<type, value>> of texts; Python holds the tokens of ``at_once`` texts, the rest is in Arrow's arrays."""
    made = []
    for start in range(0, len(texts), at_once):
        kinds, values, ends = [], [], [0]
        for t in texts.slice(start, at_once).to_pylist():
            for k, v in tokenize_text(t, options):
                kinds.append(k)
                values.append(v)
            ends.append(len(values))
        tokens = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], fields=list(_TOKENS))
        made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens))
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(_TOKENS))


def tokenize(text: Column | str, **options) -> Column:
    """array<struct<type, value>> of a column's text."""
    made = Options(**{f.name: tuple(options[f.name]) if f.name in ("stoplist", "keep", "drop") else options[f.name] for f in fields(Options) if f.name in options})

    @F.arrow_udf("array<struct<type:string,value:string>>")
    def run(texts: pa.Array) -> pa.Array:
        found = token_lists(texts, made)
        pa.default_memory_pool().release_unused()
        return found

    return run(F.col(text) if isinstance(text, str) else text)
