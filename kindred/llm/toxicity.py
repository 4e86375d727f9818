"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Fitting takes at most ``max_rows`` labelled rows (a documented bound, drawn by a hash of the id, so
the same rows whatever the partitioning). From these rows the lexicons are learned too: whole words
and word beginnings that stand in many different surroundings in toxic rows and hardly in others. A
term must have several *distinct* neighbours, so that a family of copies counts as one witness.
Scoring is one pass over all rows; a model is a few hundred short strings and small trees.

Features: densities of lexicon words, of lexicon beginnings and of obfuscated lexicon words; second
person density and nearness to a hit; shares of capitals, of words in capitals, of punctuation, of
exclamation marks, of digits, and of obfuscated tokens; length.

Defined results: null text is the empty text and gets a score too; rows without label are scored
only; if the labels lack a class the score is their mean (0 without labels). Ids, languages and
sources are never read as features; a null id is not held out. Rows that repeat an id get a score
each; for fitting, one of an id's texts (the smallest) stands for it. An empty table gives no row. Extra
columns are not read, and ``keep_clean`` keeps them. Work is in proportion to a text's length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, let_go

# Second person words of the languages met.
SECOND_PERSON = frozenset(
    "you your yours yourself ya ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tus".split()
)
_LEET = str.maketrans("013457@$!", "oieastasi", "*._-")
#: Starts only where a run of letters starts, and runs give nothing back, so the work is linear.
_ODD = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*._-]++[^\W\d_]++)+")
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_DIGIT = np.arange(48, 58)
N_FEATURES = 14


class Lexicon:
    """Words and word beginnings, found in one pass by an automaton over the lower-cased text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self._automaton = None

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "_automaton": None}

    def hits(self, low: str) -> list[tuple[int, str, bool]]:
        """(start, term, whole word) of every hit at a word's start."""
        if not self.words and not self.stems:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w in {*self.words, *self.stems}:
                self._automaton.add_word(w, w)
            self._automaton.make_automaton()
        found = []
        for end, w in self._automaton.iter(low):
            start = end + 1 - len(w)
            if start and low[start - 1].isalpha():
                continue
            if w in self.stems:
                found.append((start, w, False))
            if w in self.words and (end + 1 == len(low) or not low[end + 1].isalpha()):
                found.append((start, w, True))
        return found

    def has(self, word: str) -> bool:
        return word in self.words or any(word.startswith(s) for s in self.stems)


def nearness(starts: list[int], low: str) -> float:
    """Share of the hits that have a second-person word within 80 characters to either side."""
    if not starts:
        return 0.0
    you = [m.span() for m in _WORD.finditer(low) if m.group() in SECOND_PERSON]
    if not you:
        return 0.0
    first, end = np.array(you).T
    at = np.array(starts)
    k = np.searchsorted(first, at - 80)
    return float(np.mean((k < len(end)) & (end[np.minimum(k, len(end) - 1)] <= at + 80)))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower()
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    letters = max(1, int(by[_UPPER].sum() + by[_LOWER].sum() + by[128:].sum()))
    n_words = 1 + int(by[32] + by[10] + by[9])
    hits = lexicon.hits(low)
    whole = [h for h in hits if h[2]]
    stems = {s for s, _, w in hits if not w}
    odd = _ODD.findall(low) if by[_DIGIT].sum() + by[_PUNCT].sum() else []
    odd_hits = sum(lexicon.has(x.translate(_LEET)) for x in odd)
    near = nearness([start for start, _, _ in hits], low)
    return [
        np.log1p(len(raw)),
        len(whole) / n_words,
        float(len(whole)),
        len(stems) / n_words,
        float(len(stems)),
        sum(lexicon.words[w] for _, w, _ in whole) / n_words,
        odd_hits / n_words,
        near,
        by[_UPPER].sum() / letters,
        len(_SHOUT.findall(text)) / n_words,
        by[_PUNCT].sum() / size,
        by[33] / size,
        by[_DIGIT].sum() / size,
        len(odd) / n_words,
    ]


def learn_lexicon(rows: list[tuple[str, int]], least: int = 6, log_odds: float = 2.5, most: int = 400) -> Lexicon:
    """Terms with at least ``least`` distinct surroundings in toxic rows, and this log odds at least."""
    around: dict[str, set] = defaultdict(set)
    stems: dict[str, set] = defaultdict(set)
    forms: dict[str, set] = defaultdict(set)
    toxic = [t for t, y in rows if y]
    clean = [t for t, y in rows if not y]
    for t in toxic:
        words = _WORD.findall(t.lower())
        for before, w, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
            if len(w) > 2:
                around[w].add(hash((before, after)))
            for k in range(4, min(len(w), 8)):
                stems[w[:k]].add(hash((before, w, after)))
                forms[w[:k]].add(w)
    keep_w = {w for w, c in around.items() if len(c) >= least}
    keep_s = {s for s, c in stems.items() if len(c) >= 2 * least and len(forms[s]) >= 3}
    plain: Counter = Counter()
    for t in clean:
        words = set(_WORD.findall(t.lower()))
        plain.update(words & keep_w)
        plain.update({"^" + w[:k] for w in words for k in range(4, min(len(w), 8)) if w[:k] in keep_s})
    in_toxic: Counter = Counter()
    for t in toxic:
        words = set(_WORD.findall(t.lower()))
        in_toxic.update(words & keep_w)
        in_toxic.update({"^" + w[:k] for w in words for k in range(4, min(len(w), 8)) if w[:k] in keep_s})

    def odds(term: str, seen: int) -> float:
        return float(np.log((min(seen, in_toxic[term]) + 0.5) / (len(toxic) + 1)) - np.log((plain[term] + 0.5) / (len(clean) + 1)))

    def best(scored):
        ranked = sorted(((o, w) for w, o in scored if o >= log_odds), key=lambda x: (-x[0], x[1]))
        return {w: o for o, w in ranked[:most]}

    return Lexicon(
        best((w, odds(w, len(around[w]))) for w in keep_w), best((s, odds("^" + s, len(stems[s]))) for s in keep_s)
    )


@dataclass
class BoostedTrees:
    """Gradient boosting for log loss; trees of fixed depth on binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    bins: int = 32
    prior: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        edges = [np.unique(np.concatenate((e, [c[c > c.min()].min() - 1e-12] if (c > c.min()).any() else []))) for e, c in zip(edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        width = max(len(e) for e in edges) + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.prior = float(np.log(p / (1 - p)))
        out = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-out))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                n = 1 << level
                best = np.zeros(n)
                feature, cut = np.zeros(n, np.int64), np.full(n, np.inf)
                at = np.full(n, width, np.int64)
                for f, b in enumerate(binned):
                    key = node * width + b
                    gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    k = gain[:, : len(edges[f])].argmax(1) if len(edges[f]) else np.zeros(n, np.int64)
                    top = gain[np.arange(n), k] if len(edges[f]) else np.zeros(n)
                    won = top > best + 1e-9
                    best[won], feature[won], at[won] = top[won], f, k[won]
                    if len(edges[f]):
                        cut[won] = edges[f][k[won]]
                splits.append((feature, cut))
                node = node * 2 + (binned[feature[node], np.arange(len(y))] > at[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((splits, value))
            out += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising step curve for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    at = np.array([e for b in blocks for e in (b[2], b[3])])
    to = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return at, to


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.base)
        raw = self.trees.predict(np.array([features(t, self.lexicon) for t in texts], float))
        # a thousandth of the raw probability keeps order within a flat piece of the curve
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(rows: list[tuple[str | None, int]], **options) -> ToxicityModel:
    """Fit on (text, label) rows; every fourth row is kept for the calibration curve."""
    rows = [(t or "", int(y)) for t, y in rows]
    labels = {y for _, y in rows}
    base = sum(y for _, y in rows) / max(1, len(rows))
    train, held = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    if len(labels) < 2 or len({y for _, y in train}) < 2 or len({y for _, y in held}) < 2:
        return ToxicityModel(Lexicon({}, {}), None, None, base)
    lexicon = learn_lexicon(train)
    table = lambda part: (np.array([features(t, lexicon) for t, _ in part], float), np.array([y for _, y in part], float))
    trees = BoostedTrees(**options).fit(*table(train))
    x, y = table(held)
    return ToxicityModel(lexicon, trees, isotonic(trees.predict(x), y), base)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    drawn = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = [(r["text"], r["toxic"], r["doc_id"]) for r in texts.toLocalIterator()]
    rows.sort(key=lambda r: (r[2] * 0x9E3779B97F4A7C15 % 2**64, r[0] or "", r[1]))
    return fit([r[:2] for r in rows], **options)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            s = np.concatenate([model.scores(b.column(2).slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )
        give_back()

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, whole; one pass, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield part.filter(pa.array(model.scores(part.column(at).to_pylist()) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
