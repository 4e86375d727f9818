"""SentencePiece encoding and decoding.

The model file is read directly (a protobuf of pieces with scores and types). An Aho-Corasick
automaton over the pieces is built once per worker; a text goes through it character by character.
At each position the pieces that end there are met by following output links, and each relaxes the
best score of the position: ``best[end] = max(best[end - len] + score)``. One pass, then the path
is read backwards. A character without a piece gets the unknown piece (the lowest score less 10) and
is written as its UTF-8 bytes' pieces where the model has byte fallback.

``Encoder("unigram")`` is that Viterbi over the model's scores. ``Encoder("bpe")`` keeps the automaton and
the single pass, but the piece that a position relaxes to is the one whose pair with the piece
before it merging leaves as it is, so its result is merge order's (what the library gives for a model
of type BPE). Either is cached by word, as pieces cross no space: every word begins with its space
mark, and texts are those words in order. A new word is cut between characters that no piece has side
by side, where every segmentation has a boundary; only parts not met before go through the automaton.

Normalising: spaces become U+2581, one is put in front if the model says so. A model with a character
map, or one that drops spaces, is refused. Decoding restores the text of any encoding here without
loss, runs of spaces included.

Defined results: null is the empty text, which has no ids; null ids, repeated rows and rows that share
an id get a result each; an empty table gives no row; extra columns are not read. Work and memory are
in proportion to a text's length.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: int, bytes, or the 4 or 8 bytes of a fixed one."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    bpe: bool
    byte_fallback: bool
    dummy_prefix: bool
    unk: int

    @staticmethod
    def load(path: str) -> Model:
        model = Model([], [], [], False, False, True, 0)
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    got = dict(_fields(value))
                    model.pieces.append(got.get(1, b"").decode())
                    model.scores.append(float(np.frombuffer(got.get(2, b"\0" * 4), "<f4")[0]))
                    model.types.append(got.get(3, NORMAL))
                elif field == 2:
                    spec = dict(_fields(value))
                    model.bpe, model.byte_fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
                elif field == 3:
                    spec = dict(_fields(value))
                    model.dummy_prefix = bool(spec.get(3, 1))
                    if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                        raise ValueError(f"{path}: only models that keep texts as they are can be read")
        model.unk = model.types.index(UNKNOWN)
        return model


class Automaton:
    """Aho-Corasick over pieces. ``out[s]`` is the piece that ends a state, ``up[s]`` its output link."""

    def __init__(self, pieces: dict[str, int]):
        self.edges: list[dict[str, int]] = [{}]
        self.out = [-1]
        for text, number in pieces.items():
            s = 0
            for ch in text:
                to = self.edges[s].get(ch)
                if to is None:
                    to = len(self.edges)
                    self.edges[s][ch] = to
                    self.edges.append({})
                    self.out.append(-1)
                s = to
            self.out[s] = number
        self.fail = [0] * len(self.edges)
        self.up = [0] * len(self.edges)
        queue = deque(self.edges[0].values())
        while queue:
            s = queue.popleft()
            for ch, to in self.edges[s].items():
                f = self.fail[s]
                while f and ch not in self.edges[f]:
                    f = self.fail[f]
                f = self.edges[f].get(ch, 0)
                self.fail[to] = f
                self.up[to] = f if self.out[f] >= 0 else self.up[f]
                queue.append(to)
        self.kept = 0

    def step(self, s: int, ch: str) -> int:
        """The state after ``ch``; one found by failure links is kept as a transition of ``s``."""
        at = s
        while at and ch not in self.edges[at]:
            at = self.fail[at]
        to = self.edges[at].get(ch, 0)
        if self.kept < 2_000_000 and s:
            self.edges[s][ch] = to
            self.kept += 1
        return to

    def ends(self, s: int) -> list[int]:
        """Pieces that end in a state, the longest first, by its output links."""
        found, at = [], s if self.out[s] >= 0 else self.up[s]
        while at:
            found.append(self.out[at])
            at = self.up[at]
        return found


class _Recent:
    """A cache of two generations: the full young one becomes the old one, and what is met again moves over."""

    def __init__(self, room: int):
        self.room, self.young, self.old = room, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.room:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Ids of a text; ``how`` is "unigram", "bpe", "both" or None for the model's own type."""

    def __init__(self, path: str, how: str | None = None, room: int = 300_000):
        self.model = m = Model.load(path)
        self.how = how or ("bpe" if m.bpe else "unigram")
        usable = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, USER) and p}
        self.ids = usable
        self.automaton = Automaton(usable)
        self.unknown_score = min((s for s, t in zip(m.scores, m.types, strict=True) if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == BYTE}
        self.shown = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode()
            for p, t in zip(m.pieces, m.types, strict=True)
        ]
        self.ends = [
            tuple((len(m.pieces[p]), m.scores[p], p) for p in self.automaton.ends(s))
            for s in range(len(self.automaton.out))
        ]
        beside: dict[str, set[str]] = {}
        for p in usable:
            for x, y in zip(p, p[1:]):
                beside.setdefault(x, set()).add(y)
        self.beside = {x: frozenset(y) for x, y in beside.items()}
        self.words_met, self.parts_met = _Recent(room), _Recent(room)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    # -- encoding

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    _WORD = re.compile(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", re.S)

    def words(self, text: str) -> list:
        """Keys of the words: a string lacks its space mark, a tuple holds a first word without one.

        A run of spaces stays with the word behind it.
        """
        if not text:
            return []
        if self.model.dummy_prefix and text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [w[1:] if w[0] == SPACE else (w,) for w in self._WORD.findall(self.normalise(text))]

    def encode_words(self, keys: list) -> list[tuple[bytes, ...]]:
        """Of each word its ids as little-endian unsigned 32-bit numbers, one result for each way of this encoder."""
        met = self.words_met.young
        try:
            return [met[w] for w in keys]
        except KeyError:
            pass
        out = []
        for w in keys:
            got = met.get(w)
            if got is None:
                got = self.words_met.get(w)
                if got is None:
                    got = self._new_word(w[0] if isinstance(w, tuple) else SPACE + w)
                    if len(w) <= 64:
                        self.words_met.put(w, got)
                met = self.words_met.young
            out.append(got)
        return out

    def _new_word(self, word: str) -> tuple[bytes, ...]:
        beside, none = self.beside, frozenset()
        cuts = [k for k, y in enumerate(word[1:], 1) if y not in beside.get(word[k - 1], none)]
        if cuts and not self.model.byte_fallback:  # neighbours without a piece are one unknown piece
            cuts = [k for k in cuts if word[k - 1] in self.ids or word[k] in self.ids]
        parts = [word[start:end] for start, end in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]
        out = []
        for part in parts:
            ids = self.parts_met.get(part)
            if ids is None:
                ids = self._new_part(part)
                if len(part) <= 64:
                    self.parts_met.put(part, ids)
            out.append(ids)
        if len(out) > 1:
            out[0] = tuple(b"".join(x) if isinstance(x[0], bytes) else all(x) for x in zip(*out))
        return out[0]

    def _new_part(self, part: str) -> tuple:
        """(Viterbi's ids, merge order's ids, whether the first are the part's bytes) or the one that is asked for."""
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        if self.how != "both":
            return (pack(self.encode_word(part)),)
        path, merged = self._both(part)
        ids = self._ids(part, path)
        shown = b"".join([self.shown[i] for i in ids]) == part.encode("utf-8", "surrogatepass")
        return pack(ids), pack(ids if path == merged else self._ids(part, merged)), shown

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join([x[0] for x in self.encode_words(self.words(text or ""))])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def encode_word(self, word: str) -> list[int]:
        return self._ids(word, self._viterbi(word) if self.how == "unigram" else self._merge_path(word))

    def _ids(self, word: str, path: list[tuple[int, int, int]]) -> list[int]:
        ids: list[int] = []
        for start, end, piece in path:
            if piece != self.model.unk:
                ids.append(piece)
            elif self.model.byte_fallback and self.bytes:
                ids += [self.bytes[b] for b in word[start:end].encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.model.unk:
                ids.append(self.model.unk)
        return ids

    def _viterbi(self, word: str) -> list[tuple[int, int, int]]:
        """One pass: each position's best score is relaxed by every piece that ends there.

        Of equal scores the one with the longer last piece wins.
        """
        auto, ends, unk = self.automaton, self.ends, self.model.unk
        edges = auto.edges
        best, back = [0.0], [(0, unk)]
        s = 0
        for end, ch in enumerate(word, 1):
            to = edges[s].get(ch)
            s = auto.step(s, ch) if to is None else to
            found = ends[s]
            top, how = float("-inf"), None
            for size, score, piece in found:
                value = best[end - size] + score
                if value > top:
                    top, how = value, (end - size, piece)
            if not found or found[-1][0] > 1:
                value = best[end - 1] + self.unknown_score
                if value > top:
                    top, how = value, (end - 1, unk)
            best.append(top)
            back.append(how)
        return self._back(back, len(word))

    @staticmethod
    def _back(back, end: int) -> list[tuple[int, int, int]]:
        path = []
        while end:
            start, piece = back[end]
            path.append((start, end, piece))
            end = start
        return path[::-1]

    # -- merge order

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece`` when its text is merged alone; None for a single one."""
        if piece in self._parts:
            return self._parts[piece]
        text = self.model.pieces[piece]
        got = None
        if len(text) > 1:
            parts = self._merge(text, stop=True)
            got = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 and all(p in self.ids for p in parts) else None
        self._parts[piece] = got
        return got

    def _merge(self, text: str, stop: bool = False) -> list[str]:
        """Merging by score, leftmost first, by a heap of neighbours; with ``stop`` it ends with two parts left."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(parts):
                both = parts[k] + parts[after[k]]
                if (i := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.model.scores[i], k, both))

        for k in range(len(parts) - 1):
            offer(k)
        count = len(parts)
        while heap and count > (2 if stop else 1):
            _, k, both = heapq.heappop(heap)
            if not parts[k] or after[k] >= len(parts) or parts[k] + parts[after[k]] != both:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = both, "", after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            count -= 1
            offer(k)
            offer(before[k])
        return [p for p in parts if p]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces leaves exactly these two."""
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > 500_000:
                self._fits.clear()
            p, q = self.model.pieces[a], self.model.pieces[b]
            self._fits[key] = self._merge(p + q) == [p, q]
        return self._fits[key]

    def _merge_path(self, word: str) -> list[tuple[int, int, int]]:
        """One pass: a position's last piece is the longest that merging leaves beside the piece before it."""
        auto, ends, unk, fits = self.automaton, self.ends, self.model.unk, self._fits
        edges = auto.edges
        back: list[tuple[int, int] | None] = [(0, unk)]
        s = 0
        for end, ch in enumerate(word, 1):
            to = edges[s].get(ch)
            s = auto.step(s, ch) if to is None else to
            found, how = ends[s], None
            for size, _, piece in found:
                start = end - size
                before = back[start]
                if before is None or (size > 1 and self._halves(piece) is None):
                    continue
                if start == 0 or before[1] == unk:
                    how = (start, piece)
                    break
                fit = fits.get((before[1], piece))
                if fit if fit is not None else self._fit(before[1], piece):
                    how = (start, piece)
                    break
            if how is None and (not found or found[-1][0] > 1):
                how = (end - 1, unk)
            back.append(how)
        if back[len(word)] is None:  # pieces that merging cannot make: fall back to merging itself
            out, at = [], 0
            for p in self._merge(word):
                out.append((at, at + len(p), self.ids.get(p, unk)))
                at += len(p)
            return out
        return self._back(back, len(word))

    def _both(self, word: str) -> tuple[list, list]:
        """The paths of ``_viterbi`` and ``_merge_path`` by one walk of the automaton."""
        auto, ends, unk, fits, unknown = self.automaton, self.ends, self.model.unk, self._fits, self.unknown_score
        edges, parts = auto.edges, self._parts
        best, back = [0.0], [(0, unk)]
        last: list[tuple[int, int] | None] = [(0, unk)]
        s = end = 0
        for ch in word:
            end += 1
            to = edges[s].get(ch)
            s = auto.step(s, ch) if to is None else to
            found = ends[s]
            top, how, joined = float("-inf"), None, None
            for size, score, piece in found:
                start = end - size
                value = best[start] + score
                if value > top:
                    top, how = value, (start, piece)
                if joined is None:
                    before = last[start]
                    if before is not None and (size == 1 or (parts[piece] if piece in parts else self._halves(piece)) is not None):
                        if start == 0 or before[1] == unk:
                            joined = (start, piece)
                        else:
                            fit = fits.get((before[1], piece))
                            if fit if fit is not None else self._fit(before[1], piece):
                                joined = (start, piece)
            if not found or found[-1][0] > 1:
                value = best[end - 1] + unknown
                if value > top:
                    top, how = value, (end - 1, unk)
                if joined is None:
                    joined = (end - 1, unk)
            best.append(top)
            back.append(how)
            last.append(joined)
        merged = self._back(last, end) if last[end] is not None else self._merge_path(word)
        return self._back(back, end), merged

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The text; a text's first space mark is the one that encoding put there."""
        shown = self.shown
        text = b"".join([shown[i] for i in ids]).decode("utf-8", "surrogatepass" if self.model.byte_fallback else "replace")
        if self.model.dummy_prefix:
            text = text.removeprefix(SPACE)
        return text.replace(SPACE, " ")


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder_at(path: str, how: str | None) -> Encoder:
    """One per worker process."""
    if (path, how) not in _ENCODERS:
        _ENCODERS[path, how] = Encoder(path, how)
    return _ENCODERS[path, how]


def encode(docs: DataFrame, model_path: str, how: str = "unigram") -> DataFrame:
    """(doc_id, ids): ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_at(model_path, how)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_at(model_path, "unigram")
        for b in batches:
            texts = [e.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_report(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_merged, merged_crc32, round_trip) of every whole text.

    The first pair is the Viterbi segmentation, the second merge order's; ids are digested as
    little-endian unsigned 32-bit numbers. ``round_trip`` is whether decoding gives the text back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_at(model_path, "both")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = e.encode_words(e.words(text.as_py() or ""))
                ids, merged = b"".join([x[0] for x in parts]), b"".join([x[1] for x in parts])
                same = all([x[2] for x in parts])
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), len(merged) // 4, zlib.crc32(merged), same))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            names = ["doc_id", "n_tokens", "ids_crc32", "n_merged", "merged_crc32", "round_trip"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, n_merged long, merged_crc32 long, round_trip boolean"
    )
