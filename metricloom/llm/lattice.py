"""Subword pieces over all segmentations of a word, for many words at once.

A word's lattice has an edge for every stretch of its bytes that is a piece. Pieces that open a word (in a
vocabulary those with a space in front, and the space alone) are apart from pieces that go on within one,
and each kind is normalised by itself; after a piece the word ends with the probability ``stop``, or goes on.
Every byte that can stand in a word is a piece, so each word has a segmentation, and the probabilities of all
words sum to 1.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 512  # longer words are walked one by one, in chunks of CHUNK places
CHUNK = 1 << 16
#: Bytes of words in lower case: neither white space nor A-Z.
IN_WORDS = tuple(b for b in range(256) if b not in b" \t\n\x0b\x0c\r" and not 65 <= b <= 90)


def load_pieces(path: str) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece model with their weights, for texts in lower case: those with A-Z or with white
    space inside can't occur. The scores of a unigram model are logarithms of weights. Those of a byte-pair
    model are ranks, whole numbers; a piece then weighs 1 / (rank + 3), as frequencies fall with ranks."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path!r}: name a sentencepiece model by the parameter `vocabulary`")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece == piece.lower() and not (set(piece[1:]) | set(piece[:1]) - {32}) & set(b" \t\n\x0b\x0c\r") and model.get_score(i) > -1e8:
                found.setdefault(piece, model.get_score(i))
    ranked = sorted(found, key=found.get, reverse=True)
    if all(s == int(s) for s in found.values()):
        return [(x, 1 / (k + 3)) for k, x in enumerate(ranked)]
    return [(x, math.exp(found[x])) for x in ranked]


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Lattice:
    """The log probabilities of pieces, by length as sorted hashes. ``pieces``: bytes and weight; a piece with a
    space in front opens words. Bytes that no piece holds, and the space alone, weigh as little as the least."""

    def __init__(self, pieces: list[tuple[bytes, float]], stop: float = 0.5):
        """Pieces of weight 0 can't be used, apart from single bytes."""
        pieces = [(x, w) for x, w in pieces if w > 0]
        least = min((w for _, w in pieces), default=1.0)
        weights = dict(pieces)
        for b in IN_WORDS:
            weights.setdefault(bytes([b]), least)
        weights.setdefault(b" ", least)
        self.stop = math.log(stop)
        self.opening = self._normal({x[1:]: w for x, w in weights.items() if x[:1] == b" "}, 0.0)
        self.opening[b""] -= math.log(1 - stop)  # after the space alone the word must go on
        self.inner = self._normal({x: w for x, w in weights.items() if x[:1] != b" "}, math.log(1 - stop))
        #: All pieces in order; a table has their places.
        self.pieces = [b" " + x for x in self.opening] + list(self.inner)
        self.logp = np.array([*self.opening.values(), *self.inner.values()])
        self.open_tables, self.tables = self._tables(self.opening, 0), self._tables(self.inner, len(self.opening))
        self.longest = max(self.tables)
        with np.errstate(over="ignore"):
            self.powers = [np.uint64(1)]
            for _ in range(max(self.longest, *self.open_tables)):
                self.powers.append(self.powers[-1] * _BASE)

    @staticmethod
    def _normal(weights: dict[bytes, float], plus: float) -> dict[bytes, float]:
        total = sum(weights.values())
        return {x: math.log(w / total) + plus for x, w in weights.items()}

    @staticmethod
    def _tables(logp: dict[bytes, float], first: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by: dict[int, list[tuple[int, int]]] = {}
        for place, x in enumerate(logp, first):
            by.setdefault(len(x), []).append((_hash(x), place))
        tables = {}
        for size in sorted(by):
            rows = sorted(by[size])
            keys = np.array([r[0] for r in rows], np.uint64)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
            tables[size] = (keys, np.array([r[1] for r in rows], np.int32))
        return tables

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """log of each word's probability, summed over all its segmentations."""
        out = np.zeros(len(words))
        for places, rows in by_length([w if len(w) <= LONG else b"" for w in words]):
            out[places] = self.forward(rows)
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.walk(w)
        return out

    def _opened(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the edges that open words of equal length."""
        h = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for end in range(min(words.shape[1], max(self.open_tables)) + 1):
                if end:
                    h = h * _BASE + (words[:, end - 1].astype(np.uint64) + np.uint64(1))
                if end in self.open_tables:
                    yield end, *_found(*self.open_tables[end], h)

    def _inner(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, pieces) of all other edges, by end. Only the last places that a piece can reach back
        to are held."""
        held = self.longest + 1
        prefix = np.zeros((held, len(words)), np.uint64)
        with np.errstate(over="ignore"):
            for end in range(1, words.shape[1] + 1):
                h = prefix[(end - 1) % held] * _BASE + (words[:, end - 1].astype(np.uint64) + np.uint64(1))
                for length, table in self.tables.items():
                    if length > end:
                        break
                    rows, ids = _found(*table, h - prefix[(end - length) % held] * self.powers[length])
                    if len(rows):
                        yield end, length, rows, ids
                prefix[end % held] = h

    def forward(self, words: np.ndarray) -> np.ndarray:
        """The recursion over rows of equal length."""
        n, size = words.shape
        held = self.longest + 1
        opened = {end: (rows, ids) for end, rows, ids in self._opened(words)}
        alpha, at = np.full((held, n), -np.inf), 0

        def begin(end: int) -> None:
            alpha[end % held] = -np.inf
            if end in opened:
                alpha[end % held, opened[end][0]] = self.logp[opened[end][1]]

        begin(0)
        for end, length, rows, ids in self._inner(words):
            while at < end:
                at += 1
                begin(at)
            alpha[end % held, rows] = np.logaddexp(alpha[end % held, rows], alpha[(end - length) % held, rows] + self.logp[ids])
        return alpha[size % held] + self.stop

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over all segmentations of all words, by the forward and backward recursions."""
        total = np.zeros(len(self.pieces))
        for _, rows in by_length([w if len(w) <= LONG else b"" for w in words]):
            for at in range(0, len(rows), 1 << 12):  # all edges of a block are held
                total += self._expected(rows[at : at + (1 << 12)])
        for w in words:
            if len(w) > LONG:
                self._walk_back(w, total)
        return total

    def _expected(self, words: np.ndarray) -> np.ndarray:
        n, size = words.shape
        opened, edges = list(self._opened(words)), list(self._inner(words))
        alpha, beta = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        for end, rows, ids in opened:
            alpha[end, rows] = self.logp[ids]
        for end, length, rows, ids in edges:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - length, rows] + self.logp[ids])
        beta[size] = 0.0
        total = np.zeros(len(self.pieces))
        for end, length, rows, ids in reversed(edges):
            through = self.logp[ids] + beta[end, rows]
            beta[end - length, rows] = np.logaddexp(beta[end - length, rows], through)
            total += np.bincount(ids, np.exp(alpha[end - length, rows] + through - alpha[size, rows]), len(total)) if len(rows) > 64 else 0
            if len(rows) <= 64:
                np.add.at(total, ids, np.exp(alpha[end - length, rows] + through - alpha[size, rows]))
        for end, rows, ids in opened:
            np.add.at(total, ids, np.exp(self.logp[ids] + beta[end, rows] - alpha[size, rows]))
        return total

    def _chunk(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, lengths, pieces), by end, of the edges of one word that end after low and up to high."""
        first = max(0, low + 1 - self.longest)
        wide, ends, sizes, found = data[first:high].astype(np.uint64) + np.uint64(1), [], [], []
        with np.errstate(over="ignore"):
            h = np.zeros(len(wide) + 1, np.uint64)
            for length in range(1, min(self.longest, len(wide)) + 1):
                h = h[:-1] * _BASE + wide[length - 1 :]
                if length in self.tables:
                    at, ids = _found(*self.tables[length], h)
                    end = at + first + length
                    new = end > low
                    ends.append(end[new])
                    sizes.append(np.full(new.sum(), length))
                    found.append(ids[new])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        return end[order], np.concatenate(sizes)[order], np.concatenate(found)[order]

    def _opening_of(self, word: bytes) -> dict[int, float]:
        return {k: self.opening[word[:k]] for k in self.open_tables if k <= len(word) and word[:k] in self.opening}

    def walk(self, word: bytes, kept: list[float] | None = None) -> float:
        """The same for one word of any length: the edges of a chunk of places at once, then place by place.
        ``kept`` gets the recursion's value at every place."""
        data, size, back, opened = np.frombuffer(word, np.uint8), len(word), self.longest, self._opening_of(word)
        alpha = [-math.inf] * back + [opened[0]]  # of the places from -back to 0
        for low in range(0, size, CHUNK):
            high = min(size, low + CHUNK)
            end, length, ids = self._chunk(data, low, high)
            alpha = alpha[-back - 1 :] + [opened.get(k, -math.inf) for k in range(low + 1, high + 1)]
            for e, n, p in zip((end + (back - low)).tolist(), length.tolist(), self.logp[ids].tolist(), strict=True):
                alpha[e] = _log_add(alpha[e - n] + p, alpha[e])
            if kept is not None:
                kept += alpha[back + (low > 0) :]
        return alpha[-1] + self.stop

    def _walk_back(self, word: bytes, total: np.ndarray) -> None:
        """Add the expected uses in one long word."""
        data, size, alpha = np.frombuffer(word, np.uint8), len(word), []
        whole = self.walk(word, alpha) - self.stop
        beta = [-math.inf] * size + [0.0]
        for low in range((size - 1) // CHUNK * CHUNK, -1, -CHUNK):
            end, length, ids = self._chunk(data, low, min(size, low + CHUNK))
            for e, n, p, k in zip(end[::-1].tolist(), length[::-1].tolist(), self.logp[ids][::-1].tolist(), ids[::-1].tolist(), strict=True):
                through = p + beta[e]
                beta[e - n] = _log_add(through, beta[e - n])
                total[k] += math.exp(alpha[e - n] + through - whole)
        for k, p in self._opening_of(word).items():
            total[self.pieces.index(b" " + word[:k])] += math.exp(p + beta[k] - whole)


def _log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def _found(keys: np.ndarray, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are keys, and their pieces."""
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == h)
    return hit, ids[at[hit]]


def by_length(words: list[bytes], most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of bytes) of words of equal length, in bounded blocks; words without a byte are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = int((sizes == 0).sum())
    while at < len(order):
        size = int(sizes[order[at]])
        n = max(1, min(most, (1 << 22) // size + 1))
        end = min(int(np.searchsorted(sizes[order], size, side="right")), at + n)
        places = order[at:end]
        yield places, np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(len(places), size)
        at = end
