"""Piece lattices of many strings at once: edges, and the log-space forward and backward recursions over them."""

from __future__ import annotations

import base64

import numpy as np

_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Strings longer than this are looked up piece by piece; shorter ones all at once by length.
LONG = 40


class Vocabulary:
    """Pieces (distinct, not empty) with log weights; finds those among all substrings of a matrix of equally long strings."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, np.float64)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.shift = np.uint64(64 - 22)
        with np.errstate(over="ignore"):
            slots = (self.hashes * _MIX) >> self.shift
        self.first = np.full(1 << 22, -1, np.int32)
        order = np.arange(len(pieces) - 1, -1, -1)
        self.first[slots[order]] = order  # of pieces that share a slot the first stays here,
        rest = np.flatnonzero(self.first[slots] != np.arange(len(pieces)))
        self.rest_hash = np.sort(self.hashes[rest])  # and the others are in a sorted list
        self.rest_id = rest[np.argsort(self.hashes[rest])].astype(np.int32)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = len(piece)
        for b in piece:
            h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        slot = self.first[(h * _MIX) >> self.shift]
        hit = (slot >= 0) & (self.hashes[slot] == h)
        at = np.where(hit, slot, -1)
        if len(self.rest_hash):  # only a slot that another piece holds can stand for one of the rest
            lost = np.flatnonzero((slot >= 0) & ~hit)
            where = np.minimum(np.searchsorted(self.rest_hash, h[lost]), len(self.rest_hash) - 1)
            at[lost] = np.where(self.rest_hash[where] == h[lost], self.rest_id[where], -1)
        return at


class Lattice:
    """The edges of strings of one length: steps (start, end, rows, pieces), ordered by end."""

    def __init__(self, vocabulary: Vocabulary, strings: list[bytes]):
        self.vocabulary, self.rows, self.length = vocabulary, len(strings), len(strings[0])
        self.steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if self.length > LONG:
            self._one_by_one(strings)
            return
        chars = np.frombuffer(b"".join(strings), np.uint8).reshape(self.rows, self.length).T.astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            power = [np.uint64(1)]
            for _ in range(self.length):
                power.append(power[-1] * _BASE)
            # sums[j] is the hash of the first j bytes without the length; a substring's follows from two of them.
            sums = [np.zeros(self.rows, np.uint64)]
            for c in chars:
                sums.append(sums[-1] * _BASE + c)
            for j in range(1, self.length + 1):
                for i in range(max(0, j - vocabulary.longest), j):
                    n = j - i
                    ids = vocabulary.find(sums[j] - sums[i] * power[n] + np.uint64(n) * power[n])
                    rows = np.flatnonzero(ids >= 0)
                    if len(rows):
                        self.steps.append((i, j, rows, ids[rows]))

    def _one_by_one(self, strings: list[bytes]) -> None:
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        ids, longest = self.vocabulary.ids, self.vocabulary.longest
        for r, s in enumerate(strings):
            for j in range(1, len(s) + 1):
                for i in range(max(0, j - longest), j):
                    p = ids.get(s[i:j])
                    if p is not None:
                        rows, pieces = found.setdefault((j, i), ([], []))
                        rows.append(r)
                        pieces.append(p)
        self.steps = [(i, j, np.array(found[j, i][0]), np.array(found[j, i][1], np.int32)) for j, i in sorted(found)]

    def forward(self) -> np.ndarray:
        """alpha[j, row]: log of the summed weight of all segmentations of the first j bytes."""
        alpha = np.full((self.length + 1, self.rows), -np.inf)
        alpha[0] = 0.0
        logp = self.vocabulary.logp
        for i, j, rows, ids in self.steps:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logp[ids])
        return alpha

    def expected(self, counts: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds to out the expected use of every piece in counts[row] copies of the strings; returns the log marginals."""
        alpha, beta, logp = self.forward(), np.full((self.length + 1, self.rows), -np.inf), self.vocabulary.logp
        beta[self.length] = 0.0
        for i, j, rows, ids in reversed(self.steps):
            weight = logp[ids] + beta[j, rows]
            beta[i, rows] = np.logaddexp(beta[i, rows], weight)
        total = alpha[self.length]
        for i, j, rows, ids in self.steps:
            share = np.exp(alpha[i, rows] + logp[ids] + beta[j, rows] - total[rows])
            out += np.bincount(ids, share * counts[rows], len(out))
        return total


def by_length(strings: list[bytes], most: int = 20_000):
    """(numbers, strings) of groups of one length each, of at most `most` bytes in strings longer than LONG."""
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        groups.setdefault(len(s), []).append(i)
    for length, at in groups.items():
        size = most if length <= LONG else max(1, most // length)
        for k in range(0, len(at), size):
            yield np.array(at[k : k + size]), [strings[i] for i in at[k : k + size]]


def marginals(vocabulary: Vocabulary, strings: list[bytes]) -> np.ndarray:
    """The log marginal weight of each string (none is empty): the sum over all its segmentations."""
    out = np.empty(len(strings))
    for at, group in by_length(strings):
        out[at] = Lattice(vocabulary, group).forward()[-1]
    return out


def rank_weights(ranks: np.ndarray, offset: float = 10.0) -> np.ndarray:
    """Log weights for a vocabulary that is scored by rank only, by Zipf's law."""
    w = 1.0 / (ranks + offset)
    return np.log(w / w.sum())


def load_ranked(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and ranks of a file of base64 pieces with ranks; only pieces without inner white space can occur in a word."""
    pieces, ranks = [], []
    with open(path, "rb") as f:
        for line in f:
            raw, _, rank = line.strip().partition(b" ")
            piece = base64.b64decode(raw)
            if piece and not any(c in b" \t\n\x0b\x0c\r" for c in piece[1:]) and piece[:1] not in b"\t\n\x0b\x0c\r":
                pieces.append(piece)
                ranks.append(int(rank))
    return pieces, np.array(ranks, np.float64)
