"""Two-stage suffix sorting of many short strings, and the classes of equal prefixes that it yields.

A suffix is of type B when it is smaller than the one that starts a byte later, of type A otherwise. Only type B is
sorted directly. All of type A follows from it by one scan over the buckets of first bytes in ascending order: what
stands before a sorted suffix is placed, in that order, at the head of its own bucket.
"""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> np.ndarray:
    """The strings with a zero after each; bytes count one more than they are, which UTF-8 leaves room for."""
    return (np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)) if strings else np.empty(0, np.uint8)


def _left(buf: np.ndarray) -> np.ndarray:
    """Bytes from each position to the end of its string."""
    stops = np.flatnonzero(buf == 0)
    return np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(buf))


def _word(loads: np.ndarray, left: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k..8k+7 of the suffixes at `at` as a number that sorts like them; zero beyond the string's end."""
    room = np.clip(left[at] - 8 * k, 0, 8).astype(np.uint64)
    word = loads[np.minimum(at + 8 * k, len(loads) - 1)].byteswap()
    gone = (np.uint64(8) - room) * np.uint64(8)
    return np.where(room == 0, np.uint64(0), word >> np.minimum(gone, np.uint64(63)) << np.minimum(gone, np.uint64(63)))


def _loads(buf: np.ndarray) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(72, np.uint8)])
    return np.ndarray((len(buf) + 64,), "<u8", padded.tobytes(), 0, (1,))


def _direct(loads: np.ndarray, left: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`at` in the order of the suffixes' first `depth` bytes: by words, each only among those that tie so far."""
    first = _word(loads, left, at, 0)
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    new = np.ones(len(at), bool)
    new[1:] = first[1:] != first[:-1]
    for k in range(1, (depth + 7) // 8):
        group = np.cumsum(new)
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        word, g = _word(loads, left, at[tied], k), group[tied]
        order = np.lexsort((word, g))
        at[tied], word = at[tied][order], word[order]
        split = np.zeros(len(tied), bool)
        split[1:] = word[1:] != word[:-1]
        new[tied] |= split
    return at


def _needed(buf: np.ndarray, type_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True for each string's positions up to `last` and from there to the next that is of type B or ends the string.

    A suffix of type A follows from its successor, so these are all that the order of the first ones depends on.
    """
    ends = type_b.copy()
    ends[:-1] |= buf[1:] == 0
    at = np.flatnonzero(ends & (buf != 0))
    edge = np.zeros(len(buf) + 1, np.int8)
    begins = np.r_[0, np.flatnonzero(buf == 0)[:-1] + 1]
    some = last >= begins
    np.add.at(edge, begins[some], 1)
    np.subtract.at(edge, at[np.searchsorted(at, last[some])] + 1, 1)
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def suffix_array(buf: np.ndarray, depth: int = 56, last: np.ndarray | None = None) -> np.ndarray:
    """The positions of joined strings, without the zeros, in the order of their suffixes' first `depth` bytes.

    A suffix ends with its string; those that agree so far stand together in any order. With `last`, a position in each
    string (or one before it for none), only the suffixes up to there and those that their order follows from.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    turns = np.flatnonzero(buf[:-1] != buf[1:]) if n > 1 else np.empty(0, np.int64)
    type_b = np.zeros(n, bool)
    if len(turns):
        type_b[: turns[-1] + 1] = np.repeat(buf[turns] < buf[turns + 1], np.diff(turns, prepend=-1))
    zero = buf == 0
    left, loads = _left(buf), _loads(buf)
    type_b &= ~zero
    type_a = ~type_b & ~zero
    if last is not None:
        needed = _needed(buf, type_b, last)
        type_a &= needed
        type_b &= needed
    direct = _direct(loads, left, np.flatnonzero(type_b), depth)
    cuts = np.searchsorted(buf[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]

    def place(done: np.ndarray, c: int) -> None:
        before = done[done > 0] - 1
        before = before[type_a[before] & (buf[before] > c)]
        heads = buf[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        for part in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1) if len(before) else []:
            queues[buf[part[0]]].append(part)

    place(np.flatnonzero(zero), 0)
    out = []
    for c in range(1, 256):
        bucket = [*queues[c]]
        queues[c] = []
        wave = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
        while len(wave):  # runs of one byte: each suffix stands before one of the last wave
            before = wave[wave > 0] - 1
            wave = before[type_a[before] & (buf[before] == c)]
            bucket.append(wave)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        done = np.concatenate(bucket)
        if len(done):
            place(done, c)
            out.append(done)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(buf: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each of `order` but the first, the common prefix with the one before it, in bytes, `depth` at most."""
    left, loads = _left(buf), _loads(buf)
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    same = np.arange(len(lcp))
    for k in range((depth + 7) // 8):
        if not len(same):
            break
        a, b = order[same], order[same + 1]
        differ = _word(loads, left, a, k) ^ _word(loads, left, b, k)
        lcp[same] = 8 * k + sum((differ >> np.uint64(64 - 8 * i) == 0).astype(np.int64) for i in range(1, 8)) + (differ == 0)
        same = same[differ == 0]
    short = np.minimum(left[order[:-1]], left[order[1:]]) if len(order) else lcp
    return np.minimum(np.minimum(lcp, short), depth)


def prefix_classes(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of every start in joined strings that has `depth` bytes before its string ends; equal bytes share a class."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = suffix_array(buf, depth, np.flatnonzero(buf == 0) - depth)
    order = order[_left(buf)[order] >= depth]
    new = np.ones(len(order), np.int64)
    new[1:] = common_prefixes(buf, order, depth) < depth
    return order, np.cumsum(new) - 1
