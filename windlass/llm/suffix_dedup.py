"""Suffix-array dedup: removes every byte covered by a string that also starts in a document with a smaller doc_id.

Equal strings of SPAN bytes have the same minimizer (the least hash of the SHORT-byte strings inside), so a partition by
minimizer brings all of them together, and one suffix array per partition finds every match between any two documents.

1. The rows are written once to files of the shared folder; each file is a unit of work that any task can repeat.
2. A sample of the files names hot minimizers, such as a line or phrase that stands in countless contexts. Windows with one
   of these go by the hash of all their SPAN bytes instead, which spreads them over all partitions. The sample only says
   which way a window takes, the same in every file; no result depends on it.
3. Every file reports its distinct keys (minimizers, or hashes of hot windows) to their buckets; a bucket replies which
   occur in two documents or more.
4. For these, every file sends its distinct segments (neighbouring windows about one place of a minimizer, or one hot
   window) with the least doc_id. A passage of any number of copies so leaves a file once, and a text that repeats itself
   sends each turn once.
5. A bucket sorts the suffixes of its segments in two stages, takes adjacent common prefixes, and replies the least
   doc_id of every window's class.
6. Every file marks the windows whose class has a smaller doc_id than their own document, and reports per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .suffix_array import prefix_classes
from .units import Units, arrow_table, pack, read_unit, unpack

SPAN, SHORT = 50, 16
#: Windows that are hashed at once, and stored text bytes per bucket.
SLICE, BUCKET_BYTES = 1_000_000, 1_000_000
#: A minimizer is hot when about so many windows' runs have it, by its count in the sampled files that have it SEEN times.
HOT, SEEN = 2_048, 4
#: At most so many minimizers are hot, the most frequent ones; others keep the segments' way.
MOST_HOT = 200_000
#: The doc_id of rows without one: no other is larger.
LAST = np.iinfo(np.int64).max
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray, word: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) + word
        x *= _K[turn % 3]
    return x


def _hashes(load: np.ndarray, a: int, b: int) -> np.ndarray:
    """A hash of the SHORT = 16 bytes from each of the positions a .. b - 1; load[i] is the 8 bytes from i."""
    with np.errstate(over="ignore"):
        x = load[a:b] * _K[0]
        x ^= x >> np.uint64(32)
        x += load[a + 8 : b + 8]
        x *= _K[1]
        x ^= x >> np.uint64(29)
        x *= _K[2]
        x ^= x >> np.uint64(32)
    return x


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of h[i : i + width] for each i, by doubling."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def _spread(x: np.ndarray) -> np.ndarray:
    """Least hashes crowd near zero; so do not their images under this one-to-one map, whose first bits are the bucket."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _K[0]
        return x ^ (x >> np.uint64(29))


def _loads(data: bytes, room: int) -> np.ndarray:
    """The 8 bytes from every position of data, as numbers; zeros follow it for `room` positions."""
    padded = data + bytes(room + 8)
    return np.ndarray((len(data) + room,), "<u8", padded, 0, (1,))


def _words(load: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of the strings (at, sizes), eight at a time: (which strings still have some, these as numbers)."""
    live = np.arange(len(at))
    for k in range(0, int(sizes.max(initial=0)), 8):
        live = live[sizes[live] > k]
        gone = np.maximum(8 - (sizes[live] - k), 0).astype(np.uint64) * np.uint64(8)
        yield live, load[at[live] + k] << gone


def distinct(load: np.ndarray, at: np.ndarray, sizes: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings in groups `homes` the first of each distinct one, by group, and for every string its number among these.

    They are ordered by a hash and compared byte by byte with the first of their hash; should two differ, by another hash.
    """
    n = len(at)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for seed in range(1, 100):
        x = np.full(n, seed, np.uint64) + sizes.astype(np.uint64)
        for turn, (live, word) in enumerate(_words(load, at, sizes)):
            x[live] = _mixed(x[live], word, turn)
        x ^= x >> np.uint64(29)
        order = np.lexsort((x, homes)) if homes.any() else np.argsort(x, kind="stable")
        x, h = x[order], homes[order]
        head = np.ones(n, bool)
        head[1:] = (x[1:] != x[:-1]) | (h[1:] != h[:-1])
        number = np.empty(n, np.int64)
        number[order] = np.cumsum(head) - 1
        firsts = order[head]
        mine, theirs = at, at[firsts][number]
        if (sizes == sizes[firsts][number]).all() and all(
            np.array_equal(word, load[theirs[live] + 8 * k] << (np.maximum(8 - (sizes[live] - 8 * k), 0).astype(np.uint64) * np.uint64(8)))
            for k, (live, word) in enumerate(_words(load, mine, sizes))
        ):
            return firsts, number
    raise RuntimeError("no hash keeps the strings apart")


class Text:
    """Whole documents of a file one after another, and their windows of `span` bytes as runs that share a key."""

    def __init__(self, src: str, span: int, hot: np.ndarray):
        ids: list[int] = []
        texts: list[bytes] = []
        for names, found in read_unit(src, 64):
            ids += [LAST if i is None else i for i in names]
            texts += found
        self.ids, self.lengths = np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64)
        self.data = b"".join(texts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n, width = len(self.data), span - SHORT + 1
        self.load = _loads(self.data, 64 + 2 * span)
        edge = np.zeros(n + 1, np.int8)
        has = self.lengths >= span
        edge[self.starts[has]] += 1
        edge[self.starts[has] + self.lengths[has] - span + 1] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        firsts, lasts, keys = [], [], []
        for a in range(0, n, SLICE):  # a run may end with a slice: a window's class does not depend on its neighbours
            b = min(n, a + SLICE)
            ok = valid[a:b]
            h = _hashes(self.load, a, b + width)
            least = _least(h, width)[: b - a]
            first = ok.copy()
            # A run also ends where its minimizer stood at the window's start, so that none is longer than `width`.
            first[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (h[: b - a - 1] == least[:-1])
            last = ok.copy()
            last[:-1] &= ~ok[1:] | first[1:]
            f, t = np.flatnonzero(first), np.flatnonzero(last)
            key = _spread(least[f])
            if len(hot):
                hit = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                if hit.any():
                    single = _ranges(f[hit], t[hit] - f[hit] + 1)
                    whole = np.full(len(single), span, np.uint64)
                    for turn, (_, word) in enumerate(_words(self.load, single + a, np.full(len(single), span))):
                        whole = _mixed(whole, word, turn)
                    whole ^= whole >> np.uint64(32)
                    f, t, key = (np.concatenate(x) for x in ((f[~hit], single), (t[~hit], single), (key[~hit], whole)))
            firsts.append(f + a)
            lasts.append(t + a)
            keys.append(key)
        none = [np.empty(0, np.int64)]
        self.first, self.last = np.concatenate(firsts or none), np.concatenate(lasts or none)
        self.keys = np.concatenate(keys or [np.empty(0, np.uint64)])
        # Empty documents share a start with the next one; the last of them is meant, as it alone can hold the position.
        self.doc = np.searchsorted(self.starts, self.first, side="right") - 1

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, ascending, whether each occurs in two rows or more, how often, and for every run its key's number."""
        order = np.argsort(self.keys, kind="stable")
        keys, rows = self.keys[order], self.doc[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(head)
        where = np.empty(len(keys), np.int64)
        where[order] = np.cumsum(head) - 1
        several = np.minimum.reduceat(rows, heads) != np.maximum.reduceat(rows, heads) if len(heads) else np.empty(0, bool)
        return keys[heads], several, np.diff(np.r_[heads, len(keys)]), where

    def segments(self, wanted: np.ndarray, where: np.ndarray, bits: int, span: int) -> tuple[np.ndarray, ...]:
        """(runs with a wanted key, number of each one's segment, home of the distinct segments, their starts, sizes, least doc_ids)."""
        runs = np.flatnonzero(wanted[where]) if len(wanted) else np.empty(0, np.int64)
        at, sizes = self.first[runs], self.last[runs] - self.first[runs] + span
        homes = (self.keys[runs] >> np.uint64(64 - bits)).astype(np.int64)
        firsts, number = distinct(self.load, at, sizes, homes)
        low = np.full(len(firsts), LAST)
        np.minimum.at(low, number, self.ids[self.doc[runs]])
        return runs, number, homes[firsts], at[firsts], sizes[firsts], low


_SENT = {"bucket": pa.int32(), "src": pa.string(), "blob": pa.binary()}
_REPLY = {"src": pa.string(), "kind": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
_OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def hot_minimizers(units: Units, span: int, hot: int = HOT, most: int = MOST_HOT) -> np.ndarray:
    """Minimizers that about `hot` runs or more have, ascending, by a sample of the files; at most `most`, which bounds what is sent."""
    names, share = units.sample()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                keys, _, times, _ = Text(src, span, np.empty(0, np.uint64)).distinct_keys()
                often = np.flatnonzero(times >= SEEN)
                yield pa.record_batch([pa.array(keys[often].view(np.int64)), pa.array(times[often])], ["key", "times"])

    found = names.mapInArrow(look, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    found = found.where(F.col("times") >= max(SEEN, int(hot * share))).orderBy(F.desc("times"), "key").limit(most)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))  # at most `most` numbers


def remove_repeats(docs: DataFrame, span: int = SPAN, texts: bool = True, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null unless `texts`).

    A byte goes when a span-byte string over it also starts in a row with a smaller doc_id; strings do not cross rows and
    are judged on the input. Null texts are empty. Rows with one doc_id do not remove each other's bytes; a null doc_id
    counts as larger than all others. Only doc_id and text are read. A task holds the text of one file (4,000 rows and
    8 MB, or one longer text) or of one bucket, whose number grows with the text; minimizers of `hot` runs or more are
    spread over all buckets.
    """
    if span < 2 * SHORT:
        raise ValueError(f"span must be at least {2 * SHORT}")
    units = Units(docs)
    bits = units.bits(BUCKET_BYTES)
    sent_hot = docs.sparkSession.sparkContext.broadcast(hot_minimizers(units, span, hot))  # at most MOST_HOT numbers

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                keys, several, _, _ = Text(src, span, sent_hot.value).distinct_keys()
                homes = (keys >> np.uint64(64 - bits)).astype(np.int64)
                low = (keys >> np.uint64(32 - bits)).astype(np.uint32)
                # bucket 0 hears of every file, so that every file has a reply
                cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(homes, prepend=-1)), len(keys)])
                sent: dict[str, list] = {"bucket": [0], "src": [src], "blob": [np.int64(0).tobytes()]}
                for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    sent["bucket"].append(int(homes[x]))
                    sent["src"].append(src)
                    sent["blob"].append(np.int64(y - x).tobytes() + low[x:y].tobytes() + np.packbits(several[x:y]).tobytes())
                yield from arrow_table(sent, _SENT).to_batches()

    def count(key: tuple, group: pa.Table) -> pa.Table:
        lows, multis = [], []
        for blob in group.column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            lows.append(np.frombuffer(blob, np.uint32, n, 8))
            multis.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 4 * n), count=n).astype(bool))
        values, where, times = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[where[np.concatenate(multis)]] = True
        marks = np.split(shared[where], np.cumsum([len(x) for x in lows])[:-1])
        n = group.num_rows
        return arrow_table({"src": group.column("src").to_pylist(), "kind": [0] * n, "bucket": [key[0].as_py()] * n, "blob": [np.int64(len(m)).tobytes() + np.packbits(m).tobytes() for m in marks]}, _REPLY)

    def wanted_of(rows: list[tuple]) -> np.ndarray:
        parts = []
        for _, b in sorted(rows):
            n = int(np.frombuffer(b, np.int64, 1)[0])
            parts.append(np.unpackbits(np.frombuffer(b, np.uint8, -1, 8), count=n))
        return np.concatenate(parts).astype(bool)

    def replies_of(group: pa.Table) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {0: [], 1: []}
        for kind, bucket, blob in zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            out[kind].append((bucket, blob))
        return out

    def send(key: tuple, group: pa.Table) -> pa.Table:
        text = Text(key[0].as_py(), span, sent_hot.value)
        _, _, homes, at, sizes, low = text.segments(wanted_of(replies_of(group)[0]), text.distinct_keys()[3], bits, span)
        data = np.frombuffer(text.data, np.uint8)
        cuts = np.r_[np.flatnonzero(np.diff(homes, prepend=-1)), len(homes)].tolist()
        sent: dict[str, list] = {k: [] for k in _SENT}
        for x, y in zip(cuts, cuts[1:], strict=False):
            sent["bucket"].append(int(homes[x]))
            sent["src"].append(key[0].as_py())
            sent["blob"].append(pack(np.int64(y - x).tobytes() + low[x:y].tobytes() + sizes[x:y].astype(np.int32).tobytes() + data[_ranges(at[x:y], sizes[x:y])].tobytes()))
        return arrow_table(sent, _SENT)

    def match(key: tuple, group: pa.Table) -> pa.Table:
        lows, lengths, datas = [], [], []
        for blob in group.column("blob").to_pylist():
            raw = unpack(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            lows.append(np.frombuffer(raw, np.int64, n, 8))
            lengths.append(np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64))
            datas.append(raw[8 + 12 * n :])
        data, sizes = b"".join(datas), np.concatenate(lengths)
        at = np.cumsum(sizes) - sizes
        firsts, number = distinct(_loads(data, 64), at, sizes, np.zeros(len(at), np.int64))
        low = np.full(len(firsts), LAST)
        np.minimum.at(low, number, np.concatenate(lows))
        at, sizes = at[firsts], sizes[firsts]
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        buf = np.zeros(int(sizes.sum()) + len(sizes), np.uint8)  # as suffix_array.joined() makes it
        buf[_ranges(begin, sizes)] = np.frombuffer(data, np.uint8)[_ranges(at, sizes)] + np.uint8(1)
        place, kind = prefix_classes(buf, span)
        which = np.searchsorted(begin, place, side="right") - 1
        best = np.full(int(kind[-1]) + 1 if len(kind) else 0, LAST)
        np.minimum.at(best, kind, low[which])
        windows = sizes - span + 1
        base = np.cumsum(windows) - windows
        answer = np.empty(int(windows.sum()), np.int64)
        answer[base[which] + place - begin[which]] = best[kind]
        files = np.split(number, np.cumsum([len(x) for x in lows])[:-1])
        blobs = [pack(answer[_ranges(base[m], windows[m])].tobytes()) for m in files]
        n = group.num_rows
        return arrow_table({"src": group.column("src").to_pylist(), "kind": [1] * n, "bucket": [key[0].as_py()] * n, "blob": blobs}, _REPLY)

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        text = Text(key[0].as_py(), span, sent_hot.value)
        said = replies_of(group)
        runs, number, _, _, sizes, _ = text.segments(wanted_of(said[0]), text.distinct_keys()[3], bits, span)
        n = len(text.data)
        edge = np.zeros(n + 1, np.int32)
        if len(runs):
            # The distinct segments are ordered by bucket, and so are the buckets' answers.
            values = np.concatenate([np.frombuffer(unpack(b), "<i8") for _, b in sorted(said[1])])
            windows = sizes - span + 1
            begins = np.cumsum(windows) - windows
            for a in range(0, len(runs), 200_000):
                part, num = runs[a : a + 200_000], number[a : a + 200_000]
                many = windows[num]
                least = values[_ranges(begins[num], many)]
                hit = _ranges(text.first[part], many)[least < np.repeat(text.ids[text.doc[part]], many)]
                edge[hit] += 1  # a window stands in one run only
                edge[hit + span] -= 1
        gone = np.cumsum(edge[:n], dtype=np.int32) > 0
        out: dict[str, list] = {k: [] for k in _OUT}
        for d, s, size in zip(text.ids.tolist(), text.starts.tolist(), text.lengths.tolist(), strict=True):
            g = gone[s : s + size]
            kept = text.data[s : s + size]
            removed = int(np.count_nonzero(g))
            if removed:
                kept = np.frombuffer(kept, np.uint8)[~g].tobytes()
            out["doc_id"].append(None if d == LAST else d)
            out["n_bytes"].append(size)
            out["n_removed"].append(removed)
            out["n_spans"].append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if texts else None)
        return arrow_table(out, _OUT)

    sent, reply = "bucket int, src string, blob binary", "src string, kind int, bucket int, blob binary"
    known = stored(units.by_bucket(stored(units.names.mapInArrow(report, sent)), bits).applyInArrow(count, reply))
    asked = stored(units.by_file(known).applyInArrow(send, sent))
    found = stored(units.by_bucket(asked, bits).applyInArrow(match, reply))
    return units.by_file(known.union(found)).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
