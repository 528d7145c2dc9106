"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .lattice import _BASE, LONG, Lattice, Vocabulary, by_length, rank_weights

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 23
#: Distinct units whose lattices a task keeps; beyond that it starts anew. It changes no result.
KEPT_UNITS = 250_000
MARK = "▁"
#: No piece has a space after another character, or a line feed but alone: lattices of larger stretches factor into these.
_UNITS = re.compile(rb" *[^ \n]+|\n| +")
_CUT = re.compile(rb"(?<=[^ \n])[ \n]")
#: Text bytes that are taken at once.
PART = 4_000_000
_INSIDE = re.compile(rb" *[^ \n]*|\n")  # what no cut between units can fall into
_U = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class PieceModel:
    """The pieces of a SentencePiece file as bytes: MARK is a space, byte pieces are their byte, control pieces are left out.

    Such a file scores its pieces by rank; sampling weighs them by Zipf's law of that rank, byte pieces last. A space or a
    MARK in a text cannot be taken for each other: the first is the byte 20, the second only ever encodes as its bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: list[int] = []
        pieces: list[bytes] = []
        ranks: list[float] = []
        size = model.get_piece_size()
        seen: set[bytes] = set()
        for byte in (False, True):
            for i in range(size):
                if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) != byte:
                    continue
                name = model.id_to_piece(i)
                raw = bytes([int(name[3:5], 16)]) if byte else name.replace(MARK, " ").encode()
                if raw in seen:  # a byte that also is a piece of its own needs no second way
                    continue
                seen.add(raw)
                self.ids.append(i)
                pieces.append(raw)
                ranks.append(-model.get_score(i) if not byte else size)
        if crossing := [p for p in pieces if not _INSIDE.fullmatch(p)]:
            raise ValueError(f"pieces that cross units: {crossing[:5]}")
        self.bytes_of = dict(zip(self.ids, pieces, strict=True))
        self.vocabulary = Vocabulary(pieces, rank_weights(np.maximum(np.array(ranks, np.float64), 0.0)))
        self.numbers = np.array(self.ids, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def long_lattice(vocabulary: Vocabulary, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of one long string, ordered by end: (ends, lengths, pieces, share of an edge among those of its end)."""
    chars = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    sums, power, found = np.zeros(len(text) + 1, np.uint64), np.uint64(1), []
    with np.errstate(over="ignore"):
        for n in range(1, min(vocabulary.longest, len(text)) + 1):
            power *= _BASE
            sums = sums[:-1] * _BASE + chars[n - 1 :]
            ids = vocabulary.find(sums + np.uint64(n) * power)
            at = np.flatnonzero(ids >= 0)
            found.append((at + n, np.full(len(at), n, np.int32), ids[at].astype(np.int32)))
    ends, back, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ends, kind="stable")
    ends, back, piece = ends[order], back[order], piece[order]
    weight, share = vocabulary.logp[piece], np.empty(len(ends))
    alpha = np.full(len(text) + 1, -np.inf)
    alpha[0] = 0.0
    heads = np.searchsorted(ends, np.arange(len(text) + 2))
    for j in range(1, len(text) + 1):
        k = slice(heads[j], heads[j + 1])
        x = alpha[j - back[k]] + weight[k]
        top = x.max(initial=-np.inf)
        if top > -np.inf:
            x = np.exp(x - top)
            alpha[j] = top + np.log(x.sum())
            share[k] = x / x.sum()
        else:
            share[k] = 0.0
    if not np.isfinite(alpha[-1]):
        raise ValueError("the vocabulary cannot spell a text")
    return ends, back, piece, share


def uniforms(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) fixed by (row key, place in the row)."""
    with np.errstate(over="ignore"):
        x = keys + (places.astype(np.uint64) + np.uint64(1)) * _U[0]
        x = (x ^ (x >> np.uint64(30))) * _U[1]
        x = (x ^ (x >> np.uint64(27))) * _U[2]
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * (1.0 / (1 << 53))


class _Numbers(dict):
    """Unit -> number, in the order of their first look-up."""

    def __missing__(self, unit: bytes) -> int:
        n = self[unit] = len(self)
        return n


class Sampler:
    """Draws segmentations of texts from the lattice's distribution given the text.

    A state is a unit and an end in it. Its incoming edges stand together, the longest first, with the cumulative share of
    each; a draw is compared with these shares alone, and the last edge takes what is left. So a draw depends on nothing
    but the unit, the row's key and the place, whichever units are kept beside it.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers()
        self.base, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.heads = np.zeros(1, np.int64)  # of each state its first edge, and the number of edges
        self.upto, self.back, self.piece = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)

    def _learn(self, units: list[bytes]) -> None:
        """Adds the incoming edges of every (unit, end) state with their cumulative shares."""
        base, size = np.empty(len(units), np.int64), np.array([len(u) for u in units], np.int64)
        states = 0
        parts = []
        for at, group in by_length(units):
            if len(group[0]) > LONG:
                for i, unit in zip(at, group, strict=True):
                    ends, back, piece, share = long_lattice(self.model.vocabulary, unit)
                    ok = share > 0
                    parts.append((states + ends[ok], share[ok], back[ok], piece[ok]))
                    base[i] = states
                    states += len(unit) + 1
                continue
            lattice = Lattice(self.model.vocabulary, group)
            alpha = lattice.forward()  # forward filtering
            if not np.isfinite(alpha[-1]).all():
                raise ValueError("the vocabulary cannot spell a text")
            n = lattice.length
            base[at] = states + np.arange(len(group)) * (n + 1)
            for i, j, rows, ids in lattice.steps:
                with np.errstate(invalid="ignore"):
                    share = np.exp(alpha[i, rows] + self.model.vocabulary.logp[ids] - alpha[j, rows])
                ok = np.flatnonzero(share > 0)
                parts.append((base[at[rows[ok]]] + j, share[ok], np.full(len(ok), j - i, np.int32), ids[ok].astype(np.int32)))
            states += len(group) * (n + 1)
        state, share, back, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(state * 256 - np.minimum(back, 255), kind="stable")  # of one state and length there is one piece
        state, share, back, piece = state[order], share[order], back[order], piece[order]
        heads = np.searchsorted(state, np.arange(states + 1))
        upto = share.copy()
        at, many = heads[:-1][np.diff(heads) > 1], np.diff(heads)[np.diff(heads) > 1]
        for k in range(1, int(many.max(initial=0))):  # sums within each state only, in their order
            at, many = at[many > k], many[many > k]
            upto[at + k] += upto[at + k - 1]
        upto[heads[1:][np.diff(heads) > 0] - 1] = np.inf
        self.base, self.size = np.concatenate([self.base, base + len(self.heads) - 1]), np.concatenate([self.size, size])
        self.heads = np.concatenate([self.heads[:-1], heads + self.heads[-1]])
        self.upto, self.back, self.piece = (np.concatenate(x) for x in ((self.upto, upto), (self.back, back), (self.piece, piece)))

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each state whose share of [0, 1) holds u."""
        edge = self.heads[state]
        over = np.flatnonzero(u >= self.upto[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= self.upto[edge[over]]]
        return edge

    def sample(self, keys: list[int], texts: list[bytes], before: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text); keys are one number per text, `before` its place in its row."""
        split = [_UNITS.findall(t) for t in texts]
        per = np.array([len(s) for s in split], np.int64)
        n = int(per.sum())
        if len(self.known) > KEPT_UNITS:
            self._reset()
        had = len(self.known)
        unit = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, n)
        del split
        if len(self.known) > had:
            try:
                self._learn(list(islice(self.known, had, None)))
            except Exception:  # a worker's next task finds no unit without its edges
                self._reset()
                raise
        key = np.repeat(np.array(keys, np.uint64), per)
        sizes = self.size[unit]
        at = np.cumsum(sizes) - sizes
        at -= np.repeat(at[np.minimum(np.cumsum(per) - per, max(n - 1, 0))], per) if n else 0  # a unit's first byte in its text
        if before is not None:
            at += np.repeat(np.array(before, np.int64), per)
        end, base = sizes.copy(), self.base[unit]
        live = np.arange(n)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(n, np.int64)
        while len(live):  # backward sampling: one edge of every unit that is not at its start
            edge = self.draw(base[live] + end[live], uniforms(key[live], at[live] + end[live]))
            drawn.append((live, self.piece[edge]))
            count[live] += 1
            end[live] -= self.back[edge]
            live = live[end[live] > 0]
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int32)
        for step, (who, piece) in enumerate(drawn):
            out[last[who] - step] = piece
        lengths = np.bincount(np.repeat(np.arange(len(texts)), per), count, len(texts)).astype(np.int64) if n else np.zeros(len(texts), np.int64)
        return self.model.numbers[out], lengths

    def rows(self, keys: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As sample(), of texts of any length: long ones are taken in parts that no unit crosses."""
        parts = [(i, keys[i], a, t[a:b]) for i, t in enumerate(texts) for a, b in _parts(t)]
        ids, counts, have = [], np.zeros(len(texts), np.int64), 0
        group: list[tuple[int, int, int, bytes]] = []
        for k, part in enumerate(parts):
            group.append(part)
            have += len(part[3])
            if have >= PART or k == len(parts) - 1:
                got, per = self.sample([g[1] for g in group], [g[3] for g in group], [g[2] for g in group])
                ids.append(got)
                np.add.at(counts, [g[0] for g in group], per)
                group, have = [], 0
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), counts


def _parts(text: bytes) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of about PART bytes; each but the last ends before a space or line feed that follows neither."""
    a = 0
    while len(text) - a > PART and (cut := _CUT.search(text, a + PART)):
        yield a, cut.start()
        a = cut.start()
    yield a, len(text)


@lru_cache(maxsize=2)
def sampler(model_path: str) -> Sampler:
    """A worker's sampler, which its tasks share."""
    return Sampler(PieceModel(model_path))


class Decoder:
    """Ids to bytes, many at once."""

    def __init__(self, model: PieceModel):
        self.flat = np.frombuffer(b"".join(model.vocabulary.pieces), np.uint8)
        width = np.array([len(p) for p in model.vocabulary.pieces], np.int64)
        self.start, self.size = np.zeros(int(model.numbers.max()) + 1, np.int64), np.zeros(int(model.numbers.max()) + 1, np.int64)
        self.start[model.numbers], self.size[model.numbers] = np.cumsum(width) - width, width

    def bytes_of(self, ids: np.ndarray, at_once: int = 1_000_000) -> bytes:
        out = []
        for a in range(0, len(ids), at_once):
            start, size = self.start[ids[a : a + at_once]], self.size[ids[a : a + at_once]]
            place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
            out.append(self.flat[place].tobytes())
        return b"".join(out)


def row_key(doc_id: int | None, seed: int = SEED) -> int:
    return int.from_bytes(hashlib.blake2b(f"{'' if doc_id is None else doc_id}:{seed}".encode(), digest_size=8).digest(), "little")


def encode(docs: DataFrame, model_path: str = MODEL, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, ids (sampled pieces), n_bytes, text_sha256.

    The segmentation is drawn from the lattice's distribution with numbers fixed by (doc_id, seed) and the place in the
    text, so reruns, other batches and repeated rows agree. Null texts are empty and have no pieces; a null doc_id is a
    key of its own. Whole texts are encoded; a text of any length is held once. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark, 2_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            ids, per = own.rows([row_key(i, seed) for i in names], texts)
            ends = np.r_[0, np.cumsum(per)].astype(np.int32)
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.record_batch([batch.column(0), lists, pa.array([len(t) for t in texts], pa.int64()), pa.array(digests)], ["doc_id", "ids", "n_bytes", "text_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_bytes long, text_sha256 string")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Adds the decoded text to rows with doc_id and ids: doc_id, text. Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            texts = [model.decode(ids or []).decode() for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str = MODEL, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_bytes, n_pieces, pieces_sha256 (of the ids as little-endian int32),
    text_sha256 (of the decoded text), lossless, and ids if asked for. Defined for all rows as encode() is."""
    small_batches(docs.sparkSession, 2_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_path)
        decoder = Decoder(own.model)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            ids, per = own.rows([row_key(i, seed) for i in names], texts)
            ends = np.r_[0, np.cumsum(per)]
            decoded = decoder.bytes_of(ids)  # of the whole batch: its texts one after another
            out: list[tuple] = []
            at = 0
            for i, t, x, y in zip(names, texts, ends.tolist(), ends[1:].tolist(), strict=False):
                size = int(decoder.size[ids[x:y]].sum())
                got = decoded[at : at + size]
                at += size
                out.append((i, len(t), y - x, hashlib.sha256(ids[x:y].astype("<i4").tobytes()).hexdigest(), hashlib.sha256(got).hexdigest(), got == t))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            names = ["doc_id", "n_bytes", "n_pieces", "pieces_sha256", "text_sha256", "lossless"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(ids)))
                names.append("ids")
            yield pa.record_batch(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_bytes long, n_pieces long, pieces_sha256 string, text_sha256 string, lossless boolean"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)
