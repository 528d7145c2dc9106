"""Language-model scores: subword lattice likelihood beside a smoothed word unigram.

A text is its words, each with a space before it, and one end. A word's lattice holds all its segmentations into
vocabulary pieces and, where training had the word, an arc over all of it. A path weighs the product of its pieces, and
the log-space forward recursion sums all paths. The weights of the pieces start from the vocabulary's own ranks and are
re-estimated by expectation-maximisation on the training words, each of which counts DISCOUNT there; this is taken from
its count in the arc over the whole word. So the probabilities of all words and of the end sum to one.

The corpus is reduced file by file to its distinct words; these meet in buckets by hash, where they are counted and
scored once each, and the answers go back to the files. So a word of any frequency leaves a file once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .lattice import Lattice, Vocabulary, by_length, load_ranked, marginals, rank_weights
from .units import Units, arrow_table, pack, read_unit, unpack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FOLDS, ROUNDS = 10, 2
#: Weight of the vocabulary's own scores against the corpus counts, in pieces.
PRIOR = 1_000.0
#: What every distinct training word leaves to its segmentations, in occurrences.
DISCOUNT = 0.6
BUCKET_BYTES = 4_000_000
_SENT = {"bucket": pa.int32(), "src": pa.string(), "kind": pa.int32(), "blob": pa.binary()}
_OUT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def words_of(text: bytes) -> list[bytes]:
    """On bytes, lower() changes A-Z only and split() cuts at 09-0D and 20 only."""
    return text.lower().split()


def _dealt(words: list[bytes], bits: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(xxhash.xxh3_64_intdigest(w) >> (64 - bits), []).append(i)
    return out


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = FOLDS, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod `folds` is not 0. Null texts are empty: an end only. A null doc_id
    counts as the empty text there, so its row is held out. Without training rows N and V are 0, the weights are the
    vocabulary's and an end has probability 0.01. Repeated rows count each. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    units = Units(docs)
    bits = units.bits(BUCKET_BYTES)
    pieces, ranks = load_ranked(vocabulary)
    start = rank_weights(ranks)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                seen: dict[bytes, int] = {}
                trained: Counter[bytes] = Counter()
                n = 0
                for ids, texts in read_unit(src):
                    for i, t in zip(ids, texts, strict=True):
                        words = words_of(t)
                        for w in words:
                            if w not in seen:
                                seen[w] = len(seen)
                        if not held_out(i, folds):
                            trained.update(words)
                            n += 1
                words = list(seen)
                sent: dict[str, list] = {"bucket": [0], "src": [src], "kind": [2], "blob": [np.int64(n).tobytes()]}
                for b, at in _dealt(words, bits).items():
                    mine = [words[i] for i in at]
                    counts = np.array([trained[w] for w in mine], np.int64)
                    sent["bucket"].append(b)
                    sent["src"].append(src)
                    sent["kind"].append(0)
                    sent["blob"].append(pack(np.int64(len(mine)).tobytes() + counts.tobytes() + b"\n".join(mine)))
                yield from arrow_table(sent, _SENT).to_batches()

    def parts(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Counts and words: as many numbers as the text after them has words."""
        raw = unpack(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return np.frombuffer(raw, np.int64, n, 8), raw[8 + 8 * n :].split(b"\n")

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for blob in group.column("blob").to_pylist():
            counts, words = parts(blob)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        counts = np.array(list(total.values()), np.int64)
        blob = pack(np.int64(len(counts)).tobytes() + counts.tobytes() + b"\n".join(total))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary()), "n": pa.array([int(counts.sum())]), "v": pa.array([int((counts > 0).sum())])})

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(pieces, sent_weights.value)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                counts, words = parts(blob)
                at = np.flatnonzero(counts)
                known = [b" " + words[i] for i in at]
                use = np.zeros(len(pieces))
                for rows, group in by_length(known):
                    Lattice(model, group).expected(np.minimum(counts[at[rows]], DISCOUNT), use)
                used = np.flatnonzero(use)
                yield pa.record_batch([pa.array(used), pa.array(use[used])], ["piece", "uses"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(pieces, sent_weights.value)
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts, words = parts(blob)
                n_all, v_all, ends, _ = totals
                logs = marginals(model, [b" " + w for w in words])
                if n_all:  # the arc over the whole word joins the sum over its segmentations
                    types = np.float64(max(v_all - (ends > 0), 1))
                    with np.errstate(divide="ignore"):
                        logs = np.logaddexp(logs + np.log(DISCOUNT * types), np.log(np.maximum(counts - DISCOUNT, 0.0))) - np.log(n_all)
                logs = logs / np.log(10.0)
                raw = np.int64(len(counts)).tobytes() + counts.tobytes() + b"\n".join(words)
                both = np.int64(len(raw)).tobytes() + raw + logs.tobytes()
                yield from arrow_table({"bucket": [bucket], "src": [""], "kind": [1], "blob": [pack(both)]}, _SENT).to_batches()

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        kinds, blobs, srcs = (group.column(c).to_pylist() for c in ("kind", "blob", "src"))
        raw = unpack(blobs[kinds.index(1)])
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        n = int(np.frombuffer(raw, np.int64, 1, 8)[0])
        counts = np.frombuffer(raw, np.int64, n, 16)
        number = {w: i for i, w in enumerate(raw[16 + 8 * n : 8 + size].split(b"\n"))}
        logs = np.frombuffer(raw, np.float64, n, 8 + size)
        out: dict[str, list] = {k: [] for k in _SENT}
        for kind, src, blob in zip(kinds, srcs, blobs, strict=True):
            if kind == 0:
                _, words = parts(blob)
                at = np.array([number[w] for w in words])
                out["bucket"].append(key[0].as_py())
                out["src"].append(src)
                out["kind"].append(0)
                out["blob"].append(pack(counts[at].tobytes() + logs[at].tobytes()))
        return arrow_table(out, _SENT)

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        n_all, v_all, ends, log_end = totals
        src = key[0].as_py()
        seen: dict[bytes, int] = {}
        flat, rows = [], []
        for ids, texts in read_unit(src):
            for i, t in zip(ids, texts, strict=True):
                words = words_of(t)
                for w in words:
                    if w not in seen:
                        seen[w] = len(seen)
                flat.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                rows.append(i)
        said = {b: x for k, b, x in zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True) if k == 0}
        counts, logs = np.zeros(len(seen), np.int64), np.zeros(len(seen))
        for b, at in _dealt(list(seen), bits).items():
            raw = unpack(said[b])
            counts[at], logs[at] = np.frombuffer(raw, np.int64, len(at)), np.frombuffer(raw, np.float64, len(at), 8 * len(at))
        room = n_all + 0.1 * (v_all + 1)
        base, known = np.log10((counts + 0.1) / room), counts > 0
        out: dict[str, list] = {k: [] for k in _OUT}
        for i, at in zip(rows, flat, strict=True):
            out["doc_id"].append(i)
            out["held_out"].append(held_out(i, folds))
            out["n_tokens"].append(len(at) + 1)
            out["n_known"].append(int(known[at].sum()) + (ends > 0))
            out["base_score"].append(float(base[at].sum() + np.log10((ends + 0.1) / room)))
            out["score"].append(float(logs[at].sum() + log_end))
        return arrow_table(out, _OUT)

    columns = "bucket int, src string, kind int, blob binary"
    sent = stored(units.names.mapInArrow(report, columns))
    ends = sum(int(np.frombuffer(r["blob"], np.int64)[0]) for r in sent.where("kind = 2").select("blob").collect())  # a number per file
    words = sent.where("kind = 0")
    table = stored(units.by_bucket(words, bits).applyInArrow(merge, "bucket int, blob binary, n long, v long"))
    n, v = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    spread = table.select("bucket", "blob").repartition(max(12, min(1 << bits, units.bytes // 8_000_000)))
    prior_mass, weights = np.exp(start), start
    for _ in range(rounds if n else 0):
        sent_weights = spark.sparkContext.broadcast(weights)
        uses = np.zeros(len(pieces))
        for r in spread.mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # one row per piece
            uses[r["piece"]] = r["uses"]
        mass = uses + prior * prior_mass
        weights = np.log(mass / mass.sum())
    sent_weights = spark.sparkContext.broadcast(weights)
    totals = (n + ends, v + (ends > 0), ends, float(np.log10(ends / (n + ends))) if ends else -2.0)
    scored = stored(spread.mapInArrow(score, columns))
    replies = units.by_bucket(words.union(scored), bits).applyInArrow(answer, columns)
    every = stored(replies).union(sent.where("kind = 2"))
    result = units.by_file(every).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score")
