"""N-gram Jaccard join by T-occurrence search: short inverted lists are merged, long ones probed (DivideSkip).

Candidates. A set's shingles have one global order: by the length class of their inverted lists, counted over all
documents, then by hash. A set of n shingles that is to share T = ceil(t * n) of them with another shares one of its first
n - T + 1; these are its short lists, the other T - 1 its long ones. A list of one document is never sent, so a document
with n - T + 1 shingles of its own costs nothing further. The short lists are merged by a shuffle on the shingle. Every list
names its smallest document as centre, so a list of m documents yields m - 1 (centre, document) candidates and not m * m.

Search. The candidates are dealt to partitions of documents with inverted lists of their whole sets; each query merges its
short lists there on a heap, probes its long ones and retains what reaches the required overlap. Documents linked with
their centre are in its class; only the rest of a centre's documents are compared further, in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, small_batches, stored
from .components import components
from .units import Units, arrow_table, pack, read_unit, unpack

WORDS, NUM, DEN = 3, 9, 10
#: Text bytes per bucket of shingles; the number of buckets grows with the text.
BUCKET_BYTES = 8_000_000
#: Documents of a centre in one comparison block, on either side.
BLOCK = 128
#: Candidates of a query in one partition of documents, and bytes of their sets.
PART, PART_BYTES = 256, 16_000_000
#: DivideSkip's weight of a probe against a merge step: T / (MU * log2(longest list) + 1) lists are long. It changes no result.
MU = 0.01
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _Words(dict):
    """Word -> 64-bit hash, remembered for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: _Words, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; with fewer words, of the whole sequence."""
    w = text.lower().split()  # on bytes both know ASCII only: A-Z, and white space 09-0D and 20
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(k, len(w))
    n = len(w) - k + 1
    x = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = (x ^ h[i : i + n]) * _K[0]
            x ^= x >> np.uint64(29)
        x *= _K[4]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def short_lists(shingles: np.ndarray, classes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of the first n - T + 1 shingles in the global order those whose lists hold other documents too."""
    p = prefix_length(len(shingles), num, den)
    order = np.argsort(classes, kind="stable")[:p]  # the shingles ascend, so ties stay in the order of their hashes
    return shingles[order[classes[order] > 0]]


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bit map of the parity of the hashes per cell. Two sets differ in at least as many elements as their maps in bits."""
    bits = 512
    while bits < len(shingles):
        bits *= 2
    cells = np.bincount((shingles >> np.uint64(3)) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


class BitMaps:
    """Sets known by size and parity bits, grouped by width; says which of them one set may link with."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes, self.by_width = sizes, {}
        widths = np.array([len(m) // 8 for m in maps])
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            self.by_width[int(w)] = at, np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), w)

    def possible(self, size: int, bits: bytes, num: int, den: int) -> np.ndarray:
        """True where neither the sizes nor the bits rule a link out."""
        ok = np.zeros(len(self.sizes), bool)
        own = np.frombuffer(bits, np.uint64)
        for w, (at, rows) in self.by_width.items():
            width = min(w, len(own))
            apart = np.bitwise_count(_fold(rows, width) ^ _fold(own, width)).sum(axis=1, dtype=np.int64)
            n = self.sizes[at]
            ok[at] = ((den + num) * apart <= (den - num) * (n + size)) & (den * np.minimum(n, size) >= num * np.maximum(n, size))
        return ok


def needed(n: int, m: int, num: int, den: int) -> int:
    """The overlap that sets of n and m elements need."""
    return (num * (n + m) + den + num - 1) // (den + num)


class Inverted:
    """The inverted lists of a partition of documents: every shingle's documents, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        self.shingles, self.ends = flat[heads], np.r_[heads, len(flat)]
        self.owners = owners[order].tolist()
        self.sizes = [len(s) for s in sets]

    def search(self, query: np.ndarray, num: int, den: int, among: set[int] | None = None) -> list[tuple[int, int]]:
        """T-occurrence search: (document, overlap) of those that reach the overlap that they need with the query.

        T is the least overlap that any partner needs. Of the query's lists the longest are long, at most T - 1 of them,
        and as many as DivideSkip's rule says. The short ones are merged on a heap; a document that they have T - long
        times or more is looked up in the long ones by binary search, until its overlap is out of reach. With `among`,
        only these documents are asked about.
        """
        n = len(query)
        if not n or not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        least = max(1, -(-num * n // den))
        if len(at) < least:
            return []
        lists = sorted(zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True), key=lambda x: x[1] - x[0])
        most = lists[-1][1] - lists[-1][0]
        long = min(least - 1, int(least / (MU * math.log2(most + 1) + 1)))
        cut = len(lists) - long
        owners, counts = self.owners, {}
        for i in heapq.merge(*[owners[x:y] for x, y in lists[:cut]]):
            counts[i] = counts.get(i, 0) + 1
        hits = []
        for i, got in counts.items():
            if got < least - long or (among is not None and i not in among):
                continue
            t, left = needed(n, self.sizes[i], num, den), long
            for x, y in lists[cut:]:
                if got + left < t:
                    break
                place = bisect_left(owners, i, x, y)
                got += place < y and owners[place] == i
                left -= 1
            if got >= t:
                hits.append((i, got))
        return hits


def _texts(batch: pa.RecordBatch, col: int) -> list[bytes]:
    return [t or b"" for t in batch.column(col).cast(pa.binary()).to_pylist()]


def _file_shingles(src: str, k: int) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
    """doc_ids and sets of a file, its distinct shingles ascending, and for all sets' shingles their place among these."""
    words, ids, sets = _Words(), [], []
    for names, texts in read_unit(src):
        ids += names
        sets += [shingle_set(t, words, k) for t in texts]
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    keys, where = np.unique(flat, return_inverse=True)
    return ids, sets, keys, where


def _thin(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte plane by byte plane."""
    return pack(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 4).T.tobytes())


def _thick(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, sid (hash of the whole set), n (its size), keys (its short lists), bits (parity map, if it has keys).

    Every file reports its distinct shingles, without repeats, to their buckets; a bucket counts the files' documents and
    replies with the length class of every list (0: one document; a file with two or more says so).
    """
    units = Units(docs)
    bits = units.bits(BUCKET_BYTES)
    sent_kinds = {"bucket": pa.int32(), "src": pa.string(), "blob": pa.binary(), "times": pa.binary()}
    reply_kinds = {"bucket": pa.int32(), "src": pa.string(), "blob": pa.binary()}

    def cut(keys: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                _, sets, keys, where = _file_shingles(src, k)
                _, one = np.unique(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64), return_index=True)
                first = np.zeros(len(sets), bool)
                first[one] = True  # of equal sets in the file one counts
                each = np.repeat(first, [len(s) for s in sets])
                times = np.minimum(np.bincount(where[each], minlength=len(keys)), 255).astype(np.uint8)
                low, cuts = (keys >> np.uint64(32 - bits)).astype(np.uint32), cut(keys)
                out: dict[str, list] = {c: [] for c in sent_kinds}
                for b in range(1 << bits):
                    x, y = cuts[b], cuts[b + 1]
                    if y > x or b == 0:  # bucket 0 hears of every file, so that every file has a reply
                        for c, v in zip(out, (b, src, _thin(low[x:y]), pack(times[x:y].tobytes())), strict=True):
                            out[c].append(v)
                yield from arrow_table(out, sent_kinds).to_batches()

    def count(key: tuple, group: pa.Table) -> pa.Table:
        lows = [_thick(x) for x in group.column("blob").to_pylist()]
        flat = np.concatenate(lows)
        _, where = np.unique(flat, return_inverse=True)
        times = np.concatenate([np.frombuffer(unpack(x), np.uint8) for x in group.column("times").to_pylist()])
        total = np.bincount(where, times)[where] if len(flat) else np.empty(0)
        classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
        parts = np.split(classes, np.cumsum([len(x) for x in lows])[:-1])
        return arrow_table({"bucket": [key[0].as_py()] * len(lows), "src": group.column("src").to_pylist(), "blob": [pack(x.tobytes()) for x in parts]}, reply_kinds)

    def tell(key: tuple, group: pa.Table) -> pa.Table:
        ids, sets, _, where = _file_shingles(key[0].as_py(), k)
        said = sorted(zip(group.column("bucket").to_pylist(), group.column("blob").to_pylist(), strict=True))
        classes = np.concatenate([np.frombuffer(unpack(x), np.uint8) for _, x in said])[where]
        ends = np.cumsum([0, *map(len, sets)])
        keys = [short_lists(s, classes[a:b], num, den) for s, a, b in zip(sets, ends, ends[1:], strict=False)]
        sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(flat))
        maps = [parity_bits(s) if len(x) else None for s, x in zip(sets, keys, strict=True)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), pa.array(maps, pa.binary()), lists], ["doc_id", "sid", "n", "bits", "keys"])

    sent = stored(units.names.mapInArrow(report, "bucket int, src string, blob binary, times binary"))
    replies = stored(units.by_bucket(sent, bits).applyInArrow(count, "bucket int, src string, blob binary"))
    return units.by_file(replies).applyInArrow(tell, "doc_id long, sid long, n long, bits binary, keys array<long>")


def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) those that link, found by T-occurrence search over inverted lists of the whole sets.

    The a's are queries. Their b's are dealt to partitions of bounded size, each with inverted lists of its own; a query
    with more than PART candidates is put to several partitions. A set travels once for every partition that it is in.
    """
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t, words, k).tobytes() for t in _texts(batch, 1)], pa.binary())], ["id", "s"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(checked_broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")
    whole = stored(rows.mapInArrow(sets, "id long, s binary").groupBy("id").agg(F.min("s").alias("s")))

    sizes = whole.select(F.col("id").alias("b"), F.length("s").alias("size"))
    each = pairs.join(sizes, "b").groupBy("a").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    parts = each.select("a", F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("bytes") / PART_BYTES)).cast("int").alias("parts"))
    cells = max(1, pairs.count() // PART)
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("a"), F.lit(cells)).alias("cell"), F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int").alias("part"))
    # A query with several partitions has these to itself; the others share a cell's only one.
    dealt = stored(dealt.join(parts.where("parts > 1").select("a", F.lit(True).alias("alone")), "a", "left").select("a", "b", "cell", "part", F.when(F.col("alone"), F.col("a")).alias("own")))
    asks = dealt.groupBy("cell", "part", "own", F.col("a").alias("id")).agg(F.collect_list("b").alias("among"))  # about PART of them
    tells = dealt.select("cell", "part", "own", F.col("b").alias("id")).distinct().withColumn("among", F.lit(None).cast("array<long>"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        names, among = group.column("id").to_pylist(), group.column("among").to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in group.column("s").to_pylist()]
        told = [i for i, x in enumerate(among) if x is None]
        index, place = Inverted([found[i] for i in told]), {names[i]: j for j, i in enumerate(told)}
        out: list[tuple[int, int]] = []
        for i, x in enumerate(among):
            if x is not None:
                out += [(names[i], names[told[j]]) for j, _ in index.search(found[i], num, den, {place[b] for b in x})]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = asks.unionByName(tells).join(whole, "id")
    return stored(both.groupBy("cell", "part", "own").applyInArrow(search, "a long, b long"))


def _star_candidates(members: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a centre, b) whose sizes and bits allow a link."""
    d = reps.select("rep", "n", "bits")
    rows = members.join(d, "rep").join(d.select(F.col("rep").alias("c"), F.col("n").alias("cn"), F.col("bits").alias("cbits")), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rep, n, m = (batch.column(i).to_numpy() for i in range(4))
            keep = np.flatnonzero(den * np.minimum(n, m) >= num * np.maximum(n, m))
            mine, theirs = batch.column(4), batch.column(5)
            good = []
            for i in keep.tolist():
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (mine, theirs))
                w = min(len(x), len(y))
                if (den + num) * int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum()) <= (den - num) * int(n[i] + m[i]):
                    good.append(i)
            yield pa.record_batch([pa.array(c[good]), pa.array(rep[good])], ["a", "b"])

    return rows.select("c", "rep", "n", "cn", "bits", "cbits").mapInArrow(run, "a long, b long")


def _block_candidates(blocks: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b) within each block, a one of its unlinked documents, where sizes and bits allow a link between labels that
    differ. With `forest` only as many as connect the block's documents: these, once verified, make most others needless."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rep, n, label = (group.column(x).to_numpy() for x in ("rep", "n", "label"))
        asks, bits = group.column("asks").to_numpy(zero_copy_only=False), group.column("bits").to_pylist()
        ask, told = np.flatnonzero(asks), np.flatnonzero(~asks)
        maps = BitMaps(n[told], [bits[i] for i in told])
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        out: list[tuple[int, int]] = []
        for i in ask.tolist():
            ok = told[maps.possible(int(n[i]), bits[i], num, den) & (label[told] != label[i])]
            for j in ok.tolist():
                if forest:
                    x, y = root(int(label[i])), root(int(label[j]))
                    if x == y:
                        continue
                    top[x] = y
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("c", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _blocks(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Comparison blocks (c, i, j): of each centre with documents outside its class, those (dealt to i) beside all (dealt to j).

    A centre's m documents are dealt to ceil(m / BLOCK) parts by hash, the q outside its class to ceil(q / BLOCK), so no
    block outgrows its task and a document meets only as many blocks as there are documents left to ask.
    """
    named = members.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("l")), "rep", "left").withColumn("label", F.coalesce("l", "rep")).drop("l")
    centre = labels.select(F.col("node").alias("c"), F.col("component").alias("cl"))
    named = named.join(centre, "c", "left").withColumn("asks", F.col("label") != F.coalesce("cl", "c")).drop("cl")
    per = named.groupBy("c").agg(F.count("*").alias("m"), F.count_if("asks").alias("q")).where("q > 0 AND m > 1")
    per = per.select("c", *[F.ceil(F.col(x) / BLOCK).cast("int").alias(y) for x, y in (("m", "parts"), ("q", "ask_parts"))])
    rows = named.join(per, "c").join(reps.select("rep", "n", "bits"), "rep")
    deal = lambda into: F.pmod(F.xxhash64("rep", "c"), F.col(into)).cast("int")
    every = lambda into: F.explode(F.sequence(F.lit(0), F.col(into) - 1))
    ask = rows.where("asks").select("c", deal("ask_parts").alias("i"), every("parts").alias("j"), "rep", "n", "bits", "label", F.lit(True).alias("asks"))
    told = rows.select("c", every("ask_parts").alias("i"), deal("parts").alias("j"), "rep", "n", "bits", "label", F.lit(False).alias("asks"))
    return ask.union(told)


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their k-word shingle sets; component_id is the
    smallest doc_id reachable by links. Null texts and texts without words have an empty set and no links. Rows with
    equal sets are linked without being expanded into pairs; repeated rows are such. A row whose doc_id is null is no
    representative and links nothing, but takes the component of an equal set. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(describe(docs, k, num, den))
    sets = stored(base.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid", "n").agg(F.min("doc_id").alias("rep")))
    # doc_id is unique among the representatives but for an id that stands before two texts: the larger set then speaks for it.
    reps = base.where("size(keys) > 0").join(sets, ["sid", "n"]).where("doc_id = rep").groupBy("rep").agg(F.max_by(F.struct("n", "bits", "keys"), "n").alias("x"))
    reps = stored(reps.select("rep", "x.*"))

    lists = reps.select("rep", F.explode("keys").alias("key"))
    centres = lists.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).where("c < last").select("key", "c")
    members = stored(lists.join(centres, "key").where("rep <> c").select("c", "rep").distinct())

    links = verify(stored(_star_candidates(members, reps, num, den)), docs, k, num, den)
    labels = stored(components(links.toDF("u", "v")))
    more = stored(_block_candidates(_blocks(members, labels, reps), num, den, forest=True))
    if more.limit(1).count():
        links = stored(links.union(verify(more, docs, k, num, den)))
        labels = stored(components(links.toDF("u", "v")))
        rest = stored(_block_candidates(_blocks(members, labels, reps), num, den, forest=False).join(more, ["a", "b"], "left_anti"))
        if rest.limit(1).count():
            links = stored(links.union(verify(rest, docs, k, num, den)))
            labels = stored(components(links.toDF("u", "v")))
    named = sets.join(labels, F.col("rep") == F.col("node"), "left").select("sid", "n", F.coalesce("component", "rep").alias("component"))
    rows = base.select("doc_id", "sid", "n").join(named, ["sid", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
