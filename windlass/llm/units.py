"""Files of the shared folder as units of work: a task names a file, so it can be repeated and meets the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored, text_of


class Units:
    """docs (doc_id, text; null texts empty) written to files of at most `rows` rows and, but for one longer text, `size` bytes.

    The tasks that write them report the files' names in a stored table; a file that a failed task left is never named.
    """

    def __init__(self, docs: DataFrame, rows: int = 4_000, size: int = 8_000_000):
        spark = docs.sparkSession
        small_batches(spark)
        folder = shared_dir(spark)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, path = pafs.FileSystem.from_uri(folder)
            where.create_dir(path, recursive=True)
            ids: list[int | None] = []
            texts: list[bytes] = []

            def flush() -> pa.RecordBatch:
                name = f"{uuid.uuid4().hex}.parquet"
                with where.open_output_stream(f"{path}/{name}") as sink:
                    pq.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=schema), sink, compression="zstd", use_dictionary=False)
                stored_size = where.get_file_info(f"{path}/{name}").size
                out = pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([stored_size], pa.int64()), pa.array([len(ids)], pa.int64())], ["src", "size", "n"])
                ids.clear()
                texts.clear()
                return out

            have = 0
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if ids and have + len(t) > size or len(ids) == rows:
                        yield flush()
                        have = 0
                    ids.append(i)
                    texts.append(t)
                    have += len(t)
            if ids:
                yield flush()

        rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        self.table = stored(rows_of.mapInArrow(write, "src string, size long, n long"))
        self.count, self.bytes, self.rows = self.table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.names = self.table.select("src").repartition(max(1, self.count), F.xxhash64("src"))

    def sample(self, least: int = 16, share: int = 64) -> tuple[DataFrame, float]:
        """(names of about every share-th file, but `least` files if there are so many; the share that they are of all)."""
        part = min(1.0, max(1.0 / share, least / max(1, self.count)))
        return self.names.where(F.pmod(F.xxhash64("src", F.lit(1)), F.lit(1 << 20)) < int(part * (1 << 20))), part

    def by_file(self, df: DataFrame):
        """df grouped by src, a task for each file: what goes round between the steps is small, the files are not."""
        return df.repartition(max(1, self.count), "src").groupBy("src")

    def by_bucket(self, df: DataFrame, bits: int):
        """df grouped by bucket, in tasks for some 8 MB of the stored text each."""
        return df.repartition(max(12, min(1 << bits, self.bytes // 8_000_000)), "bucket").groupBy("bucket")

    def bits(self, bucket_bytes: int, least: int = 6, most: int = 24) -> int:
        """log2 of the number of buckets, about `bucket_bytes` of text in each."""
        bits = least
        while bits < most and 2.0 * self.bytes / (1 << bits) > bucket_bytes:
            bits += 1
        return bits


def read_unit(src: str, rows: int = 256) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """(doc_ids, texts in UTF-8) of a file, a few rows at a time."""
    where, name = pafs.FileSystem.from_uri(src)
    with where.open_input_file(name) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=["doc_id", "text"]):
            yield batch.column(0).to_pylist(), batch.column(1).to_pylist()


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def arrow_table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})
