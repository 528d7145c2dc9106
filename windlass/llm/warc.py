"""WARC archives as .warc.zst: a dictionary per archive in a leading skippable frame, one Zstandard frame per record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, shared_dir, stored

# Fixed values of the .warc.zst format.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"

#: Size of a trained dictionary, and the bytes of the archive's first records that train it.
DICTIONARY_BYTES, SAMPLE_BYTES = 32_768, 1_000_000
#: An archive is closed once its records hold this many bytes, so a task writes several when it has more.
ARCHIVE_BYTES = 64_000_000
LEVEL = 3


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: object) -> str:
    return "".join(c for c in str(value) if c >= " ")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit carries the HTTP head of the full payload, without the payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; a few records are too little to train on, so their bytes are then the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
        raw = raw if not raw.startswith(DICTIONARY_MAGIC) else b"\n" + raw
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes archives below a folder; holds at most SAMPLE_BYTES (or one record) of uncompressed records."""

    def __init__(self, uri: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(uri)
        self.sink = None
        self.waiting: list[bytes] = []
        self.held = self.count = self.total = 0
        self.path = ""

    def add(self, record: bytes) -> Iterator[tuple[str, int, int]]:
        self.count += 1
        self.total += len(record)
        if self.sink is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self.sink.write(self.compressor.compress(record))
        if self.total >= ARCHIVE_BYTES:
            yield from self.close()

    def _open(self) -> None:
        dictionary = train_dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.sink = self.fs.open_output_stream(self.path)
        raw = dictionary.as_bytes()
        self.sink.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        for record in self.waiting:
            self.sink.write(self.compressor.compress(record))
        self.waiting, self.held = [], 0

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.count:
            if self.sink is None:
                self._open()
            self.sink.close()
            yield self.path.rsplit("/", 1)[1], self.count, self.total
        self.sink, self.count, self.total = None, 0, 0


def read_archive(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, decoded as a stream with the dictionary of the leading frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    with io.BufferedReader(decoder.stream_reader(stream, read_across_frames=True), 1 << 20) as lines:
        while line := lines.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError("a record does not start where the last one ends")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                key, _, value = line.decode().partition(": ")
                headers[key] = value
            block = lines.read(int(headers["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, block


def find_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload equals one with a larger page_id; payloads below min_bytes have none."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keys = stored(pages.select("page_id", F.sha2(html, 256).alias("k"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes))
    last = keys.groupBy("k").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    return stored(keys.join(last, "k").where("page_id < refers_to").select(F.col("page_id").alias("__id"), "refers_to").distinct())


def write_archives(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Writes a record per row of pages (page_id, url, html); returns the folder and the stored manifest (name, records, bytes).

    A lost task writes its archives again under new names; only names that reached the manifest count.
    """
    spark = pages.sparkSession
    revisits = checked_broadcast(find_revisits(pages, min_bytes))
    rows = pages.select("page_id", "url", "html").join(revisits, F.col("page_id") == F.col("__id"), "left")
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("refers_to").cast("long"))
    folder = shared_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        writer = ArchiveWriter(folder)
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            for page, url, payload, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), strict=True):
                done += writer.add(record_bytes(page, url, payload or b"", refers))
        done += writer.close()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["name", "records", "bytes"])

    return folder, stored(rows.mapInArrow(write, "name string, records long, bytes long"))


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the named archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    The digest of a response is computed anew from its payload and must equal its header; a revisit has its payload's
    length and digest from its headers and no html.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        number = lambda x: int(t) if (t := x[len("<urn:page:") : -1]) else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(f"{path}/{name}") as stream:
                    for headers, block in read_archive(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if response and (len(payload) != length or sha1_base32(payload) != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not match its headers")
                        rows.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, headers["WARC-Type"], None if response else number(headers["WARC-Refers-To"]), payload if response else None))
                        held += len(payload)
                        if held > 4_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("name").repartition(tasks).mapInArrow(read, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.record_batch([*columns[:6], columns[6].cast(pa.string())], names)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives and reads them back (read_archives), without the html.

    Null html is an empty payload, a null url leaves out the target URI, a null page_id stays null and refers to nothing.
    Of equal payloads of min_bytes or more, the row with the largest page_id is the response and others revisit it;
    rows that repeat that page_id are responses too. An empty table gives an empty result; other columns are not read.
    """
    return read_archives(*write_archives(pages, min_bytes)).drop("html")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: right(bin(CAST('0x' || c AS INTEGER) + 16), 4)), '') AS b FROM m)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits
"""
