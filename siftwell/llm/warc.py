"""WARC archives with a Zstandard dictionary, and their reader.

Every archive file begins with a skippable frame that holds a dictionary built
from the file's own first records; every record is a frame of its own,
compressed with it. Payloads of at least ``least`` bytes that occur again are
archived once: the row with the smallest page id is a response, the others are
revisit records that refer to it.

Defined results: a null html counts as an empty payload; a null url is archived
as an empty target; null page ids come after all others; of rows that repeat
both page id and payload one is the response and the others revisit it; very long
payloads are archived whole; other columns are ignored, whatever their names; an empty
table gives no archives and no rows. The input is read twice and must be the same each time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, workspace

#: Fixed values of the WARC/1.1 and Zstandard formats.
SKIPPABLE = 0x184D2A5D
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

FILES = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, path string, offset long"


def with_roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest, record_type and refers_to.

    Digests meet in a partial aggregation, so a payload that very many pages
    share is counted before it moves; the payloads move only if Spark finds the
    repeated ones too many to broadcast.
    """
    # "row" serves as the key of small payloads, so that they meet nowhere and crowd no task
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row")
    )
    large = rows.filter(F.col("payload_bytes") >= least)
    # null ids last; "row" parts rows that repeat an id
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    repeated = large.groupBy(F.unhex("digest").alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    joined = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.unhex("digest")).otherwise(F.col("row").cast("string").cast("binary"))).join(repeated, "key", "left")
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    body = HTTP_HEAD + payload if kind == "response" else HTTP_HEAD
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = 1 << 16) -> bytes:
    """A dictionary trained on the records, of each the first 65,536 bytes; where they are too few to train one, the ends of those bytes as raw content."""
    samples = [r[:65536] for r in records]
    if sum(map(len, samples)) >= 8 * size and len(samples) >= 16:
        try:
            return zstd.train_dictionary(size, samples, level=3).as_bytes()
        except zstd.ZstdError:  # samples of which nothing can be trained
            pass
    share = max(1, size // max(1, len(samples)))
    # raw content begins with no dictionary's magic number, as every record begins with "WARC"
    return b"".join(r[:share] for r in samples)[:size]


class Archive:
    """Writes one archive file: the first ``sample_bytes`` of records wait until the dictionary is built from them."""

    def __init__(self, folder: str, level: int, sample_bytes: int):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{uuid.uuid4().hex}.warc.zst"
        self.level, self.sample_bytes = level, sample_bytes
        self.waiting: list[bytes] = []
        self.waits = self.bytes = self.records = 0
        self.out = self.zip = None

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.zip is None:
            self.waiting.append(rec)
            self.waits += len(rec)
            if self.waits >= self.sample_bytes:
                self._start()
        else:
            self._put(self.zip.compress(rec))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        self.out = self.fs.open_output_stream(self.path, compression=None)
        raw = build_dictionary(self.waiting)
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
        d.precompute_compress(level=self.level)
        self.zip = zstd.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True, write_content_size=True)
        self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for rec in self.waiting:
            self._put(self.zip.compress(rec))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.zip is None:
            self._start()
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, least: int = 100, level: int = 6, file_bytes: int = 256 << 20, sample_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` under ``folder``; returns the list of finished files.

    ``file_bytes`` bounds a file's compressed size; ``sample_bytes`` bounds the
    records a dictionary is built from. File names are new for every attempt of
    a task, and only the list says which files count, so an attempt that fails or
    runs twice leaves no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            # row by row: the payloads of a batch are not copied at once
            for row in zip(*b.columns):
                archive = archive or Archive(folder, level, sample_bytes)
                archive.add(record(*[x.as_py() for x in row], date))
                if archive.bytes >= file_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    where = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    rows = with_roles(pages, least).select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return materialise(map_arrow(rows, run, FILES), "archives")


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record's frame; memory holds one chunk and one record."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("an archive must begin with the frame of its dictionary")
    raw = stream.read(size)
    unzip = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO))
    at, held = 8 + size, b""
    while True:
        got = held or stream.read(chunk)
        if not got:
            return
        one, parts, used = unzip.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(got))
            used += len(got)
            if one.eof:
                held = one.unused_data
                used -= len(held)
                break
            got = stream.read(chunk)
            if not got:
                raise ValueError("an archive ends within a record")
        yield at, b"".join(parts)
        at += used


def parse(rec: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target of a record; a response's payload is measured, and must match its header."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    n = int(fields["Payload-Length"])
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != said:
            raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    whole = lambda k: int(fields[k]) if k in fields else None
    return whole("Page-ID"), n, said, kind, whole("Refers-To-Page-ID"), fields.get("WARC-Target-URI", "")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """A row per record of ``files(path, ..)``, with its file and the offset of its frame; files are dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        store = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for at, rec in frames(stream):
                        rows.append((*parse(rec), path, at))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    spark: SparkSession = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files.select("path").repartition(tasks, "path"), run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and return what the archives hold."""
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
