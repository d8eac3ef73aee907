"""Shared helpers: materialised tables in the cluster's shared folder, and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and the
    master is local (tests), a temporary folder of this machine serves, which is
    then shared by definition; on a cluster there is none.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='siftwell-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/siftwell-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a workspace whose table nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch space
            pass


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back; also the path.

    This cuts the lineage on storage that outlives any executor, and keeps
    costly Python work from running twice.
    """
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """As ``written``; the table stays until the driver ends."""
    return written(df, name)[0]


def keyed(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, with k_id and k_hash, its doc_id and text hash: joins on these clash with no column's name."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_hash"))


def without(docs: DataFrame, gone: DataFrame, broadcast_rows: int) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text hash) is in ``gone(g_id, g_hash)``, a written table."""
    # checked: at most so many pairs of numbers go to every executor, else both sides are dealt by key
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return keyed(docs).join(side, F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_hash") == F.col("g_hash")), "left_anti").select("row.*")


_BATCH, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BATCH_ROWS = 2_000


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library, whose allocator has no such call
        return None


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``; each task gives what it has freed back to the system, as Python workers live on and would keep the largest task's memory.

    Unless the session sets it, batches hold at most ``BATCH_ROWS`` rows: whole texts are long rows.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


class WordHasher:
    """64-bit hashes of all words of many texts at once.

    Words are hashed eight bytes at a step by bijective scrambles that begin with the
    word's length, so that words of equal length up to eight bytes never collide and
    no arithmetic pattern of bytes does; words above ``long_word`` bytes by xxh3. Bytes
    in ``gaps`` part words; ASCII letters count as lower case.
    """

    _KEY = np.uint64(0x9E3779B97F4A7C15)
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, gaps: bytes, long_word: int = 256):
        self.long_word = long_word
        self.table = bytes(32 if b in gaps else b + 32 if 65 <= b <= 90 else b for b in range(256))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes in order, and where each text's words begin, with the end."""
        joined = (b" " + b" ".join(texts) + b" ").translate(self.table) + bytes(8)
        parted = np.frombuffer(joined, np.uint8)[:-8] == 32
        edges = np.diff(parted.view(np.int8))
        starts, ends = np.nonzero(edges == -1)[0] + 1, np.nonzero(edges == 1)[0] + 1
        n = ends - starts
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))  # the eight bytes from each place on
        with np.errstate(over="ignore"):
            hashes = mixed(mixed(n.astype(np.uint64) * self._KEY) ^ (eight[starts] & self._MASKS[np.minimum(n, 8)]))
            at, more = 8, np.nonzero((n > 8) & (n <= self.long_word))[0]
            while len(more):
                hashes[more] = mixed((hashes[more] * self._KEY) ^ (eight[starts[more] + at] & self._MASKS[np.minimum(n[more] - at, 8)]))
                at += 8
                more = more[n[more] > at]
        for i in np.nonzero(n > self.long_word)[0].tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
        first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.ones(1, np.int64)
        return hashes, np.searchsorted(starts, first)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
