"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes is the smallest within
``reach`` bytes on either side. Whether a byte ends a chunk thus depends on the
bytes around it alone: text inserted before or after a passage moves no boundary
within it, and no chunk but a text's first and last is shorter than ``reach``.
Chunks are compared by 128-bit digests; runs of chunks that other documents hold
too, parted where their first holder changes, are the repeated passages. The first holder keeps its copy.

Defined results: null and empty texts have no chunks; a passage repeated within
one document alone is none of this operator's; rows that repeat both doc_id and
text count as one document; null ids come after all others; very long texts are
chunked whole; other columns are ignored, whatever their names; an empty table gives
an empty result; offsets are in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, map_arrow

_PAD = 128
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
CHUNKS = "doc_id long, text_hash long, seq int, start int, end int, d1 long, d2 long"


def gear_hashes(b: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear[byte j back] << j over the last 32 bytes, by doubling the span five times."""
    h = _GEAR[b]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values, by its first place."""
    have, out = 1, h
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - have : width - have + len(h) - width + 1]) if width > have else out


def boundaries(b: np.ndarray, reach: int) -> np.ndarray:
    """Places after which a chunk ends; ``b`` must be padded by ``reach`` bytes at both ends."""
    h = gear_hashes(b)
    low = _smallest(h, reach)
    mid = h[reach:-reach]
    before, after = low[: len(mid)], low[reach + 1 : reach + 1 + len(mid)]
    return np.nonzero((mid < before) & (mid <= after))[0] + reach + 1


def chunks_of(texts: list[bytes], reach: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which text, start, end and digest of each chunk. Zero bytes part the texts, so that each is cut as if alone."""
    pad = bytes(_PAD)
    joined = pad + b"".join(t + pad for t in texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = _PAD + np.concatenate([[0], np.cumsum(sizes + _PAD)[:-1]])
    cuts = boundaries(np.frombuffer(joined, np.uint8), reach)
    of = np.searchsorted(first, cuts, side="right") - 1
    inside = (of >= 0) & (cuts < first[of] + sizes[of])
    ends = np.concatenate([cuts[inside], (first + sizes)[sizes > 0]])
    of = np.concatenate([of[inside], np.nonzero(sizes > 0)[0]])
    order = np.argsort(ends, kind="stable")
    ends, of = ends[order], of[order]
    starts = np.where(np.diff(of, prepend=-1) != 0, first[of], np.concatenate([[0], ends[:-1]])) if len(of) else ends
    if len(ends) and (ends - starts).max() > longest:  # cut further where no boundary comes for long
        parts = -(-(ends - starts) // longest)
        which = np.repeat(np.arange(len(ends)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, of = starts[which] + nth * longest, np.minimum(starts[which] + (nth + 1) * longest, ends[which]), of[which]
    view = memoryview(joined)
    digest = xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)
    return of, starts - first[of], ends - first[of], digests


def chunk(docs: DataFrame, reach: int = 24, longest: int = 4096, batch_bytes: int = 2 << 20) -> DataFrame:
    """A row per chunk of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple]) -> pa.RecordBatch:
            of, start, end, d = chunks_of([t for _, _, t in some], reach, longest)
            new = np.diff(of, prepend=-1) != 0
            at = np.nonzero(new)[0]
            seq = np.arange(len(of)) - np.repeat(at, np.diff(at, append=len(of)))
            ids = pa.array([x[0] for x in some], pa.int64()).take(pa.array(of))
            hashes = np.array([x[1] for x in some], np.int64)[of]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(x, t) for x, t in ((hashes, pa.int64()), (seq, pa.int32()), (start, pa.int32()), (end, pa.int32()), (d[:, 0], pa.int64()), (d[:, 1], pa.int64()))]], names=[x.split()[0] for x in CHUNKS.split(", ")])

        some, size = [], 0
        for b in batches:
            for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                some.append((doc_id, text_hash, text.as_py().encode("utf-8", "replace")))
                size += len(some[-1][2]) + _PAD
                if size >= batch_bytes:
                    yield rows(some)
                    some, size = [], 0
        if some:
            yield rows(some)

    inputs = docs.filter("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return map_arrow(inputs, run, CHUNKS)


def repeated_passages(docs: DataFrame, least_chunks: int = 2, least_bytes: int = 100, reach: int = 24, longest: int = 4096) -> DataFrame:
    """Passages that several documents hold: doc_id, text_hash, start, end, n_chunks, keeper, n_repeated.

    A run of at least ``least_chunks`` chunks and ``least_bytes`` bytes, each chunk
    held by another document too, is parted where the document that keeps its
    chunks changes, and each part, however short, is a passage. ``keeper`` is the
    smallest doc_id that holds its chunks; ``n_repeated`` is n_chunks, or 0 where
    this document's copy is the one to keep.
    """
    chunks = chunk(docs, reach, longest)
    holder = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # holders as min and max: a digest that very many documents hold is one row of each task
    held = chunks.groupBy("d1", "d2").agg(F.min(holder).alias("first"), F.max(holder).alias("last")).filter("first <> last").select("d1", "d2", "first")
    again = chunks.join(held, ["d1", "d2"])
    own = Window.partitionBy("doc_id", "text_hash").orderBy("seq")
    # rows that repeat both id and text are one document: dense_rank, not row_number
    runs = again.withColumn("run", F.col("seq") - F.dense_rank().over(own)).withColumn("other", (~F.col("first").eqNullSafe(F.lag("first").over(own))).cast("int"))
    parts = runs.withColumn("part", F.sum("other").over(own)).groupBy("doc_id", "text_hash", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("seq").alias("n_chunks"), F.first("first").alias("keeper"),
    )
    run = Window.partitionBy("doc_id", "text_hash", "run")
    long_ = (F.sum("n_chunks").over(run) >= least_chunks) & (F.max("end").over(run) - F.min("start").over(run) >= least_bytes)
    n_repeated = F.when(F.col("keeper") != holder, F.col("n_chunks")).otherwise(F.lit(0).cast("long")).alias("n_repeated")
    return parts.withColumn("long", long_).filter("long").select("doc_id", "text_hash", "start", "end", "n_chunks", F.col("keeper.doc_id").alias("keeper"), n_repeated)


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut of which every chunk is kept elsewhere; byte offsets never part a character twice."""
    cuts = passages.filter("n_repeated = n_chunks").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cuts"))
    joined = keyed(docs).join(cuts, F.col("k_id").eqNullSafe(F.col("__id")) & (F.col("k_hash") == F.col("__hash")), "left")

    @F.pandas_udf("string")
    def cut(text, cuts):
        def one(t, c):
            if t is None or c is None:
                return t
            raw, out, at = t.encode(), [], 0
            for x in c:
                out.append(raw[at : x["start"]])
                at = x["end"]
            # a boundary may lie within a character; what is left of one is dropped
            return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

        import pandas as pd

        return pd.Series([one(t, c) for t, c in zip(text, cuts)])

    left = joined.withColumn("__left", cut(F.col("row")["text"], "__cuts"))
    return left.select(*[F.col("__left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
