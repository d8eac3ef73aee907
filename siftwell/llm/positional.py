"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments. A segment is one row that holds, for some
documents, each term's ascending positions; the index is a table in the shared
folder, so a lost executor costs no rebuilding. Test windows (runs of words of a
benchmark item) are sought in every segment without a shuffle: their terms'
position lists are shifted by the term's offset in the window and intersected,
the segment's rarest term first. A proximity match is a span of positions
within one document that begins and ends with a term of a window and holds all its terms, in any order.

Words are compared by 64-bit hashes. Benchmark items go to the executors in
blocks of a bounded number of words, however large the table of items is.

Defined results: null and wordless documents have no words and no hits; null and
wordless items match nothing; a very long document is one segment, searched whole;
repeated document rows are answered row by row; items that share an id count as one
item, and of equal windows in several items all items count; a null item id counts as
the empty string; other columns are ignored, whatever their names; an empty table of
items gives no hits, an empty table of documents no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, map_arrow, materialise, without

INDEX = "segment long, doc_ids array<long>, text_hashes array<long>, starts binary, terms binary, ends binary, positions binary"
HITS = "segment long, ordinal int, doc_id long, text_hash long, n_words long, hit binary, near binary, items array<string>"

#: ASCII letters, digits and all bytes above 127 are parts of words.
_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())


class Words:
    """Word hashes of texts."""

    def __init__(self):
        self.hasher = WordHasher(_GAPS)

    def __call__(self, texts: list[str | None], batch_bytes: int = 900_000) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            some.append((text or "").encode("utf-8", "replace"))
            size += len(some[-1]) + 1
            if size > batch_bytes:
                yield from self._split(some)
                some, size = [], 0
        yield from self._split(some)

    def _split(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        h, first = self.hasher(texts)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield h[a:b]


def build_index(docs: DataFrame, segment_words: int = 250_000) -> DataFrame:
    """Index rows over ``docs(doc_id, text)``, each of about ``segment_words`` words; a document is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, zip_ = Words(), zstd.ZstdCompressor(level=1)
        ids: list[int | None] = []
        keys: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal size
            counts = np.array([len(x) for x in found], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts + 1)])  # one unused position parts documents
            position = np.arange(counts.sum(), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
            flat = np.concatenate(found)
            order = np.argsort(flat, kind="stable")
            terms, first = np.unique(flat[order], return_index=True)
            listed = position[order].astype(np.uint32)
            steps = np.diff(listed, prepend=np.uint32(0))  # wraps around at each new term, and back when summed
            row = [[0], [list(ids)], [list(keys)], [starts.astype(np.uint32).tobytes()], [terms.tobytes()], [np.append(first, len(flat)).astype(np.uint32).tobytes()], [zip_.compress(steps.tobytes())]]
            ids.clear(), keys.clear(), found.clear()
            size = 0
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            texts = (t.as_py() for t in b.column(2))
            for doc_id, key, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), hashes(texts)):
                ids.append(doc_id)
                keys.append(key)
                found.append(h)
                size += len(h) + 1
                if size >= segment_words:
                    yield segment()
        if ids:
            yield segment()

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text"), F.col("text").cast("string").alias("text")), run, INDEX)
    return materialise(rows.withColumn("segment", F.monotonically_increasing_id()), "index")


class Windows:
    """Windows of a block of items: runs of words in one array of term numbers. Nothing is held per window but its start, length and item."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        each = list(Words()(t for _, t in items))
        n = np.array([len(h) for h in each], np.int64)
        flat = np.concatenate([*each, np.zeros(0, np.uint64)])
        self.terms, self.number = np.unique(flat, return_inverse=True)
        windows = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        self.start = np.repeat(np.cumsum(n) - n - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        self.length = np.minimum(n, width)[self.item]
        self.names = [i for i, _ in items]

    def held_by(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Each different window all of whose terms are among ``terms`` (sorted), as term hashes, and its items."""
        if not len(self.terms) or not len(terms):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        present = np.zeros(len(self.terms), bool)
        present[at[self.terms[at] == terms]] = True
        absent = np.concatenate([[0], np.cumsum(~present[self.number])])
        found: dict[bytes, set[str]] = {}
        for w in np.nonzero(absent[self.start + self.length] == absent[self.start])[0].tolist():
            own = self.terms[self.number[self.start[w] : self.start[w] + self.length[w]]]
            found.setdefault(own.tobytes(), set()).add(self.names[self.item[w]])
        for own, names in found.items():
            yield np.frombuffer(own, np.uint64), sorted(names)


class Segment:
    """A decoded index row."""

    def __init__(self, row: dict, unzip: zstd.ZstdDecompressor):
        self.doc_ids, self.text_hashes = row["doc_ids"], row["text_hashes"]
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(unzip.decompress(row["positions"]), np.uint32), dtype=np.uint32).astype(np.int64)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's list is, and its length, 0 if the segment lacks the term."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        if not len(self.terms):
            return at, np.zeros_like(at)
        return at, np.where(self.terms[at] == terms, self.ends[at + 1] - self.ends[at], 0)

    def list(self, at: int) -> np.ndarray:
        return self.positions[self.ends[at] : self.ends[at + 1]]

    def phrase(self, at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of exact occurrences; ``order``: offsets, the rarest term first."""
        starts = self.list(at[order[0]]) - order[0]
        for k in order[1:]:
            other = self.list(at[k])
            seek = starts + k
            i = np.searchsorted(other, seek)
            i[i == len(other)] = 0
            starts = starts[other[i] == seek]
            if not len(starts):
                break
        return starts

    def near(self, at: np.ndarray, order: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the spans within one document, at most ``reach`` positions long, that begin and end with a term and hold all terms; of those with one start, the longest."""
        terms = at[order[np.sort(np.unique(at[order], return_index=True)[1])]]  # distinct, the rarest first
        centre = self.list(terms[0])
        for k in terms[1:]:  # every span holds the rarest term, and the others less than reach away from it
            other = self.list(k)
            i = np.searchsorted(other, centre)
            before, after = other[np.maximum(i - 1, 0)], other[np.minimum(i, len(other) - 1)]
            centre = centre[np.minimum(np.abs(before - centre), np.abs(after - centre)) < reach]
            if not len(centre):
                return centre, centre
        start = np.unique((centre[:, None] - np.arange(reach)).ravel())
        start = start[start >= 0]
        last = np.minimum(start + reach, self.starts[np.searchsorted(self.starts, start, side="right")] - 1) - 1  # the document's end
        first, whole, end = np.full(len(start), np.iinfo(np.int64).max), np.ones(len(start), bool), np.zeros(len(start), np.int64)
        for k in terms:
            other = self.list(k)
            i, j = np.searchsorted(other, start), np.searchsorted(other, last, side="right")
            whole &= i < j
            first = np.minimum(first, other[np.minimum(i, len(other) - 1)])
            end = np.maximum(end, other[np.maximum(j - 1, 0)])
        good = whole & (first == start)
        return start[good], end[good] + 1


def search(index: DataFrame, block: list[tuple[str, str | None]], width: int, reach: int) -> DataFrame:
    """Per document of ``index``: its hit positions and the block's items that occur in it; ``hit`` and ``near`` are packed bits by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, unzip = Windows(block, width), zstd.ZstdDecompressor()
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                seg = Segment(row, unzip)
                total = int(seg.starts[-1])
                edges = {"hit": np.zeros(total + 1, np.int32), "near": np.zeros(total + 1, np.int32)}
                items: dict[int, set[str]] = {}
                for terms, names in wanted.held_by(seg.terms):
                    at, n = seg.lists(terms)
                    order = np.argsort(n, kind="stable")
                    # a phrase's own span holds all its terms, so each phrase match of up to reach words is a proximity match too
                    low, high = seg.near(at, order, reach)
                    if len(low):
                        np.add.at(edges["near"], low, 1)
                        np.add.at(edges["near"], high, -1)
                    starts = seg.phrase(at, order)
                    if len(starts):
                        np.add.at(edges["hit"], starts, 1)
                        np.add.at(edges["hit"], starts + len(terms), -1)
                        for d in set((np.searchsorted(seg.starts, starts, side="right") - 1).tolist()):
                            items.setdefault(d, set()).update(names)
                cover = {k: np.cumsum(v[:-1]) > 0 for k, v in edges.items()}
                some = {k: np.add.reduceat(v, seg.starts[:-1]) > 0 if total else np.zeros(0, bool) for k, v in cover.items()}
                m = len(seg.doc_ids)
                bits = {k: [np.packbits(v[seg.starts[d] : seg.starts[d + 1] - 1]).tobytes() if some[k][d] else None for d in range(m)] for k, v in cover.items()}
                arrays = [
                    pa.array([row["segment"]] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(seg.doc_ids, pa.int64()), pa.array(seg.text_hashes, pa.int64()), pa.array(np.diff(seg.starts) - 1, pa.int64()),
                    pa.array(bits["hit"], pa.binary()), pa.array(bits["near"], pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(m)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in HITS.split(", ")])

    return map_arrow(index, run, HITS)


def blocks_of(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about ``block_words`` words, at six characters a word; the driver holds one partition of items and one block at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((r["item_id"] or "", r["text"]))
        size += 1 + len(r["text"] or "") // 6
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(parts: DataFrame) -> DataFrame:
    """One row per document from its rows for each block."""

    def joined(pdf):
        out = pdf.iloc[:1].copy()
        for k in ("hit", "near"):
            bits = [np.frombuffer(x, np.uint8) for x in pdf[k] if x is not None]
            out[k] = [np.bitwise_or.reduce(bits).tobytes() if bits else None]
        out["items"] = [sorted({i for x in pdf["items"] for i in x})]
        return out

    return parts.groupBy("segment", "ordinal").applyInPandas(joined, HITS)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, reach: int = 14, block_words: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash (Spark's xxhash64), n_words, n_hit (words in exact occurrences of a window), n_items, items_sha256, contaminated, n_near, item_ids.

    ``width`` is the window; ``reach`` the most positions of a proximity match, whose words n_near counts.
    """
    index = build_index(docs)
    blocks = blocks_of(items, block_words)
    parts, several = search(index, next(blocks, []), width, reach), False
    for block in blocks:
        # written block by block, so that neither the driver nor a plan holds the texts of more than two
        parts, several = (parts if several else materialise(parts, "hits")).unionByName(materialise(search(index, block, width, reach), "hits")), True
    return counted(_merged(parts) if several else parts)


def counted(hits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {k: [0 if x is None else int.from_bytes(x, "big").bit_count() for x in b.column(k).to_pylist()] for k in ("hit", "near")}
            items = b.column("items").to_pylist()
            arrays = [
                b.column("doc_id"), b.column("text_hash"), b.column("n_words"), pa.array(n["hit"], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in n["hit"]], pa.bool_()), pa.array(n["near"], pa.int64()), b.column("items"),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "item_ids"])

    return map_arrow(hits, run, "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, item_ids array<string>")


def without_contaminated(docs: DataFrame, found: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` less the documents that ``found`` calls contaminated."""
    gone = materialise(found.filter("contaminated").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct(), "contaminated")
    return without(docs, gone, broadcast_rows)
