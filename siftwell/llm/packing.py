"""Best-fit packing of tokenised documents, certified by dual-feasible functions.

Documents are tokenised and cut; pieces shorter than a sequence are dealt evenly
over partitions, each of which runs best-fit decreasing. A lower bound from
families of dual-feasible functions certifies a partition whose bins equal it.
The others put the documents of their bins with gaps together, whole bins going
to fewer, mixed partitions, and run best-fit decreasing again; where that meets no
bound, bins are filled one by one with the largest piece left and the others that
leave the least room (subset sums). A repacking is taken only where it needs fewer bins.

Defined results: a null text counts as empty and gives the end token alone; very
long texts, and long runs of one character, are cut like any others; null or
repeated ``doc_id`` values are packed like any others, row by row; pieces of equal
length go by input order; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, packed_round int, bound_met boolean"

#: Fixed value: the pre-tokenising pattern of the byte-level BPE vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Ids of a byte-level BPE ``tokenizer.json``.

    Texts of Latin script go through a faster encoder built from the same
    file's vocabulary; all others, and texts that spell a special token or
    hold a very long run without or of spaces, on which the faster one's pattern
    fails, go through the file's own tokenizer. Both give the same ids.
    """

    LONG = 2000
    SPACES = re.compile(rf"\s{{{LONG}}}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown}
        letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letter[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        latin = text.isascii() or max(text) <= "ɏ"
        long_run = len(text) >= self.LONG and self._long_run(text)
        if not latin or long_run or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def _long_run(self, text: str) -> bool:
        sizes = [*map(len, text.split())]
        # no run of spaces is longer than all spaces but one between each two words
        spare = len(text) - sum(sizes) - len(sizes)
        return max(sizes, default=0) >= self.LONG or spare >= self.LONG - 2 and self.SPACES.search(text) is not None


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_token: int) -> DataFrame:
    """One row per piece of each document: only a document's first piece may be shorter than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[], [], [], [], []]
            for doc_id, text in zip(ids, batch.column(1)):
                arr = np.array([*tokens(text.as_py() or ""), end_token], dtype="<u4")
                n = len(arr)
                ends = range(n % capacity or capacity, n + 1, capacity)
                at = 0
                for piece, end in enumerate(ends):
                    for column, value in zip(out, (doc_id, piece, at, end - at, zlib.crc32(arr[at:end].tobytes()))):
                        column.append(value)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``lengths`` needs, by dual-feasible functions.

    Three families, each with every parameter: rounding above a threshold
    (drop items of at most t, count items above capacity - t as whole), the
    staircase floor((k+1)x)/k, and their composition over capacity halves.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    sizes = np.nonzero(counts)[0]
    c = counts[sizes].astype(np.int64)
    best = -(-int((sizes * c).sum()) // capacity)
    half = capacity // 2
    for t in np.unique(np.concatenate([sizes[sizes <= half], capacity + 1 - sizes[sizes > half], [half]])):
        f = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((f * c).sum()) // capacity))
    for k in range(2, 25):
        up = (k + 1) * sizes
        f = np.where(up % capacity == 0, sizes * k, (up // capacity) * capacity)
        best = max(best, -(-int((f * c).sum()) // (k * capacity)))
    for t in np.unique(sizes[sizes <= half]):
        # items above half: capacity less the t-items that fit beside them; else whole t-items
        whole = capacity // t
        f = np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // t), np.where(2 * sizes == capacity, whole, 2 * (sizes // t)))
        best = max(best, -(-int((f * c).sum()) // (2 * whole)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin number and offset of each item, and the number of bins. Ties: longer first, then input order; fullest bin first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []  # the room sizes that have an open bin, ascending
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[at]
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not open_bins[left]:
                insort(rooms, left)
            open_bins[left].append(b)
    return bins, offsets, n


def fill_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """As best_fit_decreasing, but each bin takes the longest item left and those that fill the rest best, by subset sums; longer ones are preferred."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    left: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        left.setdefault(int(lengths[i]), []).append(i)
    sizes, n = sorted(left, reverse=True), 0
    while sizes:
        room = capacity - sizes[0]
        taken, sums, steps = [sizes[0]], 1, []  # sums: bit k is set if some of the items seen add up to k
        left_of = lambda s: len(left[s]) - (s == sizes[0])
        for s in sizes:
            most, times = min(left_of(s), room // s), 1
            while most > 0:
                k = min(times, most)
                steps.append((s, k, sums))
                sums |= (sums << k * s) & ((1 << room + 1) - 1)
                most, times = most - k, 2 * times
            if sums >> room:
                break
        at = sums.bit_length() - 1
        for s, k, before in reversed(steps):
            if not before >> at & 1:
                taken += [s] * k
                at -= k * s
        place = 0
        for s in taken:
            i = left[s].pop()
            bins[i], offsets[i] = n, place
            place += s
        n += 1
        sizes = [s for s in sizes if left[s]] if any(not left[s] for s in taken) else sizes
    return bins, offsets, n


def _pack(pdf: pd.DataFrame, capacity: int, round_no: int) -> pd.DataFrame:
    """Pack a partition; from the second round on, keep the former bins unless fewer suffice."""
    lengths = pdf["length"].to_numpy()
    bound = lower_bound(lengths, capacity)
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    if round_no and n > bound and (other := fill_bins(lengths, capacity))[2] < n:
        bins, offsets, n = other
    if round_no and (before := pdf["sequence_id"].nunique()) <= n:
        out, n = pdf.copy(), before
    else:
        number = (round_no << 56) + (int(pdf["part"].iloc[0]) << 26) + bins
        out = pdf.assign(sequence_id=number, offset=offsets, packed_round=round_no)
    filled = out.groupby("sequence_id")["length"].transform("sum")
    return out.assign(bound_met=n == bound, gap=(n > bound) & (filled < capacity))[[*PACKED_COLUMNS, "gap"]]


def _packer(capacity: int, round_no: int):
    return lambda pdf: _pack(pdf, capacity, round_no)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_token: int = 2, per_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their sequence and offset, in about as few sequences as the bound allows.

    ``per_partition`` is the number of pieces packed in one task, at most 2**26;
    ``rounds`` counts the exchanges after the first packing. Full pieces are
    sequences of their own and take no part. ``bound_met`` says that the
    piece's partition has as few bins as its lower bound.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, capacity, end_token).withColumn("row", F.monotonically_increasing_id()), "pieces")
    alone = ((F.lit(127).cast("long") * (1 << 56)) + F.col("row")).alias("sequence_id")
    done = pieces.filter(F.col("length") == capacity).select(*PIECES_COLUMNS, alone, F.lit(0).cast("long").alias("offset"), F.lit(0).alias("packed_round"), F.lit(True).alias("bound_met"))
    todo = pieces.filter(F.col("length") < capacity)
    for round_no in range(rounds + 1):
        n = todo.count()
        if not n:
            break
        # rows are dealt evenly at first; later whole bins change partitions, so that former bins can be counted
        dealt = F.xxhash64("sequence_id" if round_no else "row", F.lit(round_no))
        parted = todo.withColumn("part", F.pmod(dealt, F.lit(-(-n // per_partition))))
        packed = materialise(parted.groupBy("part").applyInPandas(_packer(capacity, round_no), PACKED + ", gap boolean"), f"packed{round_no}")
        if round_no == rounds:
            return done.unionByName(packed.drop("gap"))
        done = done.unionByName(packed.filter(~F.col("gap")).drop("gap"))
        todo = packed.filter("gap").drop("gap")
    return done


PIECES_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]
PACKED_COLUMNS = [x.split()[0] for x in PACKED.split(", ")]
