"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document is the set of hashes of its word shingles. Sets fall into bands by
size, and in each band the hash universe is parted into segments. Two sets with
Jaccard of at least t = p/q differ in at most D = (r + s)(1 - t)/(1 + t) elements, so
at most D of one set's non-empty segments differ from the other's, and the H + 1
segments that come first in any common order (H bounding D over all partners)
hold a common one. Each set is therefore indexed under the subset of its H + 1
cheapest segments: cost is how common a segment's rarest element is, counted over
all documents by a lossy counter, so very common passages are not indexed where
anything rarer is there. Small sets take one or two segments and also index each
segment's one-deletion neighbourhood, which allows one difference a segment.

Sets under one index entry are candidates; no pair leaves the task that finds it.
Parity sketches first rule pairs out within an entry, and a spanning forest of the
others goes on: at most n - 1 rows for n sets. Its components are families, which no
link leaves. Each family's sets meet once, in blocks of bounded size; every two are
compared exactly there, and a spanning forest of the links, with each set's number of
links, goes on. Equal sets are one class throughout. A class is known by a 64-bit sum
of its elements' scrambled hashes, and checked by a second one: should two different
sets share a number, all are numbered anew.

Defined results: null and wordless texts have the empty set, and are linked with
nothing; with fewer words than a shingle has, all words make one shingle; repeated
rows are members of one class; very long texts are sets like any others; a null id is
never a component's name unless all its members' are null; there are no ties; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, keyed, map_arrow, materialise, mixed, without
from .components import components

PROFILE = "doc_id long, text_hash long, n_shingles long, cls long, check long, sketch binary, hot array<long>, hot_n array<int>"
ENTRIES = "sig long, salt int, size int, cls long"
FOUND = "key long, n int, cls long, size int"
LINKS = "a long, b long, cls long, n long"
_M = np.uint64(0x9E3779B97F4A7C15)
#: Sets up to this size are indexed by one-deletion neighbourhoods.
SMALL = 11


#: The characters that part words.
_GAPS = bytes([32, *range(9, 14)])


class Shingler:
    def __init__(self, width: int):
        self.width, self.hasher = width, WordHasher(_GAPS)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        some: list[bytes] = []
        size = 0
        for text in texts:
            some.append((text or "").encode("utf-8", "replace"))
            size += len(some[-1]) + 1
            if size > 900_000:
                out += self._sets(some)
                some, size = [], 0
        return out + self._sets(some) if some else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        h, first = self.hasher(texts)
        with np.errstate(over="ignore"):
            whole = h[: max(0, len(h) - self.width + 1)].copy()
            for i in range(1, self.width):
                whole = mixed(whole) * _M + h[i : len(whole) + i]
            whole = mixed(whole + np.uint64(self.width))
            return [np.unique(whole[a : b - self.width + 1]) if b - a >= self.width else self._short(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def _short(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        x = h[:1].copy()
        for i in range(1, len(h)):
            x = mixed(x) * _M + h[i]
        return mixed(x + np.uint64(len(h)))


def sketch_of(x: np.ndarray) -> bytes:
    """Parities of the numbers of elements by the low bits of their hashes, one or two bits an element.

    Two sets' sketches differ in at most as many bits as the sets in elements.
    """
    if not len(x):
        return b""
    bits = 1 << max(3, (len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the smaller's size."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n > m:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    while m > n:
        m //= 2
        y = (y >> (8 * m)) ^ (y & ((1 << (8 * m)) - 1))
    return (x ^ y).bit_count()


def class_of(x: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        key = mixed(np.array([seed], np.uint64) * _M + _M)
        return int(mixed(mixed(x ^ key).sum(keepdims=True) + np.uint64(len(x)))[0].astype(np.int64)) if len(x) else 0


class Threshold:
    """Jaccard of at least percent/100, in integers."""

    def __init__(self, percent: int):
        self.p = percent

    def holds(self, both: int, r: int, s: int) -> bool:
        return 100 * both >= self.p * (r + s - both)

    def differ(self, r: int, s: int) -> int:
        """Most elements in which linked sets of these sizes can differ."""
        least = -(-self.p * (r + s) // (100 + self.p))
        return r + s - 2 * least

    @lru_cache(maxsize=100_000)
    def most(self, size: int, low: int, high: int) -> int:
        """Most elements in which a set of this size can differ from linked ones of sizes from low to high.

        differ() is no monotone function of the sum of sizes, but a sum larger by 100 + percent allows more.
        """
        return max(self.differ(size, s) for s in range(max(low, high - 99 - self.p), high + 1))

    def largest(self, r: int) -> int:
        return 100 * r // self.p

    def smallest(self, s: int) -> int:
        return -(-self.p * s // 100)

    def fits(self, r, s):
        """Whether sizes allow a link; for numbers, arrays and columns."""
        return (100 * r >= self.p * s) & (100 * s >= self.p * r)


def band(size: int) -> int:
    """Bands of sizes above SMALL, each four times the one before."""
    k, top = 0, 4 * (SMALL + 1)
    while size >= top:
        k, top = k + 1, 4 * top
    return k


def bottom(k: int) -> int:
    return (SMALL + 1) * 4**k


def allocations(size: int, t: Threshold) -> list[tuple[int, int, int]]:
    """(band, segments, H) under which a set of this size is indexed; band -1 and -2 are those of small sets, where H is no matter."""
    out = []
    if size <= t.largest(5):
        out.append((-1, 1, 0))
    if size > 5 and t.smallest(size) <= SMALL:
        out.append((-2, (t.differ(SMALL, t.largest(SMALL)) + 2) // 2, 0))
    if size > SMALL:
        k = band(size)
        out.append((k, 2 * bottom(k + 1), t.most(size, t.smallest(size), t.largest(size))))
        if k and t.smallest(size) < bottom(k):
            out.append((k - 1, 2 * bottom(k), t.most(size, t.smallest(size), bottom(k) - 1)))
    return out


class Hot:
    """Common shingles and how many documents hold them, at most."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(x), np.int64)
        at = np.searchsorted(self.tokens, x)
        at[at == len(self.tokens)] = 0
        return np.where(self.tokens[at] == x, self.counts[at], 0)


def entries_of(x: np.ndarray, t: Threshold, hot: Hot, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set and the number of pieces that each is dealt in."""
    sigs, pieces = [], []
    cost = None
    with np.errstate(over="ignore"):
        scrambled = mixed(x)
        for k, segments, most in allocations(len(x), t):
            salt = np.uint64((k + 3) << 40)
            seg = (x >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
            first = np.nonzero(np.diff(seg, prepend=np.uint64(1 << 63)))[0]
            if k < 0:
                for s in range(segments):
                    own = scrambled[seg == s]
                    value = mixed(np.append(own.sum() - own, own.sum()) + salt + np.uint64(s))  # each one-deletion, and the whole
                    sigs.append(np.unique(value))
                    pieces.append(np.ones(len(sigs[-1]), np.int64))
                continue
            cost = hot.of(x) if cost is None else cost
            value = mixed(np.add.reduceat(scrambled, first) + salt + seg[first])
            price = np.minimum.reduceat(cost, first)
            rank = (np.ceil(np.log2(price + 1.0)).astype(np.uint64) << np.uint64(58)) | (value >> np.uint64(6))
            n = min(most + 1, len(first))
            best = np.argpartition(rank, n - 1)[:n]
            sigs.append(value[best])
            pieces.append(1 + price[best] // piece)
            if len(first) <= most:  # all segments may differ: such sets meet under one entry
                sigs.append(mixed(np.array([salt ^ _M])))
                pieces.append(np.ones(1, np.int64))
    return np.concatenate(sigs) if sigs else np.zeros(0, np.uint64), np.concatenate(pieces) if pieces else np.zeros(0, np.int64)


def common_in(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of at least ``least`` of the sets, and of how many."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat.sort()
    tokens = np.unique(flat[: len(flat) - least + 1][flat[least - 1 :] == flat[: len(flat) - least + 1]]) if len(flat) >= least else flat[:0]
    return tokens, (np.searchsorted(flat, tokens, "right") - np.searchsorted(flat, tokens, "left")).astype(np.int32)


def profiles(docs: DataFrame, width: int, least: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls, check (another number of the class) and sketch of each document, and each batch's common shingles on one of its rows.

    Shingles of at least ``least`` different sets of a batch, of about two million shingles, are counted; every
    batch of every task adds its counts. So one that is common overall is found
    by the batches where it is, and the more data there are, the rarer a shingle
    may be that some batch still holds often enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        ids, hashes, sets, held = [], [], [], 0

        def counted() -> pa.RecordBatch:
            m, classes = len(sets), [class_of(s, seed) for s in sets]
            tokens, n = common_in(list({c: s for c, s in zip(classes, sets)}.values()), least)
            hot, hot_n = [tokens.view(np.int64)] + [None] * (m - 1), [n] + [None] * (m - 1)
            arrays = [
                pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array([class_of(s, seed + 1) for s in sets], pa.int64()), pa.array(map(sketch_of, sets), pa.binary()),
                pa.array(hot[:m], pa.list_(pa.int64())), pa.array(hot_n[:m], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PROFILE.split(", ")])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids += part.column(0).to_pylist()
                hashes += part.column(1).to_pylist()
                new = shingles.sets(part.column(2).to_pylist())
                sets += new
                held += sum(map(len, new))
                if held >= 2_000_000 or len(ids) >= 50_000:
                    yield counted()
                    ids, hashes, sets, held = [], [], [], 0
        if ids:
            yield counted()

    return map_arrow(_texts(docs), run, PROFILE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def common_shingles(profile: DataFrame, most: int) -> Hot:
    """The ``most`` commonest counted shingles, 12 bytes each on the driver and executors."""
    each = profile.filter("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("h")).select(F.col("h.hot").alias("token"), F.col("h.hot_n").alias("n"))
    rows = each.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).toPandas()
    return Hot(rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def index(docs: DataFrame, width: int, t: Threshold, hot: Hot, piece: int, seed: int) -> DataFrame:
    """Index entries of all sets; a task gives those of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(width), set()

        def rows(found: list) -> pa.RecordBatch:
            sig, salt = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            n = [len(f[0]) for f in found]
            cls, size = np.repeat(np.array([f[2] for f in found], np.int64), n), np.repeat(np.array([f[3] for f in found], np.int32), n)
            # entries that very many sets share are dealt in pieces by the set's class
            salt = np.where(salt > 1, cls.view(np.uint64) % salt.astype(np.uint64) + np.uint64(1), 0)
            return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(size), pa.array(cls)], names=[x.split()[0] for x in ENTRIES.split(", ")])

        found, held = [], 0
        for b in batches:
            for x in (x for i in range(0, b.num_rows, 1000) for x in shingles.sets(b.column(0).slice(i, 1000).to_pylist())):
                cls = class_of(x, seed)
                if not len(x) or cls in seen:
                    continue
                if len(seen) > 250_000:
                    seen.clear()
                seen.add(cls)
                found.append((*entries_of(x, t, hot, piece), cls, len(x)))
                held += len(found[-1][0])
                if held > 200_000:
                    yield rows(found)
                    found, held = [], 0
        if found:
            yield rows(found)

    return map_arrow(docs.select(F.col("text").cast("string")), run, ENTRIES)


def meet(entries: DataFrame, t: Threshold) -> DataFrame:
    """The sets of entries that several share: ``key`` stands for an entry, and is the same for entries of the same sets; n is its sets, 0 where an entry was dealt in pieces."""
    parted = entries.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(sig, salt, size, cls) -> pa.RecordBatch:
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])
            sig, salt, size, cls = sig[new], salt[new], size[new], cls[new]  # equal sets of several tasks
            at = np.nonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]))[0]
            n = np.diff(at, append=len(sig))
            low, high = np.minimum.reduceat(size, at).astype(np.int64), np.maximum.reduceat(size, at).astype(np.int64)
            with np.errstate(over="ignore"):
                same = np.add.reduceat(mixed(cls.view(np.uint64)), at).view(np.int64)
            wanted = (salt[at] > 0) | (n > 2) | ((n == 2) & t.fits(low, high))
            key, n_sets = np.where(salt[at] > 0, sig[at], same), np.where(salt[at] > 0, 0, n)
            kept = np.repeat(wanted, n)
            out = np.stack([np.repeat(key, n)[kept], np.repeat(n_sets, n)[kept], cls[kept], size[kept].astype(np.int64)])
            out = np.unique(out, axis=1) if out.shape[1] else out  # entries of the same sets
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2]), pa.array(out[3].astype(np.int32))], names=[x.split()[0] for x in FOUND.split(", ")])

        kept = [np.zeros(0, k) for k in (np.int64, np.int32, np.int32, np.int64)]
        for b in batches:
            now = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, b.columns)]
            if not len(now[0]):
                continue
            last = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0  # the last entry may go on in the next batch
            if cut:
                yield rows(*[x[:cut] for x in now])
            kept = [x[cut:] for x in now]
        if len(kept[0]):
            yield rows(*kept)

    return map_arrow(parted, run, FOUND)


class Forest:
    """Union of numbered things; ``edges`` are those that joined any."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        new, first = np.unique(self.label[others], return_index=True)
        for k, j in zip(new.tolist(), others[first].tolist()):
            if k != self.label[i]:
                self.edges.append((i, j))
                self.label[self.label == k] = self.label[i]


def blocked(rows: DataFrame, keys: list[str], blocks, columns: list[str]) -> DataFrame:
    """``rows`` of each key dealt in ``blocks`` by their class, and each two blocks (low, high) together as neighbours; ``side`` tells them apart."""
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), *columns)
    place = [*keys, "low", "high"]
    return dealt.repartition(*place).sortWithinPartitions(*place, "side")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of neighbouring rows with equal ``keys``, as many as a batch completes."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        now = pa.concat_tables([kept, now]).combine_chunks() if kept is not None else now
        columns = [now.column(k).to_numpy() for k in keys]
        last = np.nonzero(np.logical_or.reduce([k != k[-1] for k in columns]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield now.slice(0, cut)
        kept = now.slice(cut)
    if kept is not None:
        yield kept


def group_edges(x: pa.Table, keys: list[str]) -> list[int]:
    columns = [x.column(k).to_numpy() for k in keys]
    return [0, *(np.nonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in columns]))[0] + 1).tolist(), x.num_rows]


def possible(size: np.ndarray, side: np.ndarray, sketch: list[bytes], t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that neither sizes nor sketches rule out, of one block's sets (one ``side``) or of two blocks' (sides 0 and 1)."""
    if len(size) == 2:
        r, s = size.tolist()
        return [(0, 1)] if t.fits(r, s) and sketches_differ(*sketch) <= t.differ(r, s) else []
    forest, length, one_side = Forest(len(size)), np.array([len(k) for k in sketch]), side.min() == side.max()
    packed = {int(n): (np.nonzero(length == n)[0], np.frombuffer(b"".join(k for k in sketch if len(k) == n), np.uint8).reshape(-1, n)) for n in np.unique(length)}
    for n, (at, bits) in packed.items():
        # sizes that can be linked have sketches of equal length or of half of it
        others = [(at, bits)]
        if 2 * n in packed:
            at2, bits2 = packed[2 * n]
            others.append((at2, bits2[:, :n] ^ bits2[:, n:]))
        for at2, bits2 in others:
            for i, row in zip(at.tolist(), bits):
                r, s = int(size[i]), size[at2].astype(np.int64)
                new = (forest.label[at2] != forest.label[i]) & t.fits(r, s)
                if not one_side:
                    new &= side[at2] != side[i]
                near = np.nonzero(new)[0]
                if len(near):
                    most = r + s[near] - 2 * (-(-t.p * (r + s[near]) // (100 + t.p)))
                    forest.join(i, at2[near[np.bitwise_count(bits2[near] ^ row).sum(1, dtype=np.int64) <= most]])
    return forest.edges


def families(found: DataFrame, sketches: DataFrame, t: Threshold, block: int) -> DataFrame:
    """member, root: the components of sets that share an entry and aren't ruled out there by size or sketch.

    An entry of more than ``block`` sets is dealt in blocks, and each two of its
    blocks meet in a task of their own, so that neither memory nor work of a task
    grows with the entry.
    """
    met = found.groupBy("key", "n", "cls").agg(F.min("size").alias("size"))
    dealt = met.filter("n = 0").drop("n")
    counted = dealt.join(dealt.groupBy("key").agg(F.count("*").cast("int").alias("n")).filter("n > 1"), "key").select("key", "n", "cls", "size")
    rows = met.filter("n > 0").unionByName(counted).join(sketches.select("cls", "sketch"), "cls")
    keys = ["key", "n", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in groups_of(batches, keys):
            cls, size, side, sketch = x.column("cls").to_numpy(), x.column("size").to_numpy(), x.column("side").to_numpy(), x.column("sketch").to_pylist()
            edges, pairs = group_edges(x, keys), []
            for i, j in zip(edges, edges[1:]):
                pairs += [(i + a, i + b) for a, b in possible(size[i:j], side[i:j], sketch[i:j], t)] if j - i > 1 else []
            at = np.array(pairs, np.int64).reshape(-1, 2)
            ends = np.sort(cls[at], axis=1)
            ends = np.unique(ends, axis=0) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    near = map_arrow(blocked(rows, ["key", "n"], F.ceil(F.col("n") / block).cast("int"), ["cls", "size", "sketch"]), run, "a long, b long")
    return components(near, "families")


def exact_links(sets: list[np.ndarray], side: np.ndarray, t: Threshold, every: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among one block's sets (one ``side``), or between two blocks', and with ``every`` each set's number of links.

    Elements that several sets hold are columns: of a bit matrix where that is
    small, else of lists of holders.
    """
    m, one_side = len(sets), side.min() == side.max()
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, holders = flat[order], owner[order]
    first = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    held = np.diff(first, append=len(flat))
    several = held > 1
    holders, held = holders[np.repeat(several, held)], held[several]
    column = np.repeat(np.arange(len(held), dtype=np.int32), held)
    del flat, owner, order, first
    forest, n_links = Forest(m), np.zeros(m, np.int64)
    dense = m * len(held) <= 1 << 25
    if dense:
        bits = np.zeros((m, -(-len(held) // 64) * 64), bool)
        bits[holders, column] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
    else:
        starts = np.cumsum(held) - held
        by_set = np.argsort(holders, kind="stable")
        mine, ends = column[by_set], np.searchsorted(holders[by_set], np.arange(m + 1))
        del by_set
    for i in range(m):
        others = np.arange(i + 1, m) if one_side else np.nonzero(side != side[i])[0] if side[i] == 0 else np.zeros(0, np.int64)
        others = others[t.fits(size[i], size[others]) & (every | (forest.label[others] != forest.label[i]))]
        if not len(others):
            continue
        if dense:
            both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
        else:
            own = mine[ends[i] : ends[i + 1]]
            n = held[own]
            places = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holders[places], minlength=m)[others]
        linked = others[100 * both >= t.p * (size[i] + size[others] - both)]
        n_links[i] += len(linked)
        n_links[linked] += 1
        if len(linked):
            forest.join(i, linked)
    return forest.edges, n_links


def links_of(family: DataFrame, classes: DataFrame, docs: DataFrame, width: int, t: Threshold, block_shingles: int, broadcast_rows: int, every: bool) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links within each of two families' blocks, and with ``every`` rows (cls, n) that add up to each class's links.

    A class's set is made from one of its texts, once; a family whose sets hold more
    than ``block_shingles`` elements is dealt in blocks, each two of which meet in a task.
    """
    members = family.unionByName(family.select(F.col("root").alias("member"), "root")).distinct()
    named = materialise(members.withColumnRenamed("member", "cls").join(classes, "cls").select("cls", F.col("root").alias("family"), "n_shingles", F.col("one.doc_id").alias("w_id"), F.col("one.text_hash").alias("w_hash")), "members")
    totals = named.groupBy("family").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("family_blocks"))
    wanted = named.join(totals, "family")
    # checked: at most so many rows of a few numbers go to every executor, else both sides are dealt by key
    side = F.broadcast(wanted) if named.count() <= broadcast_rows else wanted
    texts = _texts(docs)
    held = texts.join(side, texts["doc_id"].eqNullSafe(side["w_id"]) & (texts["text_hash"] == side["w_hash"])).select("family", "family_blocks", "cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                found = [x.tobytes() for x in shingles.sets(some.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(found, pa.binary())], names=["family", "family_blocks", "cls", "elements"])

    rows = map_arrow(held, sets, "family long, family_blocks int, cls long, elements binary")
    keys = ["family", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in groups_of(batches, keys):
            all_cls, all_sides, elements = x.column("cls").to_numpy(), x.column("side").to_numpy(), x.column("elements")
            edges = group_edges(x, keys)
            a, b, cls, n = [], [], [], []
            for i, j in zip(edges, edges[1:]):
                # rows that repeat an id and text give a class twice
                at = i + np.unique(all_cls[i:j], return_index=True)[1]
                side, own = all_sides[at], all_cls[at]
                if len(at) < 2 or (x.column("low")[i].as_py() != x.column("high")[i].as_py() and side.min() == side.max()):
                    continue
                tree, n_links = exact_links([np.frombuffer(elements[k].as_buffer(), np.uint64) for k in at.tolist()], side, t, every)
                a += [int(own[p]) for p, _ in tree]
                b += [int(own[q]) for _, q in tree]
                if every:
                    cls += own[n_links > 0].tolist()
                    n += n_links[n_links > 0].tolist()
            columns = [pa.array([*v, *[None] * k] if v is a or v is b else [*[None] * k, *v], pa.int64()) for v, k in ((a, len(cls)), (b, len(cls)), (cls, len(a)), (n, len(a)))]
            yield pa.RecordBatch.from_arrays(columns, names=[y.split()[0] for y in LINKS.split(", ")])

    return materialise(map_arrow(blocked(rows, ["family"], F.col("family_blocks"), ["cls", "elements"]), run, LINKS), "links")


def numbered(docs: DataFrame, width: int, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Profiles, their classes (cls, n_shingles, sketch, one: a row that has it, and least: its smallest doc_id), and the seed of the classes' numbers."""
    for seed in range(0, 20, 2):
        profile = materialise(profiles(docs, width, least, seed), "profiles")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
        known = profile.filter("n_shingles > 0").groupBy("cls").agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), one, F.min("doc_id").alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        known = materialise(known, "classes")
        if known.filter("c0 <> c1").isEmpty():
            return profile, known.drop("c0", "c1"), seed
    raise ValueError("different sets share their number under every seed")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, least_common: int = 3, hot_most: int = 1_000_000, piece: int = 1024, block: int = 2048, block_shingles: int = 2_000_000, broadcast_rows: int = 500_000, every_link: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root (a number of the component's own, null for an empty set) and n_links per row of ``docs(doc_id, text)``.

    ``least_common`` and ``hot_most`` set which shingles count as common, which changes
    cost but never the result; entries are dealt in pieces of about ``piece`` sets, and
    compared in blocks of about ``block`` sets, families in blocks of about ``block_shingles`` elements.

    With ``every_link`` n_links is the exact number of other sets linked with the row's, and
    every two sets of a family are compared; else it is null, and sets already joined
    in a block are not compared again.
    """
    t = Threshold(percent)
    profile, classes, seed = numbered(docs, width, least_common)
    hot = common_shingles(profile, hot_most)
    found = materialise(meet(index(docs, width, t, hot, piece, seed), t), "met")
    links = links_of(families(found, classes, t, block), classes, docs, width, t, block_shingles, broadcast_rows, every_link)
    roots = components(links.filter("a is not null").select("a", "b")).withColumnRenamed("member", "cls")

    # only classes with links have a root to look up
    tops = roots.select(F.col("root").alias("cls"), "root").distinct()
    rooted = roots.unionByName(tops).join(classes.select("cls", "least"), "cls")
    counts = links.filter("cls is not null").groupBy("cls").agg(F.sum("n").alias("n_links"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").join(counts, "cls", "left").select("cls", "root", "component", "n_links")
    known = classes.select("cls", "least").join(named, "cls", "left").select("cls", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    n_links = F.col("n_links") if every_link else F.lit(None).cast("long").alias("n_links")
    filled = profile.filter("n_shingles > 0").join(known, "cls").select("doc_id", "text_hash", "n_shingles", "component_id", "root", n_links)
    none = F.lit(0 if every_link else None).cast("long").alias("n_links")
    empty = profile.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), none)
    return filled.unionByName(empty)


def one_of_each(docs: DataFrame, found: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one row of each component of ``found``: that with the smallest doc_id, then text hash. Rows with the empty set all stay."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    found = materialise(found, "found")
    kept = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("kept"), F.sum(F.lit(1)).alias("n")).filter("n > 1")
    several = found.join(kept, "root")
    gone = materialise(several.filter(key != F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct(), "gone")
    left = without(docs, gone, broadcast_rows)
    repeated = several.filter(key == F.col("kept")).groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        # rows that repeat both id and text: only those meet, one stays
        again = repeated.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
        same, rows = F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_hash") == F.col("g_hash")), keyed(left)
        left = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["k_id", "k_hash"])).select("row.*")
    return left
