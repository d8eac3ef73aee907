"""Exact top-k search by integer inner product, best first over M-trees.

Vectors become integer vectors floor(scale * x). Rows are dealt to cells by their
nearest routing vector, and a cell's rows over trees of bounded size, so that a tree
covers a part of the space. A further coordinate that gives every vector of a tree the
same length turns the largest inner product into the smallest distance. A tree is stored as
pages: a page holds its entries' vectors and distances to its routing vector
(the parent distances), and routing entries also a covering radius. The cells'
routing vectors and covering radii are the node on top.

A query first searches one tree of its home cell, which gives a bound on its k-th score;
it then goes only to trees of cells whose radius allows a score that reaches the bound.
Queries of a tree search it together: pages are taken in the order of the
least distance that any query may find there, a page's entries that the parent
distances rule out for every query are not computed, and a page is left out for the queries whose
bound it cannot reach. Scores are exact integers; bounds have slack for rounding.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors count as padded with zeros, an empty one as zero;
components whose whole number is so large that sums of products could overflow 64 bits
(beyond 2**31 / sqrt(width) * sqrt(2), far above any embedding's) count as that bound;
rows that repeat an id are rows of their own, each answered and each a candidate
of the other; a null id is no query, and comes last among ties; with fewer than
k other rows all are returned; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

PAGES = "tree long, page int, leaf boolean, count int, vectors binary, rows binary, ids binary, parent_distance binary, radius binary, child binary"
LARGEST = np.iinfo(np.int64).max  # a null id in a page
LEAST = np.iinfo(np.int64).min  # the bound of a query that hasn't k rows yet
SPREAD = 1 << 32  # trees that a cell may have


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own for each row), vec_id and v, an array of whole numbers, for the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    some = rows.filter(F.col("embedding").isNotNull() & sound)
    return some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


def _matrix(values: list, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class Builder:
    """Bulk-loads one tree: pages by nearest routing vector, split until they fit."""

    def __init__(self, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, page_size: int):
        self.v, self.rows, self.ids, self.size = v.astype(np.float64), rows, ids, page_size
        norm = (self.v**2).sum(1)
        self.lift = np.sqrt(norm.max(initial=0) - norm)
        self.pages: list[dict] = []

    def distances(self, at: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.v[at] - self.v[pivot]) ** 2).sum(1) + (self.lift[at] - self.lift[pivot]) ** 2)

    def add(self, at: np.ndarray, pivot: int) -> int:
        """The number of the page that holds the rows ``at``, whose routing vector is ``pivot``."""
        if len(at) <= self.size:
            self.pages.append({"leaf": True, "at": at, "parent": self.distances(at, pivot), "radius": np.zeros(0), "child": np.zeros(0, np.int32)})
            return len(self.pages) - 1
        n = min(self.size, -(-2 * len(at) // self.size))
        pivots = at[np.linspace(0, len(at) - 1, n).astype(int)]
        all_d = np.stack([self.distances(at, p) for p in pivots])
        home = all_d.argmin(0)
        if (home == home[0]).all():  # no routing vector parts these rows, which may all be equal
            home = np.arange(len(at)) * n // len(at)
        kept, radius, child = [], [], []
        for i, p in enumerate(pivots):
            own = home == i
            if own.any():
                kept.append(p)
                radius.append(all_d[i, own].max())
                child.append(self.add(at[own], p))
        kept_at = np.array(kept)
        self.pages.append({"leaf": False, "at": kept_at, "parent": self.distances(kept_at, pivot), "radius": np.array(radius), "child": np.array(child, np.int32)})
        return len(self.pages) - 1


def routing_vectors(vectors: DataFrame, n: int, width: int, sample_values: int = 1 << 22) -> np.ndarray:
    """At most n different vectors far from each other: farthest first among the 8 n rows that come first by a hash.

    The sample is bounded: it holds at most ``sample_values`` numbers, and n rows at least; the driver holds it, each task the n.
    """
    size = max(n, min(8 * n, sample_values // width))
    rows = vectors.orderBy(F.xxhash64("row", F.lit(1))).limit(size).select("v").collect()
    x = _matrix([r["v"] for r in rows], width)
    if not len(x):
        return x
    f = x.astype(np.float64)
    chosen, gap = [0], ((f - f[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((f - f[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def in_cells(vectors: DataFrame, routing: np.ndarray, width: int) -> DataFrame:
    """``vectors`` with ``cell``, the number of the nearest routing vector, and ``away``, the distance to it."""
    f = routing.astype(np.float64)
    norms = (f**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), width).astype(np.float64)
            if not len(x):
                continue
            d = norms[None, :] - 2 * x @ f.T
            home = d.argmin(1)
            away = np.sqrt(((x - f[home]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(away, pa.float64())], names=[*b.schema.names, "cell", "away"])

    return map_arrow(vectors, run, "row long, vec_id long, v array<long>, cell int, away double")


def build_trees(celled: DataFrame, per_tree: int = 16_384, page_size: int = 256) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """Page rows of M-trees over rows in cells, the root a tree's last page; and each cell's number, trees and covering radius."""
    top = celled.groupBy("cell").agg(F.ceil(F.count("*") / per_tree).cast("int").alias("parts"), F.max("away").alias("radius"))

    def build(group: pa.Table) -> pa.Table:
        values = group.column("v").to_pylist()
        v = _matrix(values, max(map(len, values)))
        ids = np.array([LARGEST if x is None else x for x in group.column("vec_id").to_pylist()], np.int64)
        b = Builder(v, group.column("row").to_numpy(), ids, page_size)
        order = np.argsort(ids, kind="stable")
        b.add(order, int(order[0]))
        tree = group.column("tree")[0].as_py()
        out = {
            "tree": [tree] * len(b.pages), "page": range(len(b.pages)), "leaf": [p["leaf"] for p in b.pages], "count": [len(p["at"]) for p in b.pages],
            "vectors": [np.hstack([v[p["at"]], b.lift[p["at"], None].view(np.int64)]).tobytes() for p in b.pages], "rows": [b.rows[p["at"]].tobytes() for p in b.pages], "ids": [b.ids[p["at"]].tobytes() for p in b.pages],
            "parent_distance": [p["parent"].tobytes() for p in b.pages], "radius": [p["radius"].tobytes() for p in b.pages], "child": [p["child"].tobytes() for p in b.pages],
        }
        return pa.table(out, schema=_PAGE_SCHEMA)

    # a crowded cell's rows are dealt over several trees
    dealt = celled.join(F.broadcast(top.select("cell", "parts")), "cell").withColumn("tree", F.col("cell").cast("long") * SPREAD + F.pmod(F.xxhash64("row"), F.col("parts")))
    pages = materialise(dealt.select("tree", "row", "vec_id", "v").groupBy("tree").applyInArrow(build, PAGES), "mtree")
    return pages, [(r["cell"], r["parts"], r["radius"]) for r in top.orderBy("cell").collect()]


_PAGE_SCHEMA = pa.schema(
    [("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("count", pa.int32())] + [(k, pa.binary()) for k in ("vectors", "rows", "ids", "parent_distance", "radius", "child")]
)


class Tree:
    def __init__(self, pages: list[dict]):
        self.pages = []
        for p in sorted(pages, key=lambda p: p["page"]):
            wide = np.frombuffer(p["vectors"], np.int64).reshape(p["count"], -1)
            self.pages.append({
                "leaf": p["leaf"], "v": wide[:, :-1], "f": wide[:, :-1].astype(np.float64), "lift": np.ascontiguousarray(wide[:, -1]).view(np.float64), "rows": np.frombuffer(p["rows"], np.int64),
                "ids": np.frombuffer(p["ids"], np.int64), "parent": np.frombuffer(p["parent_distance"]), "radius": np.frombuffer(p["radius"]), "child": np.frombuffer(p["child"], np.int32),
            })
        root = self.pages[-1]
        self.total = float((root["f"][0] ** 2).sum() + root["lift"][0] ** 2)  # every lifted vector's squared length
        self.computed = 0

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score of at most k rows but its own for each query, those that reach its bound; best first."""
        width = self.pages[-1]["v"].shape[1]
        q = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))[:, :width]
        f = q.astype(np.float64)
        both = (f**2).sum(1) + self.total
        slack = 1e-6 * (1 + np.sqrt(both))
        exact = float(np.abs(q).max(initial=0)) * np.sqrt(self.total) * max(1, width) < 2**52
        floor = bound.copy()  # a row must reach it to be of use
        of, ids, scores = (np.zeros(0, np.int64) for _ in range(3))

        def distance(score: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(both[rows] - 2.0 * score, 0))

        def worst(rows: np.ndarray) -> np.ndarray:
            return np.where(floor[rows] == LEAST, np.inf, distance(floor[rows].astype(np.float64), rows)) + slack[rows]

        # pages by least possible distance; with the queries they are open to, and those queries' distances to the page's routing vector
        queue: list[tuple[float, int, np.ndarray, np.ndarray | None, np.ndarray]] = [(0.0, len(self.pages) - 1, np.arange(len(q)), None, np.zeros(len(q)))]
        while queue:
            _, number, rows, to_parent, least = heapq.heappop(queue)
            page = self.pages[number]
            limit = worst(rows)
            open_ = least <= limit
            rows, limit, to_parent = rows[open_], limit[open_], None if to_parent is None else to_parent[open_]
            if not len(rows):
                continue
            reach = 0.0 if page["leaf"] else page["radius"]
            near = np.arange(len(page["rows"]))
            if to_parent is not None:
                # the triangle inequality with stored distances: an entry that no query can use is not computed
                low, high, most = to_parent.min(), to_parent.max(), limit.max()
                near = np.nonzero((page["parent"] - reach <= high + most) & (page["parent"] + reach >= low - most))[0]
                if not len(near):
                    continue
            self.computed += len(near) * len(rows)
            score = (f[rows] @ page["f"][near].T).astype(np.int64) if exact else q[rows] @ page["v"][near].T
            if page["leaf"]:
                i, j = np.nonzero((score >= floor[rows][:, None]) & (page["rows"][near][None, :] != own[rows][:, None]))
                if not len(i):
                    continue
                hit = np.unique(rows[i])
                old = np.isin(of, hit)
                o, d, x = np.concatenate([of[old], rows[i]]), np.concatenate([ids[old], page["ids"][near][j]]), np.concatenate([scores[old], score[i, j]])
                order = np.lexsort((d, -x, o))
                o, d, x = o[order], d[order], x[order]
                nth = np.arange(len(o)) - np.searchsorted(o, o)
                kept = nth < k
                last = nth == k - 1
                floor[o[last]] = np.maximum(floor[o[last]], x[last])
                of, ids, scores = np.concatenate([of[~old], o[kept]]), np.concatenate([ids[~old], d[kept]]), np.concatenate([scores[~old], x[kept]])
            else:
                to = distance(score.astype(np.float64), np.repeat(rows[:, None], len(near), 1))
                below = np.maximum(to - page["radius"][near][None, :], 0)
                for e, child in enumerate(page["child"][near].tolist()):
                    use = below[:, e] <= limit
                    if use.any():
                        heapq.heappush(queue, (float(below[use, e].min()), child, rows[use], to[use, e], below[use, e]))
        order = np.lexsort((ids, -scores, of))
        return of[order], ids[order], scores[order]


def top_k(rows: DataFrame, is_query, k: int = 20, scale: int = 64, per_tree: int = 16_384, page_size: int = 256, block: int = 4_096, most_cells: int = 4_096) -> DataFrame:
    """The k best other rows for each row of ``rows(vec_id, embedding)`` that meets ``is_query``, a condition on vec_id.

    There is a cell for about ``per_tree`` rows, at most ``most_cells``; a task searches one tree for at most about ``block`` queries.
    """
    spark = rows.sparkSession
    vectors = materialise(integer_vectors(rows, scale), "vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    largest = int((2**62 / width) ** 0.5)
    clipped = vectors.withColumn("v", F.transform("v", lambda c: F.greatest(F.least(c, F.lit(largest)), F.lit(-largest))))
    routing = routing_vectors(clipped, min(most_cells, max(1, -(-n // per_tree))), width)
    if not len(routing):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    celled = materialise(in_cells(clipped, routing, width), "cells")
    pages, cells = build_trees(celled, per_tree, page_size)
    queries = celled.filter(is_query).select("row", "vec_id", "v", "cell")
    first = _searched(pages, _to_home(queries, cells), k, block)
    first = materialise(first, "home")
    bounds = first.groupBy("query_row").agg(F.min(F.when(F.col("nth") == k, F.col("score"))).alias("bound"))
    rest = _searched(pages, _to_others(queries.join(bounds, queries["row"] == F.col("query_row"), "left"), cells, routing, width), k, block)
    found = first.unionByName(rest)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SOUGHT = "tree long, row long, vec_id long, v array<long>, bound long"


def _home_part(parts: int, row: np.ndarray) -> np.ndarray:
    return row % parts


def _to_home(queries: DataFrame, cells: list[tuple[int, int, float]]) -> DataFrame:
    """Each query with one tree of its own cell."""
    parts = {c: p for c, p, _ in cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cell = b.column("row").to_numpy(), b.column("cell").to_numpy()
            tree = cell.astype(np.int64) * SPREAD + _home_part(np.array([parts[c] for c in cell.tolist()], np.int64), row)
            yield pa.RecordBatch.from_arrays([pa.array(tree), b.column("row"), b.column("vec_id"), b.column("v"), pa.array([None] * b.num_rows, pa.int64())], names=[x.split()[0] for x in SOUGHT.split(", ")])

    return map_arrow(queries, run, SOUGHT)


def _to_others(queries: DataFrame, cells: list[tuple[int, int, float]], routing: np.ndarray, width: int) -> DataFrame:
    """Each query with every other tree of the cells that may hold a row as good as its bound: its product with the routing vector, and its length times the radius, reach it."""
    number, parts, radius = (np.array([c[i] for c in cells]) for i in range(3))
    f = routing.astype(np.float64)[number]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = _matrix(part.column("v").to_pylist(), width).astype(np.float64)
                size = np.sqrt((q**2).sum(1))[:, None]
                most = q @ f.T + size * radius[None, :]
                bound = np.array([-np.inf if x is None else float(x) for x in part.column("bound").to_pylist()])[:, None]
                i, j = np.nonzero(most >= bound - 1e-6 * (1 + size * (size + radius[None, :])))
                # every part of the cell but the one searched already
                n = parts[j]
                i, j = np.repeat(i, n), np.repeat(j, n)
                nth = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                row, cell = part.column("row").to_numpy(), part.column("cell").to_numpy()
                new = (number[j] != cell[i]) | (nth != _home_part(parts[j], row[i]))
                i, j, nth = i[new], j[new], nth[new]
                taken = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(number[j].astype(np.int64) * SPREAD + nth), *[part.column(c).take(taken) for c in ("row", "vec_id", "v", "bound")]], names=[x.split()[0] for x in SOUGHT.split(", ")])

    return map_arrow(queries.select("row", "vec_id", "v", "cell", "bound"), run, SOUGHT)


def _searched(pages: DataFrame, sought: DataFrame, k: int, block: int) -> DataFrame:
    """query_row, query_id, vec_id, score and nth of each query's best rows in the trees it is sent to.

    A tree's queries are dealt in blocks of about ``block``; its pages are copied once for each of its blocks.
    """
    sought = materialise(sought, "sought")
    blocks = sought.groupBy("tree").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of_tree = blocks.select(F.col("tree").alias("of_tree"), F.col("blocks").alias("n_blocks"))
    dealt = sought.join(of_tree, F.col("tree") == F.col("of_tree")).withColumn("block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"))

    def run(own_pages: pa.Table, own_queries: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score", "nth"]
        if not own_pages.num_rows or not own_queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        tree, values = Tree(own_pages.to_pylist()), own_queries.column("v").to_pylist()
        row = own_queries.column("row").to_numpy()
        bound = np.array([LEAST if x is None else x for x in own_queries.column("bound").to_pylist()], np.int64)
        of, ids, scores = tree.search(_matrix(values, max(map(len, values))), row, k, bound)
        nth = np.arange(len(of)) - np.searchsorted(of, of) + 1
        query_id = own_queries.column("vec_id").combine_chunks().take(pa.array(of))
        return pa.table([pa.array(row[of]), query_id, pa.array(ids, mask=ids == LARGEST), pa.array(scores), pa.array(nth)], names=names)

    return held.groupBy("tree", "block").cogroup(dealt.groupBy("tree", "block")).applyInArrow(run, "query_row long, query_id long, vec_id long, score long, nth long")
