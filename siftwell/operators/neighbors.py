"""Exact nearest neighbours and what is made of them: novelty, density, tau, coverage.

Vectors are packed into blocks, a row each, and blocks into chunks; every chunk of queries
meets every chunk of the reference in a group of its own. A group works through strips of the
product and lets out the k best rows per query, so memory is that of two chunks and a strip, whatever
the sizes. Chunks grow with the tables up to a limit, so that what is shuffled grows with the rows, not the pairs,
until that limit. Nothing is collected or broadcast. What is found is written once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, unit
from ..storage import materialise

PAIRS = "query_id long, ref_id long, distance double"
KEYED = "batch long, " + PAIRS


#: Blocks of a chunk at most, cells of a strip, and pairs of chunks aimed at.
_CHUNK, _STRIP, _PAIRS = 8, 1 << 21, 256


def _blocks(rows: DataFrame, size: int, blocks: DataFrame, name: str) -> DataFrame:
    """batch, block, ids, what rows carry in ``before`` (if there) and a matrix for every ``size`` rows or so of each batch of (batch, id, v); ``blocks`` has each batch's number of them under ``name``."""
    more = "before" in rows.columns

    def pack(t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").to_pylist(), dtype=np.float64)
        one = {k: pa.array([t.column(k)[0].as_py()], kind) for k, kind in (("batch", pa.int64()), ("block", pa.int32()))}
        before = np.array(t.column("before").to_pylist() if more else [], dtype=np.float64)
        return pa.table({**one, "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "dim": pa.array([v.shape[1]], pa.int32()), "m": pa.array([v.tobytes()], pa.binary()), "before": pa.array([before.tobytes()], pa.binary())})

    dealt = rows.join(blocks.select("batch", F.col(name).alias("__blocks")), "batch").withColumn("block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).drop("__blocks")
    return dealt.groupBy("batch", "block").applyInArrow(pack, "batch long, block int, ids array<long>, dim int, m binary, before binary")


def chunk_pairs(left: DataFrame, right: DataFrame, each, schema: str, block: int = 2048, ordered: bool = False) -> DataFrame:
    """``each(batch, x, y, same)`` over every chunk of ``left(batch, id, v)`` with every one of ``right`` of its batch; ``ordered``: of equal tables, each pair of chunks once.

    x and y are lists of blocks (ids, matrix, before), the last from a column of that name; ``same`` tells that both are one chunk. ``each`` gives a pa.Table.
    """
    count = lambda rows, name: rows.groupBy("batch").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    n = count(left, "l_blocks").join(count(right, "r_blocks"), "batch")
    chunk = F.least(F.greatest(F.floor(F.sqrt(F.col("l_blocks").cast("double") * F.col("r_blocks") / _PAIRS)), F.lit(1)), F.lit(_CHUNK)).cast("int")
    n = n.withColumn("chunk", chunk)
    met = None
    for rows, own, other, at, to, side in ((left, "l_blocks", "r_blocks", "l", "r", 0), (right, "r_blocks", "l_blocks", "r", "l", 1)):
        packed = _blocks(rows.select("batch", "id", "v", *[c for c in rows.columns if c == "before"]), block, n, own).join(n, "batch")
        packed = packed.withColumn(at, F.floor(F.col("block") / F.col("chunk")).cast("int")).withColumn(to, F.explode(F.sequence(F.lit(0), F.floor((F.col(other) - 1) / F.col("chunk")).cast("int"))))
        packed = packed.select("batch", "l", "r", F.lit(side).alias("side"), "ids", "dim", "m", "before")
        met = packed if met is None else met.unionByName(packed)
    if ordered:
        met = met.filter(F.col("l") <= F.col("r"))

    def run(t: pa.Table) -> pa.Table:
        sides = ([], [])
        for i in range(t.num_rows):
            ids, dim, m, before = (t.column(c)[i] for c in ("ids", "dim", "m", "before"))
            sides[t.column("side")[i].as_py()].append((ids.values.to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(m.as_buffer()).reshape(-1, dim.as_py()), np.frombuffer(before.as_buffer())))
        return each(t.column("batch")[0].as_py(), *sides, t.column("l")[0].as_py() == t.column("r")[0].as_py())

    # a part for each pair of chunks or so: what is read is small beside the work on it
    return met.groupBy("batch", "l", "r").applyInArrow(run, schema)


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k smallest values in order, the first of equal ones first; every row has more than k, none NaN."""
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    keep = d <= kth
    tied = np.nonzero(keep.sum(1) > k)[0]
    if len(tied):
        for at in range(0, len(tied), 64):
            own = tied[at : at + 64]
            less, equal = d[own] < kth[own], d[own] == kth[own]
            keep[own] = less | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= (k - less.sum(1))[:, None]))
    places = np.nonzero(keep)[1].reshape(len(d), k)
    return np.take_along_axis(places, np.argsort(np.take_along_axis(d, places, axis=1), axis=1, kind="stable"), axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def joined(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    """ids and matrix of a chunk's blocks, by id."""
    ids = np.concatenate([b[0] for b in blocks])
    order = np.argsort(ids, kind="stable")
    return ids[order], np.concatenate([b[1] for b in blocks])[order]


def knn_join(queries: DataFrame, reference: DataFrame, k: int, metric: str = "cosine", leave_self_out: bool = False, block: int = 2048) -> DataFrame:
    """query_id, ref_id, distance, rank of the ``k`` nearest of ``reference(id, v)`` to each of ``queries(id, v)``.

    ``metric``: cosine (1 - cosine, lengths at least 1e-12) or euclidean. Equal
    distances: the smaller id first. ``leave_self_out`` leaves out equal ids.
    """
    one = lambda rows: rows.select(F.lit(0).cast("long").alias("batch"), "id", "v")
    return knn_by_batch(one(queries), one(reference), k, metric, leave_self_out, block).drop("batch")


def knn_by_batch(queries: DataFrame, reference: DataFrame, k: int, metric: str = "cosine", leave_self_out: bool = False, block: int = 2048) -> DataFrame:
    """As ``knn_join`` within each batch of rows ``(batch, id, v)``, all batches at once."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no such metric: {metric}")

    def best(batch: int, left: list, right: list, same: bool) -> pa.Table:
        out = []
        if left and right:
            ids, y = joined(right)
            finite = bool(np.isfinite(y).all())
            y = unit_rows(y) if metric == "cosine" else y
            square = (y**2).sum(1)
            rows = max(1, _STRIP // len(y))
            for own, m, _ in left:
                for at in range(0, len(own), rows):
                    x, q = m[at : at + rows], own[at : at + rows]
                    if metric == "cosine":
                        x = unit_rows(x)
                        d = 1.0 - x @ y.T
                    else:
                        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + square[None, :] - 2 * x @ y.T, 0))
                    if not finite or not np.isfinite(x).all():
                        d[np.isnan(d)] = np.inf
                    if leave_self_out:
                        place = np.minimum(np.searchsorted(ids, q), len(ids) - 1)
                        for step in range(len(ids)):  # equal ids are neighbours
                            j = np.minimum(place + step, len(ids) - 1)
                            own_at = np.nonzero((ids[j] == q) & (place + step < len(ids)))[0]
                            if not len(own_at):
                                break
                            d[own_at, j[own_at]] = np.inf
                    top = _smallest(d, k) if d.shape[1] > k else np.argsort(d, axis=1, kind="stable")
                    dist = np.take_along_axis(d, top, axis=1)
                    good = np.isfinite(dist)
                    out.append((np.repeat(q, top.shape[1])[good.ravel()], ids[top][good], dist[good]))
        q, r, d = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))
        return pa.table({"batch": pa.array(np.full(len(q), batch, np.int64)), "query_id": pa.array(q), "ref_id": pa.array(r), "distance": pa.array(d)})

    pairs = chunk_pairs(queries, reference, best, KEYED, block)
    order = Window.partitionBy("batch", "query_id").orderBy("distance", "ref_id")
    return materialise(pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "near")


def knn_of_copies(rows: DataFrame, k: int, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """As ``knn_join`` of ``rows`` with themselves less equal ids, where many rows share a vector: each vector is searched once.

    The k + 1 nearest rows of a vector, itself among them, are within the k + 1 nearest vectors, of each the k + 1 smallest ids.
    """
    kinds = materialise(rows.groupBy("v").agg(F.min("id").alias("id")), "kinds")
    placed = materialise(rows.select("id", "v").join(kinds.withColumnRenamed("id", "kind"), "v").select("id", "kind"), "placed")
    first = placed.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("nth") <= k + 1).select(F.col("kind").alias("ref_kind"), F.col("id").alias("ref_id"))
    near = knn_join(kinds, kinds, k + 1, metric, block=block).select(F.col("query_id").alias("kind"), F.col("ref_id").alias("ref_kind"), "distance").join(first, "ref_kind")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("distance", "ref_id"))).filter(F.col("nth") <= k + 1).drop("nth", "ref_kind")
    each = placed.withColumnRenamed("id", "query_id").join(near, "kind").filter("query_id <> ref_id").drop("kind")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id"))).filter(F.col("rank") <= k).select("query_id", "ref_id", "distance", "rank")


def knn_without_group(queries: DataFrame, reference: DataFrame, group: str, k: int, block: int = 2048) -> DataFrame:
    """batch, query_id, distances: for each ``group`` of ``reference(id, v, group)`` the ascending distances of the k nearest that aren't of that group; batch null: of all.

    Each pair meets once, within its group; what is left out of the groups' k nearest costs no further pairs.
    """
    groups = reference.select(F.col(group).cast("long").alias("batch")).distinct()
    each = queries.select("id", "v").crossJoin(groups)
    near = knn_by_batch(each, reference.select(F.col(group).cast("long").alias("batch"), "id", "v"), k, block=block)
    lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "ref_id", "batch"))).alias("all"))
    runs = lists.withColumn("batch", F.explode(F.array_append(F.array_distinct(F.transform("all", lambda x: x["batch"])), F.lit(None).cast("long"))))
    kept = F.slice(F.when(F.col("batch").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: x["batch"] != F.col("batch"))), 1, k)
    return runs.select("batch", "query_id", F.transform(kept, lambda x: x["distance"]).alias("distances"))


def cosine_pairs(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """The same distances as expressions, for pairs that a condition on a.* and b.* allows; for small or keyed sides."""
    x = a.select(F.col("id").alias("query_id"), unit(F.col("v")).alias("qv"), *[c for c in a.columns if c not in ("id", "v")])
    y = b.select(F.col("id").alias("ref_id"), unit(F.col("v")).alias("rv"), *[F.col(c).alias(f"ref_{c}") for c in b.columns if c not in ("id", "v")])
    return x.join(y, on).withColumn("distance", 1 - dot(F.col("qv"), F.col("rv"))).drop("qv", "rv")


def support_features(neighbours: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50, 100)) -> DataFrame:
    """Mean and population deviation of the first k distances, for each k that has any rows."""
    aggs = []
    for k in ks:
        d = F.when(F.col("rank") <= k, F.col("distance"))
        aggs += [F.avg(d).alias(f"mean_{k}"), F.stddev_pop(d).alias(f"std_{k}")]
    return neighbours.groupBy("query_id").agg(*aggs)


def novelty(queries: DataFrame, reference: DataFrame, k: int = 10) -> DataFrame:
    """id, novelty: the mean distance to the k nearest of the reference."""
    return knn_join(queries, reference, k).groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("novelty"))


def density(batch: DataFrame, k: int = 10) -> DataFrame:
    """id, density: the mean positive similarity to the k nearest others; 0 for a batch of one."""
    near = knn_join(batch, batch, k, leave_self_out=True).groupBy(F.col("query_id").alias("id")).agg(F.avg(F.greatest(1 - F.col("distance"), F.lit(0.0))).alias("density"))
    return batch.select("id").join(near, "id", "left").na.fill({"density": 0.0})


def nearest_distance(queries: DataFrame, reference: DataFrame, metric: str = "cosine") -> DataFrame:
    """id, distance to the nearest; infinite where the reference is empty."""
    near = knn_join(queries, reference, 1, metric).select(F.col("query_id").alias("id"), "distance")
    return queries.select("id").join(near, "id", "left").na.fill({"distance": float("inf")})


def support_tau(support: DataFrame, quantile: float = 0.9, metric: str = "cosine") -> DataFrame:
    """One row: the quantile of each vector's distance to its nearest other."""
    near = knn_join(support, support, 1, metric, leave_self_out=True)
    return near.agg(F.percentile("distance", F.lit(quantile)).alias("tau"))


def coverage(targets: DataFrame, before: DataFrame, added: DataFrame, tau: float | None = None, eps: float = 1e-12) -> DataFrame:
    """One row of coverage gains of ``added`` over ``before`` for ``targets``.

    gain: fall of the mean nearest distance; relative_gain: that over the former
    mean; mean_relative_gain: the mean of each target's clipped relative fall;
    covered_before and covered_after: shares within ``tau``; tail_gain: the fall
    of the 0.9 quantile.
    """
    old = nearest_distance(targets, before).withColumnRenamed("distance", "old")
    new = nearest_distance(targets, added).withColumnRenamed("distance", "new")
    both = old.join(new, "id").withColumn("after", F.least("old", "new"))
    within = (lambda c: F.avg((F.col(c) <= tau).cast("double"))) if tau is not None else (lambda c: F.lit(None).cast("double"))
    return both.agg(
        F.avg("old").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg(F.col("old") - F.col("after")).alias("gain"),
        (F.avg(F.col("old") - F.col("after")) / F.greatest(F.avg("old"), F.lit(eps))).alias("relative_gain"),
        F.avg(F.greatest((F.col("old") - F.col("after")) / F.greatest("old", F.lit(eps)), F.lit(0.0))).alias("mean_relative_gain"),
        within("old").alias("covered_before"), within("after").alias("covered_after"),
        (F.percentile("old", F.lit(0.9)) - F.percentile("after", F.lit(0.9))).alias("tail_gain"),
    )
