"""Clusters of vectors: similarity components, medoids, k-means and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, unit
from ..storage import materialise
from .neighbors import _STRIP, PAIRS, chunk_pairs, unit_rows
from .ranking import numbered


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a matrix of rows by columns, whose places are numbered on from the rows'."""
    n, label, out = similar.shape[0], np.arange(sum(similar.shape)), []
    for i in np.nonzero(similar.any(1))[0].tolist():
        near = np.nonzero(similar[i])[0] + n
        new, first = np.unique(label[near], return_index=True)
        for k, j in zip(new.tolist(), near[first].tolist()):
            if k != label[i]:
                out.append((i, j - n))
                label[label == k] = label[i]
    return out


def similar_pairs(rows: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """query_id < ref_id with a cosine of at least ``threshold``, by products of blocks; each pair of blocks is met once.

    Of two blocks' similar pairs a spanning forest goes on, which has the same components and at most
    as many pairs as the blocks have rows.
    """
    import pyarrow as pa

    def run(batch: int, left: list, right: list, same: bool) -> pa.Table:
        out, (left, right) = [], (sorted(s, key=lambda b: int(b[0].min())) for s in (left, right))
        for i, (p, x, _) in enumerate(left):
            x = unit_rows(x)
            for q, y, _ in right[i if same else 0 :]:
                s = x @ unit_rows(y).T
                pairs = _forest((s >= threshold) & ((p[:, None] != q[None, :]) if same else True))
                a, b = (np.array(e, int) for e in (zip(*pairs) if pairs else ((), ())))
                out.append((np.minimum(p[a], q[b]), np.maximum(p[a], q[b]), 1 - s[a, b]))
        a, b, d = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))
        return pa.table({"query_id": pa.array(a), "ref_id": pa.array(b), "distance": pa.array(d)})

    one = rows.select(F.lit(0).cast("long").alias("batch"), "id", "v")
    return chunk_pairs(one, one, run, PAIRS, block, ordered=True)


def _propagated(pairs: DataFrame) -> DataFrame:
    """id, root: the least id that similar pairs lead to, by label propagation with jumps; each round is written to shared storage."""
    edges = materialise(pairs.select(F.col("query_id").alias("a"), F.col("ref_id").alias("b")), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = materialise(step.join(jump, "root", "left").select("id", F.coalesce("further", "root").alias("root"), "old"), "labels")
        if now.filter("root <> old").isEmpty():
            return now.select("id", "root")
        labels = now.select("id", "root")


def components(rows: DataFrame, threshold: float) -> DataFrame:
    """id, cluster, cluster_size of ``rows(id, v)``: components of similarity, numbered from 0 by their least id."""
    roots = rows.select("id").join(_propagated(similar_pairs(rows, threshold)), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # roots are numbered, one row each
    heads = numbered(roots.groupBy("root").agg(F.count("*").alias("cluster_size")), F.asc("root"), name="cluster").withColumn("cluster", F.col("cluster") - 1)
    return roots.join(heads, "root").select("id", "cluster", "cluster_size")


def medoids(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Adds medoid_id, the member with the largest mean cosine to its cluster (the least id among equals), and medoid_distance.

    A mean cosine to a cluster is the product with the cluster's mean unit
    vector, so no pairs are formed.
    """
    u = rows.withColumn("__u", unit(F.col("v")))
    means = u.select(cluster, F.posexplode("__u").alias("dim", "x")).groupBy(cluster, "dim").agg(F.avg("x").alias("x"))
    means = means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("__mean"))
    scored = u.join(means, cluster).withColumn("__fit", dot(F.col("__u"), F.col("__mean")))
    best = scored.groupBy(cluster).agg(F.min(F.struct((-F.round("__fit", 12)).alias("f"), "id", "__u")).alias("m"))
    return scored.join(best.select(cluster, F.col("m.id").alias("medoid_id"), F.col("m.__u").alias("__m")), cluster).withColumn("medoid_distance", 1 - dot(F.col("__u"), F.col("__m"))).drop("__u", "__mean", "__fit", "__m")


def _farthest_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Places of k centres: the row nearest the mean, then ever the row farthest from those so far."""
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    chosen, gap = [first], ((x - x[first]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equal ones, and the squared distance to it.

    By products in strips; rows that these can't tell apart by more than rounding are measured by differences.
    """
    labels, own = np.zeros(len(x), int), np.zeros(len(x))
    squares, size = (centres**2).sum(1), max(1, _STRIP // len(centres))
    for at in range(0, len(x), size):
        y = x[at : at + size]
        d = squares[None, :] - 2 * (y @ centres.T)
        scale = (y**2).sum(1) + squares.max()
        near = d <= d.min(1, keepdims=True) + 1e-9 * scale[:, None] + 1e-300
        first = near.argmax(1)
        for i in np.nonzero(near.sum(1) > 1)[0].tolist():
            some = np.nonzero(near[i])[0]
            gaps = np.concatenate([((y[i] - centres[some[j : j + 4096]]) ** 2).sum(1) for j in range(0, len(some), 4096)])
            first[i] = some[gaps.argmin()]
        labels[at : at + size], own[at : at + size] = first, ((y - centres[first]) ** 2).sum(1)
    return labels, own


def _lloyd(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Labels of k-means from farthest-first centres; an empty cluster takes the row farthest from its centre, and one that loses its only row so keeps its centre."""
    centres, labels = _farthest_centres(x, k), np.full(len(x), -1)
    for _ in range(steps):
        new, own = _assigned(x, centres)
        size = np.bincount(new, minlength=k)
        for c in range(k):
            if not size[c]:
                far = int(own.argmax())
                size[new[far]] -= 1
                new[far], own[far], size[c] = c, ((x[far] - centres[c]) ** 2).sum(), 1
        if (new == labels).all():
            break
        labels = new
        order = np.argsort(labels, kind="stable")
        centres = np.stack([x[p].mean(0) if len(p) else centres[c] for c, p in enumerate(np.split(order, np.cumsum(size)[:-1]))])
    return labels


def _rebalanced(x: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Labels after members of clusters above ``most`` have moved, the farthest from their centre first, each to the nearest centre of a cluster with room; centres stay for a pass."""
    labels, kinds = labels.copy(), np.unique(labels)
    while True:
        size = {int(c): int((labels == c).sum()) for c in kinds}
        room = {c for c, n in size.items() if n < most}
        centre = {c: x[labels == c].mean(0) for c, n in size.items() if n}
        moved = False
        for source in [c for c, n in size.items() if n > most]:
            own = np.nonzero(labels == source)[0]
            for i in own[np.argsort(-((x[own] - centre[source]) ** 2).sum(1), kind="stable")].tolist():
                open_ = sorted(c for c in room if c != source and c in centre)
                if not open_ or size[source] <= most:
                    break
                to = min(open_, key=lambda c: (float(((x[i] - centre[c]) ** 2).sum()), c))
                labels[i], moved = to, True
                size[source], size[to] = size[source] - 1, size[to] + 1
                if size[to] >= most:
                    room.discard(to)
        if not moved:
            return labels


def split_large(rows: DataFrame, most: int = 300, target: int = 75, steps: int = 16, child_most: int | None = None, score: str | None = None) -> DataFrame:
    """``child``: cluster members numbered 0.. within clusters of more than ``most``, which are parted into ceil(n / target) by k-means; 0 elsewhere.

    With ``child_most`` parts above that size give members to parts with room; with ``score``, a column, parts are
    numbered by their best member's score, then by their smallest id. Rows are ``(id, cluster, v)``; a group
    holds one cluster, whose size the caller bounds by its threshold.
    """
    sized = rows.withColumn("__n", F.count("*").over(Window.partitionBy("cluster")))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["v"].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        child = _lloyd(x, min(len(x), -(-len(x) // target)), steps)
        if child_most is not None:
            child = _rebalanced(x, child, child_most)
        if score is not None:
            best, ids = pdf["__s"].to_numpy(float), pdf["id"].to_numpy()
            order = sorted(np.unique(child).tolist(), key=lambda c: (-best[child == c].max(), ids[child == c].min()))
            child = np.array([order.index(c) for c in child.tolist()])
        return pd.DataFrame({"id": pdf["id"], "cluster": pdf["cluster"], "child": child})

    large = sized.filter(F.col("__n") > most).select("id", "cluster", "v", (F.col(score) if score else F.lit(0.0)).cast("double").alias("__s")).groupBy("cluster").applyInPandas(each, "id long, cluster long, child long")
    return sized.filter(F.col("__n") <= most).select(F.col("id").cast("long").alias("id"), F.col("cluster").cast("long").alias("cluster"), F.lit(0).cast("long").alias("child")).unionByName(large)


def round_robin_split(rows: DataFrame, parts: int, order: list) -> DataFrame:
    """Members dealt in turn over ``parts`` children in the order given."""
    return rows.withColumn("child", F.pmod(F.row_number().over(Window.partitionBy("cluster").orderBy(*order)) - 1, F.lit(parts)))


def kmeans(rows: DataFrame, k: int, steps: int = 30, seed: str = "13") -> tuple[DataFrame, list[list[float]]]:
    """Assignments (id, code, distance) and centres of Lloyd's algorithm over ``rows(id, v)`` of any size.

    Centres start as the rows that come first by a hash of their id. The codebook, k vectors, travels
    to Arrow functions with each pass, and each batch gives back one sum for each of its codes; the rows
    are written once. An empty cluster keeps its centre; equally near centres: the first.
    """
    import pyarrow as pa

    from ..functions.numeric import stable_random

    rows = materialise(rows.select("id", "v"), "kmeans")
    centres = np.array([r["v"] for r in rows.orderBy(stable_random(F.lit(seed), F.col("id")), "id").limit(k).collect()], float)

    def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None, :], 0)
        return d.argmin(1), np.sqrt(d.min(1))

    def sums(book: np.ndarray) -> DataFrame:
        def run(batches):
            for b in batches:
                x = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
                if len(x):
                    codes = nearest(x, book)[0]
                    found = np.unique(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([int((codes == c).sum()) for c in found], pa.int64()), pa.array([x[codes == c].sum(0).tolist() for c in found], pa.list_(pa.float64()))], names=["code", "n", "s"])

        each = rows.select("v").mapInArrow(run, "code int, n long, s array<double>")
        return each.select("code", "n", F.posexplode("s").alias("dim", "x")).groupBy("code", "dim").agg((F.sum("x") / F.sum("n")).alias("x"))

    def assign(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            code, d = nearest(x, centres) if len(x) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.int32()), pa.array(d, pa.float64())], names=["id", "code", "distance"])

    for _ in range(steps):
        new = centres.copy()
        for r in sums(centres).collect():
            new[r["code"], r["dim"]] = r["x"]
        done = np.abs(new - centres).max(initial=0) < 1e-12
        centres = new
        if done:
            break
    return rows.mapInArrow(assign, f"id {rows.schema['id'].dataType.simpleString()}, code int, distance double"), centres.tolist()


def source_families(groups: DataFrame, group: str) -> DataFrame:
    """``family`` of each group name: what comes before ``::``, ``|``, ``/`` or a worker mark; the whole name where there is none."""
    name = F.col(group).cast("string")
    found = F.regexp_extract(name, r"^(.+?)(?:::|\||/|[_-]worker)", 1)
    return groups.withColumn("family", F.when(found != "", found).otherwise(name))
