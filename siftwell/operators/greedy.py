"""Greedy selections, one Arrow group per batch.

A batch (an episode, a policy run) is the unit of parallelism: its candidates,
after gates and caps, fit one task, and selection keeps one running vector per
candidate, never a matrix of all pairs. What depends on the large reference
(distances to the support) is computed before by distributed joins and arrives
as a column.

Rows are ``(batch, id, v, quality, ...)``; results carry rank from 1 and the
value that won. Equal values go to the smaller id unless ``last_id`` is set.
"""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window

RESULT = "batch long, id long, rank int, value double"


def _unit(v) -> np.ndarray:
    x = np.array(list(v), float).reshape(len(v), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _grouped(rows: DataFrame, columns: list[str], pick) -> DataFrame:
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        order, values = pick(pdf)
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "id": pdf["id"].to_numpy()[order], "rank": np.arange(1, len(order) + 1, dtype=np.int32), "value": np.array(values, float)})

    return rows.select("batch", "id", *columns).groupBy("batch").applyInPandas(each, RESULT)


def _argmax(keys: tuple[np.ndarray, ...], allowed: np.ndarray, last_id: bool) -> int:
    """The allowed row with the largest keys; ids ascend with places."""
    at = np.nonzero(allowed)[0]
    for k in keys:
        best = k[at].max()
        at = at[k[at] == best]
    return int(at[-1] if last_id else at[0])


def mmr(rows: DataFrame, weight: float = 0.25) -> DataFrame:
    """All rows by score less ``weight`` times the largest cosine to those chosen so far, which may be negative."""

    def pick(pdf):
        x, score = _unit(pdf["v"]), pdf["score"].to_numpy(float)
        near, left, order, values = np.zeros(len(x)), np.ones(len(x), bool), [], []
        while left.any():
            value = score - weight * near
            i = _argmax((value,), left, False)
            order.append(i), values.append(value[i])
            left[i] = False
            near = x @ x[i] if len(order) == 1 else np.maximum(near, x @ x[i])
        return order, values

    return _grouped(rows, ["v", "score"], pick)


def cluster_capped(rows: DataFrame, schedule: list[tuple[int, int]], weight: float = 0.25, bonus: float = 0.25, min_quality: float = 0.0) -> DataFrame:
    """By score, a bonus for clusters not seen, and a penalty for redundancy (at least 0), under a schedule of caps.

    ``schedule`` holds (top_k, most) with growing top_k: within the first top_k
    ranks a cluster has at most so many rows, and rows below ``min_quality`` wait.
    Where none is left that may be taken, any is. An empty schedule is plain
    cluster-aware selection.
    """
    if any(a[0] >= b[0] for a, b in zip(schedule, schedule[1:])) or any(k < 1 or m < 1 for k, m in schedule):
        raise ValueError("a schedule's top_k must grow, and caps be positive")

    def pick(pdf):
        x, score, cluster, quality = _unit(pdf["v"]), pdf["score"].to_numpy(float), pdf["cluster"].to_numpy(), pdf["quality"].to_numpy(float)
        kinds, code = np.unique(cluster, return_inverse=True)
        taken = np.zeros(len(kinds), int)
        near, left, order, values = np.zeros(len(x)), np.ones(len(x), bool), [], []
        while left.any():
            value = score + bonus * (taken[code] == 0) - weight * np.maximum(near, 0)
            most = next((m for k, m in schedule if len(order) < k), None)
            allowed = left if most is None else left & (taken[code] < most) & (quality >= min_quality)
            i = _argmax((value,), allowed if allowed.any() else left, False)
            order.append(i), values.append(value[i])
            left[i] = False
            taken[code[i]] += 1
            near = np.maximum(near, x @ x[i])
        return order, values

    return _grouped(rows, ["v", "score", "cluster", "quality"], pick)


def k_center(rows: DataFrame, metric: str = "cosine", last_id: bool = False) -> DataFrame:
    """Farthest first from the support and those chosen: rows carry ``support_distance`` and ``eligible``.

    Equal distances: the higher quality, then the id. Rows that aren't eligible
    follow by quality. Without a support (infinite distances) the best quality comes first.
    """

    def pick(pdf):
        x = _unit(pdf["v"]) if metric == "cosine" else np.array(pdf["v"].tolist(), float)
        gap, quality, ok = pdf["support_distance"].to_numpy(float), pdf["quality"].to_numpy(float), pdf["eligible"].to_numpy(bool)
        left, order, values = ok.copy(), [], []
        while left.any():
            i = _argmax((gap, quality), left, last_id)
            order.append(i), values.append(gap[i])
            left[i] = False
            gap = np.minimum(gap, 1 - x @ x[i] if metric == "cosine" else np.linalg.norm(x - x[i], axis=1))
        rest = sorted(np.nonzero(~ok)[0].tolist(), key=lambda i: (-quality[i], i))
        return order + rest, values + [np.nan] * len(rest)

    return _grouped(rows, ["v", "quality", "support_distance", "eligible"], pick)


def _spread(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Scaled to 0..1 over the finite values among the rows left; constant values give 0."""
    own = x[among & np.isfinite(x)]
    if not len(own) or own.max() - own.min() <= 1e-12:
        return np.where(np.isposinf(x), 1.0, 0.0)
    return np.where(np.isposinf(x), 1.0, np.clip((x - own.min()) / (own.max() - own.min()), 0, 1))


def blended_k_center(rows: DataFrame, alpha: float = 0.5, last_id: bool = False) -> DataFrame:
    """Farthest first over two views (v, w with support_distance and support_distance_w), each scaled anew over the rows left at every step."""

    def pick(pdf):
        views = [_unit(pdf["v"]), _unit(pdf["w"])]
        gaps = [pdf["support_distance"].to_numpy(float), pdf["support_distance_w"].to_numpy(float)]
        quality, ok = pdf["quality"].to_numpy(float), pdf["eligible"].to_numpy(bool)
        left, order, values = ok.copy(), [], []
        while left.any():
            value = alpha * _spread(gaps[0], left) + (1 - alpha) * _spread(gaps[1], left)
            i = _argmax((value, quality), left, last_id)
            order.append(i), values.append(value[i])
            left[i] = False
            gaps = [np.minimum(g, 1 - x @ x[i]) for g, x in zip(gaps, views)]
        rest = sorted(np.nonzero(~ok)[0].tolist(), key=lambda i: (-quality[i], i))
        return order + rest, values + [np.nan] * len(rest)

    return _grouped(rows, ["v", "w", "quality", "support_distance", "support_distance_w", "eligible"], pick)


def _distance_quantile(x: np.ndarray, q: float, eps: float) -> float:
    """The quantile of all positive distances between unit vectors, by bisection over counts of blocks; ``eps`` where there are none."""

    def below(t: float) -> int:
        return sum(int(((d := 1 - x[at : at + 512] @ x.T) > eps).sum() - (d > max(t, eps)).sum()) for at in range(0, len(x), 512))

    total = below(np.inf)
    if not total:
        return eps
    low, high = 0.0, 2.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if below(middle) >= q * (total - 1) + 1 else (middle, high)
    return high


def cover_gap(rows: DataFrame, tau: float, eps: float = 1e-12) -> DataFrame:
    """Probabilistic cover of the candidates that the support leaves uncovered.

    A candidate whose support_distance exceeds ``tau`` demands its quality (all
    do where none is beyond). Each step takes the row whose ball of radius tau
    has the most demand not met; then the most rows, the closest on weighted
    average, the best quality, the farthest from the support, the largest id.
    Where tau is nothing the radius is the 0.2 quantile of the candidates' distances.
    """

    def pick(pdf):
        x, quality, far = _unit(pdf["v"]), pdf["quality"].to_numpy(float), pdf["support_distance"].to_numpy(float)
        known, n = np.isfinite(tau) and tau > eps, len(x)
        radius = tau if known else _distance_quantile(x, 0.2, eps)
        limit = tau if known else (np.median(far[np.isfinite(far)]) if np.isfinite(far).any() else 0.0)
        under = far > limit + eps
        under = under if under.any() else np.ones(n, bool)
        demand = np.where(under, quality, 0.0)
        weight = np.maximum(demand, eps)
        far = np.where(np.isfinite(far), far, 0.0)
        # who is in whose ball, by blocks of rows: lists, never a matrix of all pairs
        centre_of, member, apart = [], [], []
        for at in range(0, n, 512):
            d = 1 - x[at : at + 512] @ x.T
            i, j = np.nonzero((d <= radius) & under[None, :])
            centre_of.append(i + at), member.append(j), apart.append(d[i, j])
        i, j, d = (np.concatenate(k) if k else np.zeros(0, int) for k in (centre_of, member, apart))
        by_member = np.argsort(j, kind="stable")
        own, held = np.searchsorted(i, np.arange(n + 1)), np.searchsorted(j[by_member], np.arange(n + 1))
        sums = lambda w: np.bincount(i, w, minlength=n) if len(i) else np.zeros(n)
        gain, count, total, pull = sums(demand[j]), sums(np.ones(len(j))).astype(int), sums(weight[j]), sums(weight[j] * d)
        open_, left, order, values = under.copy(), np.ones(n, bool), [], []
        while left.any():
            some = count > 0
            close = np.where(some, -pull / np.maximum(total, eps), -np.inf)
            gain = np.where(some, gain, 0.0)
            best = _argmax((np.round(gain, 9), count, np.round(close, 9), quality, far), left, True)
            order.append(best), values.append(gain[best])
            left[best] = False
            for k in j[own[best] : own[best + 1]].tolist():
                if open_[k]:  # met: it drops out of every ball that it is in
                    open_[k] = False
                    at = by_member[held[k] : held[k + 1]]
                    gain[i[at]] -= demand[k]
                    count[i[at]] -= 1
                    total[i[at]] -= weight[k]
                    pull[i[at]] -= weight[k] * d[at]
        return order, values

    return _grouped(rows, ["v", "quality", "support_distance"], pick)


def _with_targets(rows: DataFrame, targets: DataFrame, pick, columns: tuple[str, ...] = ()) -> DataFrame:
    """Candidates and targets ``(batch, id, v, before)`` of a batch meet in one group; ``pick(left, before, distances)``, where ``distances(places)`` works out rows to all targets when they are asked for."""

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"batch": [], "id": [], "rank": [], "value": []})
        left, right = left.sort_values("id").reset_index(drop=True), right.sort_values("id").reset_index(drop=True)
        x, y = _unit(left["v"]), _unit(right["v"]) if len(right) else None
        order, values = pick(left, right["before"].to_numpy(float), lambda at: 1 - x[at] @ y.T if y is not None else np.zeros((len(at), 0)))
        return pd.DataFrame({"batch": left["batch"].iloc[0], "id": left["id"].to_numpy()[order], "rank": np.arange(1, len(order) + 1, dtype=np.int32), "value": np.array(values, float)})

    return rows.select("batch", "id", "v", "quality", *columns).groupBy("batch").cogroup(targets.select("batch", "id", "v", "before").groupBy("batch")).applyInPandas(each, RESULT)


def _relative(before: np.ndarray, after: np.ndarray) -> float:
    return float(before.mean() - np.minimum(before, after).mean()) / max(float(before.mean()), 1e-12) if len(before) else 0.0


def lazy_greedy(left: pd.DataFrame, before: np.ndarray, distances, k: int, digits: int):
    """Places, falls and what is left at each step of the greedy order by the fall of the targets' mean, then quality, then place.

    ``left`` has quality and gain, the fall of each row alone. A fall only shrinks as others are chosen, so a row is
    measured anew when it comes first, and one whose fall is nothing (to ``digits``) never; memory is that of a few rows' distances.
    """
    quality, fall, now, seen = left["quality"].to_numpy(float), left["gain"].to_numpy(float).copy(), before, np.zeros(len(left), int)
    key = lambda i: (-round(float(fall[i]), digits), -quality[i], i)
    heap = [key(i) for i in range(len(left))]
    heapq.heapify(heap)
    for step in range(min(k, len(left))):
        old = lambda: heap and heap[0][0] != 0 and seen[heap[0][2]] != step  # noqa: E731, B023
        while old():
            again = []
            while len(again) < 16 and old():
                again.append(heapq.heappop(heap)[2])
            fall[again], seen[again] = np.maximum(now[None, :] - distances(again), 0).mean(1), step
            for i in again:
                heapq.heappush(heap, key(i))
        i = heapq.heappop(heap)[2]
        now = np.minimum(now, distances([i])[0])
        yield i, float(fall[i]), now


def oracle_greedy(rows: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k rows that each time bring the targets' mean distance down most; for evaluation only, since it sees the targets."""

    def pick(left, before, distances):
        steps = list((i, _relative(before, now)) for i, _, now in lazy_greedy(left, before, distances, k, 15))
        return [i for i, _ in steps], [value for _, value in steps]

    return _with_targets(rows.join(alone_gains(rows, targets).select("batch", "id", "gain"), ["batch", "id"]), targets, pick, ("gain",))


def oracle_exact(rows: DataFrame, targets: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """The best set of k rows by trying every one; an error where there are more than ``most`` sets."""

    def pick(left, before, distances):
        from math import comb

        n = min(k, len(left))
        if comb(len(left), n) > most:
            raise ValueError(f"{comb(len(left), n)} sets are more than {most}")
        few = {i: d for i, d in enumerate(distances(range(len(left))))} if len(left) * len(before) <= 1 << 24 else None
        after = lambda c: np.minimum.reduce([few[i] if few else distances([i])[0] for i in c]) if n else before
        best = max(combinations(range(len(left)), n), key=lambda c: (_relative(before, after(c)), [-i for i in c]))
        return list(best), [_relative(before, after(best))] * n

    return _with_targets(rows, targets, pick)


def acquisition_rounds(clips: DataFrame, rounds: int, per_round: int, order) -> DataFrame:
    """Rows (batch, round, id) of a loop in which what is chosen joins the support.

    ``clips`` has batch, id, v, quality and role (support or candidate);
    ``order(candidates, support)`` ranks a round's candidates. A round is written
    before the next, so its plan doesn't grow.
    """
    from pyspark.sql import functions as F

    from ..storage import materialise

    chosen = None
    for n in range(1, rounds + 1):
        now = clips
        if chosen is not None:
            now = clips.join(chosen.select("batch", "id", F.lit(1).alias("__in")), ["batch", "id"], "left").withColumn("role", F.when(F.col("__in") == 1, "support").otherwise(F.col("role"))).drop("__in")
        ranks = order(now.filter("role = 'candidate'"), now.filter("role = 'support'"))
        picked = materialise(ranks.filter(F.col("rank") <= per_round).select("batch", F.lit(n).alias("round"), "id"), "round")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen


def prefix_then_fill(rows: DataFrame, top_k: int, parent: str, child: str, parent_cap: int, fill_top_k: int, child_cap: int, weight: float = 0.25) -> DataFrame:
    """batch, id, rank, stage: the first ``top_k`` of a selection capped by parent clusters, then the rest in the order of one capped by child clusters."""
    from pyspark.sql import functions as F

    from .ranking import ranked

    capped = lambda cluster, k, cap: cluster_capped(rows.withColumn("cluster", F.col(cluster)), [(k, cap)], weight, 0.0)
    first = capped(parent, top_k, parent_cap).filter(F.col("rank") <= top_k).select("batch", "id", F.col("rank").alias("__at"), F.lit("prefix").alias("stage"))
    fill = capped(child, fill_top_k, child_cap).select("batch", "id", F.col("rank").alias("__at")).join(first.select("batch", "id"), ["batch", "id"], "left_anti").withColumn("stage", F.lit("fill"))
    return ranked(first.unionByName(fill), F.desc("stage"), F.asc("__at"), by=["batch"]).select("batch", "id", "rank", "stage")


def learned_k_center(rows: DataFrame, k: int, score: str, spread: float = 1.5) -> DataFrame:
    """batch, id, rank: farthest first among the ceil(``spread`` * k) best eligible rows by a learned score, then the other eligible ones, then the rest, by score.

    Equal distances go to the higher score, equal scores to the higher quality, then to the smaller id.
    """
    from math import ceil

    from pyspark.sql import functions as F

    from .ranking import ranked

    placed = ranked(rows, F.desc("eligible"), F.desc(score), F.desc("quality"), F.asc("id"), by=["batch"], name="__place")
    pool = F.col("eligible") & (F.col("__place") <= max(k, ceil(max(1.0, spread) * k)))
    picked = k_center(placed.filter(pool).withColumn("quality", F.col(score))).select("batch", "id", F.col("rank").alias("__at"))
    both = placed.select("batch", "id", "__place").join(picked, ["batch", "id"], "left")
    return ranked(both, F.asc_nulls_last("__at"), F.asc("__place"), by=["batch"]).select("batch", "id", "rank")


def target_families(rows: DataFrame, known: DataFrame, wanted: DataFrame, budget: int) -> DataFrame:
    """batch, id, rank, value: a greedy cover of the targets' labels, for evaluation only; value is the share of them known after the pick.

    ``rows`` has batch, id, quality, label; ``known`` and ``wanted`` are the labels (batch, label) of support and
    targets. A pick adds one label at most and all weigh alike, so the greedy order is one of windows: the best row of
    each label that is new comes first, by quality, then all others; equal ones by the larger id. Rows beyond the
    budget follow in id order with value 0.
    """
    from pyspark.sql import functions as F

    from .ranking import ranked

    new = wanted.distinct().join(known.distinct(), ["batch", "label"], "left_anti").withColumn("__new", F.lit(True))
    sizes = wanted.distinct().groupBy("batch").agg(F.count("*").alias("__all"))
    have = wanted.distinct().join(known.distinct(), ["batch", "label"], "left_semi").groupBy("batch").agg(F.count("*").alias("__have"))
    own = rows.select("batch", "id", "quality", "label").join(new, ["batch", "label"], "left").na.fill({"__new": False})
    own = ranked(own, F.desc("quality"), F.desc("id"), by=["batch", "label"], name="__nth").withColumn("__first", F.col("__new") & (F.col("__nth") == 1))
    out = ranked(own, F.desc("__first"), F.desc("quality"), F.desc("id"), by=["batch"], name="__at")
    out = out.join(sizes, "batch", "left").join(have, "batch", "left").na.fill({"__have": 0, "__all": 0})
    found = F.col("__have") + F.sum(F.col("__first").cast("int")).over(Window.partitionBy("batch").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("__at") <= budget, F.coalesce(F.try_divide(found, F.col("__all")), F.lit(0.0))).otherwise(0.0)
    late = F.when(F.col("__at") <= budget, F.col("__at")).otherwise(F.lit(budget))
    return ranked(out.withColumn("value", value).withColumn("__late", late), F.asc("__late"), F.when(F.col("__at") > budget, F.col("id")).asc_nulls_first(), by=["batch"]).select("batch", "id", "rank", "value")


def alone_gains(rows: DataFrame, targets: DataFrame, block: int = 2048) -> DataFrame:
    """batch, id, gain, relative_gain of adding each row alone: the fall of the targets' mean nearest distance, and that over the former mean. Chunks of rows meet chunks of targets, and only a sum for each row goes on."""
    from pyspark.sql import functions as F

    from ..storage import materialise
    from .neighbors import chunk_pairs, unit_rows

    def falls(batch: int, left: list, right: list, same: bool) -> pa.Table:
        out = []
        for _, m, _ in left if right else []:
            x, fall = unit_rows(m), np.zeros(len(m))
            for _, y, before in right:
                y = unit_rows(y).T
                for at in range(0, len(x), 512):
                    fall[at : at + 512] += np.maximum(before[None, :] - (1 - x[at : at + 512] @ y), 0).sum(1)
            out.append(fall)
        ids = np.concatenate([b[0] for b in left]) if out else np.zeros(0, np.int64)
        return pa.table({"batch": pa.array(np.full(len(ids), batch, np.int64)), "id": pa.array(ids), "fall": pa.array(np.concatenate(out) if out else np.zeros(0))})

    fall = chunk_pairs(rows.select("batch", "id", "v"), targets.select("batch", "id", "v", "before"), falls, "batch long, id long, fall double", block).groupBy("batch", "id").agg(F.sum("fall").alias("fall"))
    means = targets.groupBy("batch").agg(F.count("*").alias("n"), F.avg("before").alias("mean"))
    each = rows.select("batch", "id").join(fall, ["batch", "id"], "left").join(means, "batch", "left").withColumn("gain", F.coalesce(F.col("fall") / F.col("n"), F.lit(0.0)))
    return materialise(each.select("batch", "id", "gain", (F.col("gain") / F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-12))).alias("relative_gain")), "gains")


def oracle_screen(rows: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``rows`` of each batch less all but the ``cap`` that gain most alone, then by quality and id."""
    from pyspark.sql import functions as F

    from .ranking import ranked

    gains = alone_gains(rows, targets)
    return ranked(rows.join(gains, ["batch", "id"]), F.desc("relative_gain"), F.desc("quality"), F.asc("id"), by=["batch"]).filter(F.col("rank") <= cap)
