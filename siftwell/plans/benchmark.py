"""The offline benchmark: episodes, policies and budgets to coverage facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import episodes, greedy, neighbors, ranking
from ..storage import materialise

#: Builders of orders by name: each takes an episode's eligible candidates (batch, id, v, quality, novelty, support_distance, score, cluster, eligible) and returns batch, id, rank.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "quality_only": lambda c: ranking.quality_order(c, ["batch"]),
    "old_novelty_only": lambda c: ranking.ranked(c, F.desc("novelty"), F.asc("id"), by=["batch"]),
    "random_valid": lambda c: ranking.random_order(c, "random", by=["batch"]),
    "quality_stratified_random": lambda c: ranking.stratified_random_order(c, "stratified", 50, ["batch"]),
    "kcenter_quality_gated": lambda c: greedy.k_center(c),
    "kcenter_benchmark": lambda c: greedy.k_center(c, last_id=True),
    "kcenter_euclidean": lambda c: greedy.k_center(c, "euclidean"),
    "old_novelty_quality_gated": lambda c: ranking.gated_order(c, F.col("eligible"), ["batch"]),
    "quality_then_novelty": lambda c: ranking.quality_novelty_order(c, ["batch"]),
    "source_capped_novelty": lambda c: ranking.capped_order(ranking.gated_order(c, F.col("eligible"), ["batch"]), "cluster", 2, F.col("passed"), ["batch"]),
    "artifact_gated_novelty": lambda c: ranking.passed_first(ranking.gated_order(c, F.col("eligible"), ["batch"]), F.col("artifact") <= 0.05, ["batch"]),
    "score": lambda c: ranking.score_order(c, ["batch"]),
    "mmr": lambda c: greedy.mmr(c),
    "cluster_aware": lambda c: greedy.cluster_capped(c, []),
    "cluster_cap": lambda c: greedy.cluster_capped(c, [(100, 2)]),
    "tiered_cluster_cap": lambda c: greedy.cluster_capped(c, [(25, 1), (100, 2)]),
    "learned_score_kcenter": lambda c: greedy.learned_k_center(c, 100, "score"),
}


def policy(name: str) -> Callable[[DataFrame], DataFrame]:
    """The builder of a policy; random_valid_replay_N is a random order of its own for each N."""
    if name.startswith("random_valid_replay_"):
        return lambda c: ranking.random_order(c, name, by=["batch"])
    if name not in POLICIES:
        raise ValueError(f"no such policy: {name}; known: {sorted(POLICIES)}")
    return POLICIES[name]


def run(clips: DataFrame, members: DataFrame, policies: list[str], budgets: list[int], gate) -> DataFrame:
    """episode_id, policy, budget, n_selected, underfilled, mean_before, mean_after, relative_gain.

    ``clips`` has id, group, v, quality, score, cluster and what ``gate`` reads; ``members``
    is an episode table. All episodes run at once, each a batch; a policy ranks an episode
    once, and budgets are prefixes. Candidates that fail the gate are dropped, not put last. Targets
    meet the chosen rows alone: an episode's targets and at most the largest budget for each policy in a task.
    """
    faults = episodes.check_episodes(members).count()
    if faults:
        raise ValueError(f"{faults} faults in the episodes")
    placed = materialise(clips.join(members, "group").withColumnRenamed("episode_id", "batch").withColumn("batch", F.col("batch").cast("long")), "placed")
    support, pool, targets = (placed.filter(F.col("role") == r) for r in ("support", "candidate", "target"))
    pool = pool.filter(gate)
    near = neighbors.knn_by_batch(pool, support, 10)
    dist = near.groupBy("batch", F.col("query_id").alias("id")).agg(F.avg("distance").alias("novelty"), F.min("distance").alias("support_distance"))
    pool = materialise(pool.join(dist, ["batch", "id"]).withColumn("eligible", F.lit(True)), "pool")
    before = neighbors.knn_by_batch(targets, support, 1).select("batch", F.col("query_id").alias("id"), F.col("distance").alias("before"))
    orders = reduce(lambda a, b: a.unionByName(b), [policy(name)(pool).filter(F.col("rank") <= max(budgets)).select("batch", "id", "rank", F.lit(name).alias("policy")) for name in policies])
    chosen = orders.join(pool.select("batch", "id", "v"), ["batch", "id"])
    sizes = sorted(budgets)

    def measured(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A row for each policy and budget: sums over targets of what the prefix leaves and of the relative fall."""
        out = []
        if len(left) and len(right):
            unit = lambda v: (x := np.array(v.tolist(), float)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            x, now = unit(right["v"]), right["before"].to_numpy(float)
            for name, own in left.sort_values("rank").groupby("policy"):
                y, after, at = unit(own["v"]), now.copy(), 0
                for size in sizes:
                    for i in range(at, min(size, len(own))):  # a running minimum over the prefix
                        after = np.minimum(after, 1 - x @ y[i])
                    at = min(size, len(own))
                    fall = np.maximum((now - after) / np.maximum(now, 1e-12), 0)
                    out.append((int(left["batch"].iloc[0]), name, size, at, at < size, now.mean(), after.mean(), fall.mean()))
        return pd.DataFrame(out, columns=["episode_id", "policy", "budget", "n_selected", "underfilled", "mean_before", "mean_after", "relative_gain"])

    both = chosen.groupBy("batch").cogroup(targets.join(before, ["batch", "id"]).select("batch", "v", "before").groupBy("batch"))
    return both.applyInPandas(measured, "episode_id long, policy string, budget int, n_selected int, underfilled boolean, mean_before double, mean_after double, relative_gain double")
