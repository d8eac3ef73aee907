"""Evaluation episodes: which groups are support, candidates and targets.

An episode table is long: episode_id, group, role. Groups are few next to clips,
so episodes are planned on a table of groups and joined to clips afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, stable_random, unit
from .ranking import ranked


def _episodes(groups: DataFrame, n: int) -> DataFrame:
    return groups.withColumn("episode_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def source_blocked(groups: DataFrame, episodes: int, targets: int, candidates: int) -> DataFrame:
    """Groups in order, turned by ``targets`` places for each episode: the first are targets, the next candidates, the rest support."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    placed = ranked(groups.select("group"), F.asc("group"), name="place").withColumn("n", n)
    at = F.pmod(F.col("place") - 1 - F.col("episode_id") * targets, F.col("n"))
    role = F.when(at < targets, "target").when(at < targets + candidates, "candidate").otherwise("support")
    return _episodes(placed, episodes).select("episode_id", "group", role.alias("role"))


def group_distances(centroids: DataFrame) -> DataFrame:
    """a, b, d for every two different groups of ``(group, v)``: 1 - cosine, at least 0. Made for tables of groups, not of clips."""
    x = centroids.select(F.col("group").alias("a"), unit(F.col("v")).alias("x"))
    y = centroids.select(F.col("group").alias("b"), unit(F.col("v")).alias("y"))
    return x.join(y, F.col("a") != F.col("b")).select("a", "b", F.greatest(1 - dot(F.col("x"), F.col("y")), F.lit(0.0)).alias("d"))


def isolation_order(distances: DataFrame) -> DataFrame:
    """group, isolation (mean distance to the others) and its rank, most isolated first."""
    return ranked(distances.groupBy(F.col("a").alias("group")).agg(F.avg("d").alias("isolation")), F.desc("isolation"), F.asc("group"))


def difficulty_targeted(centroids: DataFrame, episodes: int, candidates: int, far_half: bool = False) -> DataFrame:
    """One most isolated target an episode; its nearest groups are candidates, the others support.

    With ``far_half`` half the candidates are the nearest and half the farthest.
    """
    d = group_distances(centroids)
    target = isolation_order(d).filter(F.col("rank") <= episodes).select((F.col("rank") - 1).alias("episode_id"), F.col("group").alias("target"))
    near = d.join(target, d["a"] == target["target"])
    near = ranked(near, F.asc("d"), F.asc("b"), by=["episode_id"], name="near")
    near = ranked(near, F.desc("d"), F.asc("b"), by=["episode_id"], name="far")
    half = (candidates + 1) // 2
    chosen: Column = (F.col("near") <= half) | (F.col("far") <= candidates - half) if far_half else F.col("near") <= candidates
    others = near.select("episode_id", F.col("b").alias("group"), F.when(chosen, "candidate").otherwise("support").alias("role"))
    return others.unionByName(target.select("episode_id", F.col("target").alias("group"), F.lit("target").alias("role")))


def family_shift(groups: DataFrame, bridges: int = 0) -> DataFrame:
    """An episode for each family of ``(group, family)``: it is the target, and no support.

    ``bridges`` of its groups, first by name, stay candidates beside groups of
    other families; other groups alternate between support and candidates.
    """
    families = ranked(groups.select("family").distinct(), F.asc("family"), name="episode_id").select((F.col("episode_id") - 1).alias("episode_id"), F.col("family").alias("held"))
    each = groups.join(families, F.lit(True))  # families are few; every group takes part in every episode
    own = F.col("family") == F.col("held")
    nth = F.row_number().over(Window.partitionBy("episode_id", own).orderBy("group"))
    role = F.when(own & (nth <= bridges), "candidate").when(own, "target").when(F.pmod(nth, F.lit(2)) == 0, "candidate").otherwise("support")
    return each.select("episode_id", "group", role.alias("role"))


def random_episodes(groups: DataFrame, episodes: int, targets: int, candidates: int, seed: str = "0") -> DataFrame:
    """Roles by a reproducible draw for each episode and group."""
    drawn = ranked(_episodes(groups.select("group"), episodes).withColumn("draw", stable_random(F.lit(seed), F.col("episode_id"), F.col("group"))), F.asc("draw"), F.asc("group"), by=["episode_id"], name="place")
    role = F.when(F.col("place") <= targets, "target").when(F.col("place") <= targets + candidates, "candidate").otherwise("support")
    return drawn.select("episode_id", "group", role.alias("role"))


def check_episodes(members: DataFrame) -> DataFrame:
    """A row for each fault of ``(episode_id, group, role)``: a group in two roles, or a role without groups."""
    twice = members.groupBy("episode_id", "group").agg(F.countDistinct("role").alias("n")).filter("n > 1").select("episode_id", F.concat(F.lit("group in several roles: "), F.col("group").cast("string")).alias("fault"))
    roles = F.array(*map(F.lit, ("support", "candidate", "target")))
    lacking = members.groupBy("episode_id").agg(F.array_except(roles, F.collect_set("role")).alias("none")).select("episode_id", F.explode("none").alias("r")).select("episode_id", F.concat(F.lit("no groups: "), F.col("r")).alias("fault"))
    return twice.unionByName(lacking)


def leave_group_out(groups: DataFrame) -> DataFrame:
    """fold, group, side: each group held out in the fold of its name."""
    folds = groups.select(F.col("group").alias("fold"))
    return groups.select("group").join(folds, F.lit(True)).select("fold", "group", F.when(F.col("fold") == F.col("group"), "heldout").otherwise("train").alias("side"))
