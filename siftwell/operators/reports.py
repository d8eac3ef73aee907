"""Evaluations and reports over rankings and facts: deltas, stability, packs, contrasts, pseudo-evaluations and memos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import bootstrap_interval, paired_deltas
from .neighbors import knn_by_batch, knn_without_group
from .ranking import ranked


def rank_deltas(current: DataFrame, shadow: DataFrame, ks: list[int]) -> DataFrame:
    """One row on the rows in both rankings: n, mean and largest change of rank, the share of each first k that stays."""
    both = current.select("id", F.col("rank").alias("a")).join(shadow.select("id", F.col("rank").alias("b")), "id")
    gap = F.abs(F.col("a") - F.col("b"))
    kept = [(F.sum(((F.col("a") <= k) & (F.col("b") <= k)).cast("int")) / F.greatest(F.sum((F.col("a") <= k).cast("int")), F.lit(1))).alias(f"overlap_{k}") for k in ks]
    return both.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_change"), F.max(gap).alias("largest_change"), *kept)


def rank_stability(rankings: DataFrame, ks: list[int]) -> DataFrame:
    """run_a, run_b, n, spearman and overlap_k of every two runs of ``(run, id, rank)``; ranks have no ties. Runs are few; rows meet by id."""
    a, b = (rankings.select(F.col("run").alias(f"run_{s}"), "id", F.col("rank").alias(s)) for s in "ab")
    both = a.join(b, "id").filter(F.col("run_a") < F.col("run_b"))
    kept = [(F.sum(((F.col("a") <= k) & (F.col("b") <= k)).cast("int")) / k).alias(f"overlap_{k}") for k in ks]
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.corr("a", "b").alias("spearman"), *kept)


def novelty_by_run(runs: DataFrame, candidates: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """run, id, novelty, rank: candidates ranked in each of ``runs(run)`` by the mean distance to the k nearest of that run's ``support(run, id, v)``."""
    each = candidates.select("id", "v").join(F.broadcast(runs.select(F.col("run").alias("batch"))), F.lit(True))
    near = knn_by_batch(each, support.select(F.col("run").alias("batch"), "id", "v"), k)
    out = near.groupBy(F.col("batch").alias("run"), F.col("query_id").alias("id")).agg(F.avg("distance").alias("novelty"))
    return ranked(out, F.desc("novelty"), F.asc("id"), by=["run"])


def novelty_without_group(runs: DataFrame, candidates: DataFrame, support: DataFrame, group: str, k: int) -> DataFrame:
    """run, id, novelty, rank: as ``novelty_by_run`` where a run's support is that of all groups but ``run``; each candidate meets each support row once, not once for each run. Runs are few."""
    near = knn_without_group(candidates, support, group, k)
    known = support.select(F.col(group).cast("long").alias("run")).distinct().withColumn("batch", F.col("run"))
    of = F.broadcast(runs.select("run").join(known, "run", "left").withColumnRenamed("batch", "__b"))
    out = near.join(of, F.col("batch").eqNullSafe(F.col("__b")))
    out = out.filter(F.size("distances") > 0).select("run", F.col("query_id").alias("id"), (F.aggregate("distances", F.lit(0.0), lambda a, x: a + x) / F.size("distances")).alias("novelty"))
    return ranked(out, F.desc("novelty"), F.asc("id"), by=["run"])


def audit_packs(rows: DataFrame, k: int) -> DataFrame:
    """``rows(id, rank, base_rank, failed)`` in packs to look at: the first k, the k after them, and the k best of those that failed and left the first k."""
    top, after = F.col("rank") <= k, (F.col("rank") > k) & (F.col("rank") <= 2 * k)
    pushed = F.col("failed") & (F.col("base_rank") <= k) & ~top
    packs = F.array_compact(F.array(F.when(top, F.lit("top")), F.when(after, F.lit("boundary")), F.when(pushed, F.lit("pushed_out"))))
    return rows.withColumn("pack", F.explode(packs))


def pack_summary(packs: DataFrame, flags: Column) -> DataFrame:
    """pack, flag, n, share: how many of a pack carry each flag, an array column."""
    sizes = packs.groupBy("pack").agg(F.count("*").alias("of"))
    each = packs.withColumn("flag", F.explode(flags)).groupBy("pack", "flag").agg(F.count("*").alias("n"))
    return each.join(sizes, "pack").select("pack", "flag", "n", (F.col("n") / F.col("of")).alias("share"))


def selection_effect(rows: DataFrame, policy: str, a: str, b: str, by: list[str], k: int) -> DataFrame:
    """Per row of ``by``: how many of the first k of one policy another leaves out, and whether the two are the same (a gate that changes nothing)."""
    top = rows.filter(F.col("rank") <= k)
    x, y = (top.filter(F.col(policy) == p).select(*by, "id").withColumn(f"__{s}", F.lit(1)) for p, s in ((a, "a"), (b, "b")))
    both = x.join(y, [*by, "id"], "full")
    left = F.sum((F.col("__a").isNotNull() & F.col("__b").isNull()).cast("int"))
    new = F.sum((F.col("__a").isNull() & F.col("__b").isNotNull()).cast("int"))
    return both.groupBy(*by).agg(left.alias("left_out"), new.alias("brought_in")).withColumn("no_op", F.col("left_out") + F.col("brought_in") == 0)


def selection_contrasts(selected: DataFrame, pool: DataFrame, features: list[str]) -> DataFrame:
    """feature, selected_mean, pool_mean, contrast: the difference of means in the pool's deviations (0 where there is none)."""

    def means(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("e")).select("e.*")
        return each.groupBy("feature").agg(F.avg("x").alias(f"{name}_mean"), F.stddev_pop("x").alias(f"__{name}"))

    both = means(selected, "selected").join(means(pool, "pool"), "feature")
    return both.select("feature", "selected_mean", "pool_mean", F.when(F.col("__pool") > 1e-12, (F.col("selected_mean") - F.col("pool_mean")) / F.col("__pool")).otherwise(0.0).alias("contrast"))


def regime_mix(selected: DataFrame, pool: DataFrame, regime: str) -> DataFrame:
    """regime, selected_share, pool_share, lift: each regime's share among the selected and in the pool."""
    n_s, n_p = (F.sum(x).over(Window.partitionBy(F.lit(0))) for x in ("s", "p"))
    counts = pool.groupBy(regime).agg(F.count("*").alias("p")).join(selected.groupBy(regime).agg(F.count("*").alias("s")), regime, "left").na.fill({"s": 0})
    shares = counts.withColumn("selected_share", F.col("s") / n_s).withColumn("pool_share", F.col("p") / n_p)  # a row for each regime: few
    return shares.select(F.col(regime).alias("regime"), "selected_share", "pool_share", (F.col("selected_share") / F.col("pool_share")).alias("lift"))


def validation_report(facts: DataFrame, policy: str, value: str, episode: str, baseline: str, replicates: int = 200) -> DataFrame:
    """Each policy's mean with its resampled interval, and its paired difference to a baseline."""
    interval = bootstrap_interval(facts, [policy], episode, value, replicates)
    paired = paired_deltas(facts, policy, value, [episode], baseline).drop("n")
    return interval.join(paired, policy, "left")


def memo(gates: DataFrame) -> DataFrame:
    """One row: a line for each gate with its status, in the order of their names, and a verdict before them."""
    lines = F.array_sort(F.collect_list(F.concat(F.col("gate"), F.lit(": "), F.col("status"))))
    failed = F.sum((F.col("status") == "fail").cast("int"))
    claim = F.when(failed == 0, "claims supported").otherwise(F.concat(failed.cast("string"), F.lit(" gates failed")))
    return gates.agg(F.concat_ws("\n", claim, F.concat_ws("\n", lines)).alias("text"))


def candidate_roles(rows: DataFrame, known_groups: DataFrame, low_quality: float, similarity: float) -> DataFrame:
    """``rows(id, group_id, quality, nearest_similarity)`` with role: low_quality, else near_duplicate, else known_like where the support has the group, else heldout_novel."""
    known = known_groups.select("group_id").distinct().withColumn("__known", F.lit(True))
    role = F.when(F.col("quality") < low_quality, "low_quality").when(F.col("nearest_similarity") >= similarity, "near_duplicate").when(F.col("__known"), "known_like").otherwise("heldout_novel")
    return rows.join(known, "group_id", "left").withColumn("role", role).drop("__known")


def family_label_holdout(groups: DataFrame, episodes: int, targets: int, bridges: int, decoys: int) -> DataFrame:
    """episode_id, group, role of ``groups(group, family)``: an episode for each of the first families with more than ``targets`` groups.

    Of the family's groups the first are targets, the next candidates (bridges), the others take no part; of the
    other families' groups the first are candidates (decoys), the rest support.
    """
    sizes = groups.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") > targets)
    held = ranked(sizes, F.asc("family"), name="e").filter(F.col("e") <= episodes).select((F.col("e") - 1).alias("episode_id"), F.col("family").alias("held"))
    each = groups.join(F.broadcast(held), F.lit(True)).withColumn("own", F.col("family") == F.col("held"))  # at most ``episodes`` rows
    nth = F.row_number().over(Window.partitionBy("episode_id", "own").orderBy("group"))
    role = F.when(F.col("own") & (nth <= targets), "target").when(F.col("own") & (nth <= targets + bridges), "candidate").when(F.col("own"), "unused").when(nth <= decoys, "candidate").otherwise("support")
    return each.withColumn("role", role).filter("role <> 'unused'").select("episode_id", "group", "role")


def token_support(vectors: DataFrame, near: DataFrame) -> DataFrame:
    """id, top5, top10, centroid_similarity of ``vectors(id, v)`` and their neighbours (query_id, rank, distance)."""
    from ..functions.numeric import dot, unit

    tops = near.groupBy(F.col("query_id").alias("id")).agg(*[F.avg(F.when(F.col("rank") <= k, 1 - F.col("distance"))).alias(f"top{k}") for k in (5, 10)])
    mean = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # one row
    out = vectors.join(F.broadcast(mean), F.lit(True)).select("id", dot(unit(F.col("v")), unit(F.col("m"))).alias("centroid_similarity"))
    return tops.join(out, "id")


def masked_pool(windows: DataFrame, valid: Column) -> DataFrame:
    """clip, v: mean, maximum and deviation of each dimension over the valid windows of ``(clip, window_idx, f)``, end to end; a clip without any has none."""
    each = windows.filter(valid).select("clip", F.posexplode("f").alias("dim", "x"))
    stats = each.groupBy("clip", "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("top"), F.stddev_pop("x").alias("std"))
    parts = stats.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "top", "std"))).alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name])
    return parts.select("clip", F.concat(pick("mean"), pick("top"), pick("std")).alias("v"))
