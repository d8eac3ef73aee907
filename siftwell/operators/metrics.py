"""Ranking metrics, agreement, uncertainty and summaries.

Ranked rows have ``rank`` from 1 and, where a function says so, label, cluster,
corrupted or score; ``by`` names the columns of separate rankings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..storage import materialise
from .ranking import numbered

_TIE = 1e-12
#: Draws of a bootstrap that a task makes.
_DRAWS_A_TASK = 4_000_000


def ranking_metrics(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """precision, average_precision, ndcg, cluster_diversity and corruption_rate at ``k``.

    Precision divides by the rows there are within k. Average precision divides
    by the positives of the whole ranking, at most k. NDCG has gains of 2^label - 1.
    Diversity is distinct clusters over positives, both within k.
    """
    own = Window.partitionBy(*by)
    ideal = F.row_number().over(own.orderBy(F.desc("label"), "rank"))
    hits = F.sum((F.col("label") > 0).cast("int")).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    x = rows.withColumn("ideal", ideal).withColumn("hits", hits)
    positive, top = F.col("label") > 0, F.col("rank") <= k
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    dcg = F.sum(F.when(top, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1)).otherwise(0.0))
    found = F.sum((top & positive).cast("int"))
    return x.groupBy(*by).agg(
        F.avg(F.when(top, positive.cast("double"))).alias("precision"),
        F.coalesce(F.try_divide(F.sum(F.when(top & positive, F.col("hits") / F.col("rank")).otherwise(0.0)), F.least(F.sum(positive.cast("int")), F.lit(k))), F.lit(0.0)).alias("average_precision"),
        F.when(best > 0, dcg / best).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.try_divide(F.countDistinct(F.when(top & positive, F.col("cluster"))), found), F.lit(0.0)).alias("cluster_diversity"),
        F.avg(F.when(top, F.col("corrupted").cast("double"))).alias("corruption_rate"),
    )


def top_overlap(rows: DataFrame, policy: str, by: list[str], k: int) -> DataFrame:
    """overlap and jaccard of every two policies' first ``k`` ids, per row of ``by``. A policy's top is one array of at most k ids; two empty sets have a Jaccard of 1."""
    tops = rows.filter(F.col("rank") <= k).groupBy(*by, policy).agg(F.collect_set("id").alias("ids"))
    a, b = (tops.select(*by, F.col(policy).alias(f"{policy}_{s}"), F.col("ids").alias(f"ids_{s}")) for s in "ab")
    pairs = a.join(b, by).filter(F.col(f"{policy}_a") < F.col(f"{policy}_b"))
    both, either = F.size(F.array_intersect("ids_a", "ids_b")), F.size(F.array_union("ids_a", "ids_b"))
    return pairs.select(*by, f"{policy}_a", f"{policy}_b", (both / F.greatest(F.least(F.size("ids_a"), F.size("ids_b")), F.lit(1))).alias("overlap"), F.when(either > 0, both / either).otherwise(1.0).alias("jaccard"))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties sharing their mean."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """pearson and spearman of two columns; null where either is constant or there are fewer than two rows."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = known.withColumn("__rx", average_rank(x, by)).withColumn("__ry", average_rank(y, by))
    some = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.when(some, F.corr(x, y)).alias("pearson"), F.when(some, F.corr("__rx", "__ry")).alias("spearman"))


def paired_deltas(facts: DataFrame, policy: str, value: str, by: list[str], baseline: str) -> DataFrame:
    """Each policy against a baseline on the same ``by`` rows: n, mean, median, wins, ties, losses of the differences."""
    base = facts.filter(F.col(policy) == baseline).select(*by, F.col(value).alias("__base"))
    d = facts.filter(F.col(policy) != baseline).join(base, by).withColumn("d", F.col(value) - F.col("__base"))
    count = lambda c: F.sum(c.cast("long"))
    return d.groupBy(policy).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta"),
        count(F.col("d") > _TIE).alias("wins"), count(F.abs("d") <= _TIE).alias("ties"), count(F.col("d") < -_TIE).alias("losses"),
    )


def bootstrap_interval(facts: DataFrame, by: list[str], unit: str, value: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """mean, low, high of the mean by resampling ``unit`` rows with replacement.

    A replicate draws as many rows as there are; its draws are hashes of replicate and
    draw, so any plan gives the same interval. Rows are numbered in one order of all, and draws are made where
    the rows are dealt to; the rows are what is hashed in the join, never the draws, whose size no plan foresees.
    """
    rows = materialise(numbered(facts.select(*by, F.col(unit).alias("__unit"), F.col(value).cast("double").alias("__x")), *by, "__unit", name="__seat").drop("__unit"), "seats")
    groups = rows.groupBy(*by).agg(F.min("__seat").alias("__first"), F.count("*").alias("__n"))
    seats = rows.join(groups, by) if by else rows.crossJoin(groups)
    parts = -(-rows.count() * replicates // _DRAWS_A_TASK) or 1
    draws = seats.select("__first", "__n", "__seat").repartition(parts, "__seat").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    nth = F.least(F.floor(stable_random(F.col("r"), F.col("__seat") - F.col("__first") + 1) * F.col("__n")), F.col("__n") - 1)
    drawn = draws.select((F.col("__first") + nth).cast("int").alias("__seat"), "r")
    means = drawn.join(rows.hint("shuffle_hash"), "__seat").groupBy(*by, "r").agg(F.avg("__x").alias("m"))
    q = means.groupBy(*by).agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit(1 - (1 - level) / 2)).alias("high"))
    return facts.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(q, by)


def leave_one_out(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``without``, the mean of the group's other rows (null for a group of one), and ``contribution``, the row's share of the absolute total."""
    w = Window.partitionBy(*by)
    n, total = F.count("*").over(w), F.sum(value).over(w)
    return facts.withColumn("without", F.when(n > 1, (total - F.col(value)) / (n - 1))).withColumn("contribution", F.try_divide(F.abs(value), F.sum(F.abs(value)).over(w)))


def gini(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """gini of a column's values: 2 * sum(i * x) / (n * sum(x)) - (n + 1) / n, ascending; 0 where they add up to nothing."""
    x = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(value)))
    n, total = F.count("*"), F.sum(value)
    return x.groupBy(*by).agg(F.when(total > 0, 2 * F.sum(F.col("__i") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def numeric_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, min, p50, p90 and max of a column's finite values."""
    x = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
    return x.groupBy(*by).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), p[0].alias("p50"), p[1].alias("p90"), F.max(value).alias("max"))


def consensus(rankings: DataFrame) -> DataFrame:
    """One ranking of several ``rankings(run, id, rank, score)``: by mean rank, then Borda points, score and id."""
    n = F.count("*").over(Window.partitionBy("run"))
    each = rankings.withColumn("points", n - F.col("rank"))
    out = each.groupBy("id").agg(
        F.avg("rank").alias("mean_rank"), F.sum("points").alias("borda"), F.stddev_pop("rank").alias("rank_std"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.avg("score").alias("mean_score"), F.count("*").alias("runs"),
    )
    return numbered(out, F.asc("mean_rank"), F.desc("borda"), F.desc("mean_score"), F.asc("id"), name="consensus_rank")


def selection_summary(rows: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Of each ranking's first k rows, for each k: n, mean and least quality, groups, the largest group's share, and the share failing a quality of 0.45."""
    cut = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    groups = cut.groupBy(*by, "k", "group_id").agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.min("quality").alias("least"), F.sum((F.col("quality") < 0.45).cast("int")).alias("low"))
    return groups.groupBy(*by, "k").agg(
        F.sum("n").alias("n"), (F.sum("q") / F.sum("n")).alias("mean_quality"), F.min("least").alias("min_quality"), F.count("*").alias("groups"), (F.max("n") / F.sum("n")).alias("largest_group"), (F.sum("low") / F.sum("n")).alias("low_quality_rate"),
    )


def policy_summary(facts: DataFrame, policy: str, value: str, by: list[str]) -> DataFrame:
    """mean and n of each policy, and on how many rows of ``by`` it is best or ties with the best."""
    best = F.max(value).over(Window.partitionBy(*by))
    return facts.withColumn("__win", F.col(value) >= best - _TIE).groupBy(policy).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.sum(F.col("__win").cast("long")).alias("wins"))


def oracle_fraction(facts: DataFrame, policy: str, value: str, by: list[str], oracle: str, eps: float = 1e-12) -> DataFrame:
    """Adds ``fraction``, the value over the oracle's on the same row, within 0..1; null where the oracle gains nothing."""
    best = facts.filter(F.col(policy) == oracle).select(*by, F.col(value).alias("__o"))
    return facts.join(best, by, "left").withColumn("fraction", F.when(F.col("__o") > eps, F.least(F.greatest(F.col(value) / F.col("__o"), F.lit(0.0)), F.lit(1.0)))).drop("__o")


def replay_percentile(facts: DataFrame, policy: str, value: str, by: list[str], replay_prefix: str) -> DataFrame:
    """percentile (share of random replays at or below a policy) and p (1 + those at or above, over 1 + all), per row of ``by``."""
    replays = facts.filter(F.col(policy).startswith(replay_prefix)).select(*by, F.col(value).alias("__r"))
    others = facts.filter(~F.col(policy).startswith(replay_prefix)).join(replays, by)
    return others.groupBy(*by, policy, value).agg(F.avg((F.col("__r") <= F.col(value)).cast("double")).alias("percentile"), ((1 + F.sum((F.col("__r") >= F.col(value)).cast("int"))) / (1 + F.count("*"))).alias("p"))


def selection_metrics(rows: DataFrame, ks: list[int], by: list[str], low_quality: float = 0.45) -> DataFrame:
    """Per ranking and k: the ranking metrics, and clusters, repeats, quality, artefacts, redundancy and score among the first k, in one selection_score.

    ``rows`` has rank, label, cluster, quality, artifact, redundancy and score. retention is the mean score over that of the k best scores.
    """
    base = None
    for k in ks:
        one = ranking_metrics(rows.withColumn("corrupted", F.lit(0)), k, by).drop("corruption_rate").withColumn("k", F.lit(k))
        base = one if base is None else base.unionByName(one)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score")))
    each = rows.withColumn("__best", best).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    top = F.col("rank") <= F.col("k")
    share = lambda c: F.avg(F.when(top, c.cast("double")))
    more = each.groupBy(*by, "k").agg(
        F.countDistinct(F.when(top, F.col("cluster"))).alias("unique_clusters"), (F.count(F.when(top, 1)) - F.countDistinct(F.when(top, F.col("cluster")))).alias("cluster_repeats"),
        (F.countDistinct(F.when(top, F.col("cluster"))) / F.greatest(F.countDistinct("cluster"), F.lit(1))).alias("cluster_coverage"), share(F.col("quality")).alias("mean_quality"), share(F.col("quality") < low_quality).alias("low_quality_rate"),
        share(F.col("artifact") > 0).alias("artifact_rate"), share(F.col("redundancy") > 0).alias("redundancy_rate"), share(F.col("score")).alias("mean_score"),
        F.coalesce(F.try_divide(share(F.col("score")), F.avg(F.when(F.col("__best") <= F.col("k"), F.col("score")))), F.lit(0.0)).alias("retention"),
    )
    score = F.col("ndcg") + 0.5 * F.col("cluster_diversity") - F.col("artifact_rate") - 0.5 * F.col("redundancy_rate") - F.col("low_quality_rate")
    return base.join(more, [*by, "k"]).withColumn("selection_score", score)


#: Families of views by the beginning of their names.
FAMILIES = [("ts2vec", "ts2vec"), ("window", "window"), ("morph", "morphology"), ("raw_shape", "raw_shape")]


def feature_family(view: Column) -> Column:
    """The family of a view's features; a view of no known family is one of its own."""
    name = F.lower(view)
    out = None
    for start, family in FAMILIES:
        out = F.when(name.startswith(start), family) if out is None else out.when(name.startswith(start), family)
    return out.otherwise(name)


def feature_overlap(policies: DataFrame, views: DataFrame) -> DataFrame:
    """policy, view, family, overlap, primary_eval: whether a view that judges a policy is of a family that the policy selects by. ``policies(policy, families)``, ``views(view)``; both are small dimensions."""
    both = policies.join(F.broadcast(views.withColumn("family", feature_family(F.col("view")))), F.lit(True))
    return both.select("policy", "view", "family", F.array_contains("families", F.col("family")).alias("overlap")).withColumn("primary_eval", ~F.col("overlap"))


def balanced_gain(gains: DataFrame, by: list[str], primary: list[str], gain: str = "relative_gain") -> DataFrame:
    """The mean over the primary views of each row's gain; 0 where none is there."""
    return gains.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("view").isin(primary), F.col(gain))), F.lit(0.0)).alias("balanced_gain"))


def retrieval_summary(neighbours: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and 0.95 quantile of all neighbour distances."""
    return neighbours.groupBy(*(by or [])).agg(F.avg("distance").alias("mean_distance"), F.percentile("distance", F.lit(0.95)).alias("p95_distance"), F.count("*").alias("n"))
