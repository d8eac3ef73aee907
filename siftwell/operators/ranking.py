"""Gates, orders, caps, top-k and splits as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..storage import materialise


def passes(quality: float | None = None, stationary: float | None = None, max_abs: float | None = None, artifact: float | None = None) -> Column:
    """Whether a clip's quality, stationary, max_abs and artifact columns are within the limits given; None skips a check."""
    checks = [("quality", ">=", quality), ("stationary", "<=", stationary), ("max_abs", "<=", max_abs), ("artifact", "<=", artifact)]
    out = F.lit(True)
    for name, side, limit in checks:
        if limit is not None:
            out = out & (F.col(name) >= limit if side == ">=" else F.col(name) <= limit)
    return F.coalesce(out, F.lit(False))


def failing(checks: dict[str, Column]) -> Column:
    """The names of the failing checks joined by commas, in the order given."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])), ",")


def ranked(rows: DataFrame, *order: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in an order, within the groups of ``by``, or of all rows without passing them through one task."""
    if not by:
        return numbered(rows, *order, name=name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in an order of all rows.

    A sort by ranges is written with each row's place in its part; the parts' sizes, a number
    for each part, give what comes before a part.
    """
    placed = materialise(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "__part long, __before long"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, part == F.col("__part")).withColumn(name, place.cast("int")).drop("__at", "__part", "__before")


def quality_order(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranked(rows, F.desc("quality"), F.asc("id"), by=by)


def score_order(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranked(rows, F.desc("score"), F.desc("quality"), F.asc("id"), by=by)


def gated_order(rows: DataFrame, gate: Column, by: list[str] | None = None) -> DataFrame:
    """Those that pass first; each part by novelty, then quality, then id."""
    return ranked(rows.withColumn("passed", gate), F.desc("passed"), F.desc("novelty"), F.desc("quality"), F.asc("id"), by=by)


def random_order(rows: DataFrame, seed: str, gate: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """A reproducible random order, the rows that pass first."""
    draw = stable_random(F.lit(seed), F.col("id"))
    return ranked(rows.withColumn("draw", draw), F.desc(gate if gate is not None else F.lit(True)), F.asc("draw"), F.asc("id"), by=by)


def stratified_random_order(rows: DataFrame, seed: str, batch: int, by: list[str] | None = None) -> DataFrame:
    """The best 2 * ``batch`` by quality in random order, then the rest by quality."""
    first = quality_order(rows, by).withColumnRenamed("rank", "quality_rank")
    top = F.col("quality_rank") <= 2 * batch
    draw = F.when(top, stable_random(F.lit(seed), F.col("id")))
    return ranked(first.withColumn("draw", draw), F.desc(top), F.asc_nulls_last("draw"), F.asc("quality_rank"), by=by)


def capped_order(rows: DataFrame, group: str, cap: int, passed: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """``rows`` with a rank, renumbered so that the first ``cap`` passing rows of each group come before all others."""
    ok = F.coalesce(passed if passed is not None else F.lit(True), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*(by or []), group, "__ok").orderBy("rank"))
    marked = rows.withColumn("__ok", ok).withColumn("within_cap", F.col("__ok") & (nth <= cap)).withColumnRenamed("rank", "base_rank")
    return ranked(marked.drop("__ok"), F.desc("within_cap"), F.asc("base_rank"), by=by)


def passed_first(rows: DataFrame, gate: Column, by: list[str] | None = None) -> DataFrame:
    """A stable split of ranked rows: passing ones first, with the new score (n - rank + 1) / n."""
    out = ranked(rows.withColumn("failed", ~F.coalesce(gate, F.lit(False))).withColumnRenamed("rank", "base_rank"), F.asc("failed"), F.asc("base_rank"), by=by)
    n = F.count("*").over(Window.partitionBy(*(by or [F.lit(0)])))
    return out.withColumn("rank_score", (n - F.col("rank") + 1) / n)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.filter(F.col("rank") <= k)


def monotone_scores(rows: DataFrame, score: str, step: float = 1e-12) -> DataFrame:
    """``submitted``: scores in rank order, each less than the one before by at least ``step``."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("submitted", F.min(F.col(score) + step * F.col("rank")).over(w) - step * F.col("rank"))


def worker_coverage(rows: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by position."""
    return ranked(rows, F.asc(position), by=[group]).filter(F.col("rank") <= n).drop("rank")


def hash_shard(rows: DataFrame, position: str, shards: int, index: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(position), F.lit(shards)) == index)


def stratified_hash_split(rows: DataFrame, label: str, fraction: float, seed: str) -> DataFrame:
    """``split``: in each label the first round(n * fraction) rows by hash are eval, at least one and not all where there are two; the others train."""
    draw = stable_random(F.lit(seed), F.col("id"))
    nth = F.row_number().over(Window.partitionBy(label).orderBy(draw, "id"))
    n = F.count("*").over(Window.partitionBy(label))
    take = F.least(F.greatest(F.bround(n * fraction), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    return rows.withColumn("split", F.when(nth <= take, "eval").otherwise("train"))


def episode_split(episodes: DataFrame, train: float = 0.75, validation: float = 0.125) -> DataFrame:
    """``split`` of distinct episodes in id order: the first share trains, the next validates, the rest tests."""
    w = Window.orderBy("episode_id")
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    at = F.row_number().over(w)
    return episodes.select("episode_id").distinct().withColumn("split", F.when(at <= F.floor(n * train), "train").when(at <= F.floor(n * train) + F.floor(n * validation), "validation").otherwise("test"))


def quality_novelty_order(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranked(rows, F.desc("quality"), F.desc("novelty"), F.asc("id"), by=by)


def balanced_urls(rows: DataFrame, group: str, per_group: int, total: int, seed: str) -> DataFrame:
    """At most ``total`` rows, dealt group by group in turn, at most ``per_group`` of each, in a reproducible random order."""
    own = ranked(rows, F.asc(stable_random(F.lit(seed), F.col("id"))), F.asc("id"), by=[group], name="__nth").filter(F.col("__nth") <= per_group)
    return ranked(own, F.asc("__nth"), F.asc(group), name="rank").filter(F.col("rank") <= total).drop("__nth")
