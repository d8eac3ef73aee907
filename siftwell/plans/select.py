"""The whole selection: two sets of series in, a ranked table out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, neighbors, ranking, representations, scores, timeseries
from ..storage import materialise


@dataclass
class SelectConfig:
    k: int = 5
    min_quality: float = 0.85
    max_stationary: float = 0.90
    max_abs: float = 60.0
    per_group: int = 2
    similarity: float = 0.985
    width: int = 300
    stride: int = 150
    segment: int | None = None


def segments(series: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """Support clips cut into windows of ``length`` samples, each a clip of its own, the last aligned with the end."""
    cut = timeseries.windows(series, length, stride or length)
    return cut.withColumn("clip", F.concat_ws("#", F.col("clip").cast("string"), "window_idx")).withColumn("idx", F.col("idx") - F.col("start")).drop("window_idx", "start")


def select(support: DataFrame, candidates: DataFrame, config: SelectConfig | None = None) -> DataFrame:
    """Candidates ranked by what they add to the support.

    Series are featurised to window features and pooled shape statistics;
    novelty is the mean distance to the k nearest support clips; similar
    candidates form clusters; gated candidates come first by novelty, at most
    ``per_group`` of a cluster before the rest.
    """
    c = config or SelectConfig()
    own = candidates.withColumn("clip", F.col("clip").cast("string"))
    support = segments(support, c.segment) if c.segment else support.withColumn("clip", F.col("clip").cast("string"))

    def embedded(series: DataFrame, name: str) -> DataFrame:
        v = representations.shape_stats(timeseries.window_features(series, c.width, c.stride))
        return materialise(v.select(F.xxhash64("clip").alias("id"), "clip", "v"), name)

    old, new = embedded(support, "support"), embedded(own, "candidates")
    quality = timeseries.quality_features(own).select(F.col("clip").alias("__clip"), F.col("quality_score").alias("quality"), F.col("stationary_fraction").alias("stationary"), F.col("max_abs_value").alias("max_abs"))
    rows = new.join(quality, F.col("clip") == F.col("__clip")).drop("__clip")
    rows = rows.join(neighbors.novelty(new, old, c.k), "id").join(neighbors.density(new), "id").join(clusters.components(new, c.similarity), "id")
    rows = scores.scored(rows.drop("v")).withColumn("reason_code", scores.reason_code())
    ordered = ranking.gated_order(rows, ranking.passes(c.min_quality, c.max_stationary, c.max_abs))
    return ranking.capped_order(ordered, "cluster", c.per_group, F.col("passed")).drop("id")
