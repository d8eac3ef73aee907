"""What a learned ranker is trained on: gains of candidates as labels, their gates, and distance features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot, safe_float, unit
from .greedy import _with_targets, alone_gains, lazy_greedy
from .neighbors import knn_join


def gain_labels(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """batch, id, gain_alone, relative_gain_alone, greedy_rank, gain_after_prefix, relative_gain_after_prefix.

    The greedy order is that of the oracle over all rows; a row's prefix is what comes before it,
    and its gain after that is the fall of the targets' mean distance from there.
    """

    def pick(left: pd.DataFrame, before: np.ndarray, distances):
        steps = [(i, fall) for i, fall, _ in lazy_greedy(left, before, distances, len(left), 12)]
        return [i for i, _ in steps], [fall for _, fall in steps]

    gains = alone_gains(rows, targets)
    greedy = _with_targets(rows.join(gains.select("batch", "id", "gain"), ["batch", "id"]), targets, pick, ("gain",)).select("batch", "id", F.col("rank").alias("greedy_rank"), F.col("value").alias("gain_after_prefix"))
    alone = gains.select("batch", "id", F.col("gain").alias("gain_alone"), F.col("relative_gain").alias("relative_gain_alone"))
    mean = targets.groupBy("batch").agg(F.avg("before").alias("__mean"))
    from pyspark.sql import Window

    used = F.coalesce(F.sum("gain_after_prefix").over(Window.partitionBy("batch").orderBy("greedy_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = greedy.join(alone, ["batch", "id"]).join(mean, "batch").withColumn("relative_gain_after_prefix", F.col("gain_after_prefix") / F.greatest(F.col("__mean") - used, F.lit(1e-12)))
    return out.drop("__mean")


def hygiene_labels(rows: DataFrame, gains: list[str], quality: float = 0.85, stationary: float = 0.90, max_abs: float = 60.0, similarity: float | None = 0.985) -> DataFrame:
    """``rows`` with hygiene_gate and gated_<gain> for each of ``gains``: the gain where all four checks hold, else 0.

    Values that aren't finite fail their check; the check on nearest_similarity is left out where the column, or the limit, is missing.
    """
    checks = [safe_float(F.col("quality")) >= quality, safe_float(F.col("stationary"), 1.0) <= stationary, safe_float(F.col("max_abs"), 1e308) <= max_abs]
    if similarity is not None and "nearest_similarity" in rows.columns:
        checks.append(safe_float(F.col("nearest_similarity")) <= similarity)
    gate: Column = F.lit(True)
    for c in checks:
        gate = gate & c
    out = rows.withColumn("hygiene_gate", gate)
    return out.withColumns({f"gated_{g}": F.when(F.col("hygiene_gate"), safe_float(F.col(g))).otherwise(0.0) for g in gains})


def distance_features(rows: DataFrame, cluster: str) -> DataFrame:
    """id, nn_distance, nearest_similarity, mean_distance, centroid_distance of ``rows(id, v, cluster)``.

    The mean distance to all others comes from the sum of all unit vectors, without any pair; the centroid is
    its cluster's normalised mean, at distance 1 from the only member of a cluster. A single row has distances 1.
    """
    own = rows.select("id", unit(F.col("v")).alias("u"), F.col(cluster).alias("__c"))

    def summed(by: list[str]) -> DataFrame:
        each = own.select(*by, F.posexplode("u").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
        return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))

    near = knn_join(rows, rows, 1, leave_self_out=True).select(F.col("query_id").alias("id"), F.col("distance").alias("nn_distance"))
    of_all = summed([]).select(F.col("total").alias("all_total"), F.col("n").alias("all_n"))
    of_cluster = summed(["__c"])
    # broadcast: one vector
    out = own.crossJoin(F.broadcast(of_all)).join(of_cluster, "__c").join(near, "id", "left")
    others = F.col("all_n") - 1
    mean = F.when(others > 0, 1 - (dot(F.col("u"), F.col("all_total")) - 1) / others).otherwise(1.0)
    centre = F.when(F.col("n") > 1, 1 - dot(F.col("u"), unit(F.col("total")))).otherwise(1.0)
    nn = F.coalesce("nn_distance", F.lit(1.0))
    return out.select("id", nn.alias("nn_distance"), (1 - nn).alias("nearest_similarity"), mean.alias("mean_distance"), centre.alias("centroid_distance"))


def with_labels(features: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Features with the labels of a composite key; an error if a row has none or the key isn't unique among labels."""
    twice = labels.groupBy(*key).count().filter("count > 1").count()
    missing = features.join(labels, key, "left_anti").count()
    if twice or missing:
        raise ValueError(f"{missing} rows have no label, {twice} keys have several")
    return features.join(labels, key)


def with_metadata(rows: DataFrame, metadata: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """All of ``rows`` with the metadata's columns under a prefix, and has_<prefix>; the first row of an id by all its columns counts."""
    values = [c for c in metadata.columns if c != key]
    one = metadata.groupBy(key).agg(F.min(F.struct(*values)).alias("__m"))
    joined = rows.join(one, key, "left")
    return joined.select(*rows.columns, F.col("__m").isNotNull().alias(f"has_{prefix}"), *[F.col(f"__m.{v}").alias(f"{prefix}_{v}") for v in values])


def select_split(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of a split; an error if there are none."""
    out = rows.filter(F.col(column) == split)
    if out.isEmpty():
        raise ValueError(f"split {split!r} has no rows")
    return out
