"""Vectors that stand for clips, from window features, raw samples or tokens."""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import CHANNELS, DERIVED, preprocess


def _by_dimension(windows: DataFrame) -> DataFrame:
    """clip, window_idx, dim, x of each number of f; what isn't finite counts as 0."""
    rows = windows.select("clip", "window_idx", F.posexplode("f").alias("dim", "x"))
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs(F.col("x")) == float("inf"))
    return rows.withColumn("x", F.when(bad, 0.0).otherwise(F.col("x").cast("double")))


def _vector(stats: DataFrame, names: list[str]) -> DataFrame:
    """clip, v: the named statistics of each dimension, one statistic after the other."""
    sorted_dims = F.array_sort(F.collect_list(F.struct("dim", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])))

    def field(name: str):
        return lambda s: s[name]

    return stats.groupBy("clip").agg(sorted_dims.alias("d")).select("clip", F.flatten(F.array(*[F.transform("d", field(n)) for n in names])).alias("v"))


def mean_std_pool(windows: DataFrame) -> DataFrame:
    """Mean and deviation of each feature over a clip's windows ``(clip, window_idx, f)``."""
    stats = _by_dimension(windows).groupBy("clip", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return _vector(stats, ["mean", "std"])


def shape_stats(windows: DataFrame) -> DataFrame:
    """Mean, deviation, least, largest, quartiles, and mean and largest step between windows, of each feature."""
    x = _by_dimension(windows).withColumn("step", F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("clip", "dim").orderBy("window_idx"))))
    stats = x.groupBy("clip", "dim").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.percentile("x", F.lit(0.25)).alias("p25"), F.percentile("x", F.lit(0.75)).alias("p75"),
        F.avg("step").alias("mean_step"), F.max("step").alias("max_step"),
    )
    return _vector(stats, ["mean", "std", "min", "max", "p25", "p75", "mean_step", "max_step"])


def temporal_order(windows: DataFrame, parts: int = 3) -> DataFrame:
    """Mean and deviation of each third of a clip, then mean and largest step, and the last less the first third's mean; 0 where a part is empty."""
    order = Window.partitionBy("clip", "dim").orderBy("window_idx")
    n = F.count("*").over(Window.partitionBy("clip", "dim"))
    x = _by_dimension(windows).withColumn("part", F.ntile(parts).over(order)).withColumn("step", F.abs(F.col("x") - F.lag("x").over(order)))
    x = x.withColumn("at", F.row_number().over(order)).withColumn("n", n).withColumn("edge", F.greatest(F.lit(1), F.floor(F.col("n") / parts)))
    named, aggs = [], []
    for p in range(1, parts + 1):
        own = F.when(F.col("part") == p, F.col("x"))
        aggs += [F.avg(own).alias(f"mean{p}"), F.stddev_pop(own).alias(f"std{p}")]
        named += [f"mean{p}", f"std{p}"]
    last, first = F.avg(F.when(F.col("at") > F.col("n") - F.col("edge"), F.col("x"))), F.avg(F.when(F.col("at") <= F.col("edge"), F.col("x")))
    trend = F.when(F.count("step") > 0, last - first).alias("trend")
    stats = x.groupBy("clip", "dim").agg(*aggs, F.avg("step").alias("mean_step"), F.max("step").alias("max_step"), trend)
    return _vector(stats, [*named, "mean_step", "max_step", "trend"])


def _long_channels(series: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("dim"), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("x")) for i, c in enumerate(CHANNELS)])
    return series.select("clip", "idx", F.explode(each).alias("e")).select("clip", "idx", "e.dim", "e.x")


def autocorrelation(series: DataFrame, lags: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """clip, dim, acf_<lag> of each channel, its mean removed; 0 for clips that are too short."""
    own = Window.partitionBy("clip", "dim")
    x = _long_channels(series).withColumn("x", F.col("x") - F.avg("x").over(own))
    x = x.withColumns({f"l{k}": F.lag("x", k).over(own.orderBy("idx")) for k in lags})
    total = F.sum(F.col("x") * F.col("x")) + 1e-12
    return x.groupBy("clip", "dim").agg(*[F.coalesce(F.sum(F.col("x") * F.col(f"l{k}")) / total, F.lit(0.0)).alias(f"acf_{k}") for k in lags])


def raw_shape(series: DataFrame, rate: float = 30.0) -> DataFrame:
    """clip, v: 120 numbers of a clip's raw channels; levels, steps, shares of power in four bands, autocorrelations and axis shares of energy."""

    def of(x: np.ndarray) -> np.ndarray:
        d = np.diff(x, axis=0) if len(x) > 1 else np.zeros((1, x.shape[1]))
        c = x - x.mean(0)
        levels = [x.mean(0), x.std(0), x.min(0), x.max(0), *np.percentile(x, [25, 75], axis=0), (x * x).mean(0)]
        steps = [np.abs(d).mean(0), d.std(0), np.abs(d).max(0), np.percentile(np.abs(d), 95, axis=0), (d * d).mean(0)]
        power, freq = np.abs(np.fft.rfft(c, axis=0)) ** 2, np.fft.rfftfreq(len(c), 1 / rate)
        edges = [0.0, 0.5, 2.0, 5.0, max(rate / 2, 1.0) + 1e-6]
        bands = [power[(freq >= a) & (freq < b)].sum(0) / (power.sum(0) + 1e-12) if len(x) > 1 else np.zeros(6) for a, b in zip(edges, edges[1:])]
        energy = (c * c).sum(0) + 1e-12
        lags = [(c[:-k] * c[k:]).sum(0) / energy if len(c) > k else np.zeros(6) for k in (1, 3, 10)]
        e = (x * x).mean(0)
        axes = [e[:3] / max(e[:3].sum(), 1e-12), e[3:] / max(e[3:].sum(), 1e-12)]
        return np.nan_to_num(np.concatenate([*levels, *steps, *bands, *lags, *axes]), nan=0.0, posinf=0.0, neginf=0.0)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(pdf.sort_values("idx")[CHANNELS].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "v": [of(x).tolist()]})

    return series.select("clip", "idx", *CHANNELS).groupBy("clip").applyInPandas(each, f"clip {series.schema['clip'].dataType.simpleString()}, v array<double>")


def multiscale_summary(series: DataFrame, chunks: int = 5) -> DataFrame:
    """clip, chunk, dim and mean, std, min, max, rms and mean step of each channel in each of ``chunks`` equal parts of a clip: the handcrafted encoding, long."""
    x = _long_channels(series)
    order = Window.partitionBy("clip", "dim").orderBy("idx")
    x = x.withColumn("chunk", F.ntile(chunks).over(order)).withColumn("step", F.abs(F.col("x") - F.lag("x").over(order)))
    return x.groupBy("clip", "chunk", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg("step").alias("mean_step"))


def handcrafted(series: DataFrame, rate: float = 30.0, size: int = 512) -> DataFrame:
    """clip, v: the twelve normalised channels' mean, deviation, percentiles 10, 50, 90 and spectral entropy, over the whole clip and each quarter, filled with zeros to ``size`` or cut there.

    Quarters are equal, the first ones one sample longer; clips under four samples have no quarters. Means are the exact ones of the
    normalised doubles, rounded once, so no order of adding up shows in a last digit; columns near overflow or with infinities keep the plain mean.
    """
    channels = CHANNELS + DERIVED

    def exact(x: list[float]) -> float:
        m = math.fsum(x) / len(x)
        return m + math.fsum(chain(x, repeat(-m, len(x)))) / len(x)

    def mean(x: np.ndarray) -> np.ndarray:
        plain, fits = x.mean(0), np.abs(x).sum(0) < 1e300
        return np.array([exact(c.tolist()) if ok else m for c, m, ok in zip(x.T, plain, fits)])

    def entropy(x: np.ndarray) -> np.ndarray:
        if len(x) < 4:
            return np.zeros(x.shape[1])
        power = np.abs(np.fft.rfft(x - x.mean(0), axis=0)) ** 2
        p = power / (power.sum(0) + 1e-12)
        return -(p * np.log(p + 1e-12)).sum(0) / np.log(len(p))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")[channels].to_numpy(float)
        parts = [x, *(np.array_split(x, 4) if len(x) >= 4 else [])]
        v = np.nan_to_num(np.concatenate([s for p in parts for s in (mean(p), p.std(0), *np.percentile(p, [10, 50, 90], axis=0), entropy(p))]))[:size]
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "v": [np.pad(v, (0, size - len(v))).tolist()]})

    return preprocess(series, rate).groupBy("clip").applyInPandas(each, f"clip {series.schema['clip'].dataType.simpleString()}, v array<double>")


def token_histogram(tokens: DataFrame, vocabulary: int = 512) -> DataFrame:
    """seq, v: shares of the ``vocabulary`` commonest tokens (ties by token) in each sequence of ``tokens(seq, pos, token)``, commonest first."""
    top = tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(vocabulary)
    # the vocabulary is bounded by the parameter
    numbered = F.broadcast(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "token"))).select("token", "place"))
    size = tokens.groupBy("seq").agg(F.count("*").alias("size"))
    counts = tokens.join(numbered, "token").groupBy("seq", "place").agg(F.count("*").alias("n")).groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    kinds = top.agg(F.count("*").cast("int").alias("kinds"))
    joined = size.join(counts, "seq", "left").join(F.broadcast(kinds))
    share = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("size")
    return joined.select("seq", F.transform(F.sequence(F.lit(1), "kinds"), share).alias("v"))


def centroids(rows: DataFrame, group: str, vector: str = "v") -> DataFrame:
    """group, v, n: the mean vector of each group's rows."""
    x = rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return x.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))


def view(vector: Column, start: int, length: int) -> Column:
    """A fixed slice of a vector, as a second representation; places count from 1."""
    return F.slice(vector, start, length)
