"""Featurising multi-channel series.

A series table is long: clip, idx (0.., the order of samples), ts (seconds, may
be null) and six channels, acc_x .. gyro_z. Work is per clip, so a clip's rows
meet once; clips are the unit of parallelism.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, stable_random

CHANNELS = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]


def _length(channels: list[str]) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in channels), F.lit(0.0)))


def _clean(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c).cast("double"))


def robust_normalise(series: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Every channel less its clip's median, over its quartile range (at least 1e-6); what isn't finite becomes 0."""
    channels = channels or CHANNELS
    q = series.groupBy("clip").agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"__{c}") for c in channels])
    joined = series.join(q, "clip")
    scaled = {c: F.coalesce(F.nanvl((F.col(c) - F.col(f"__{c}")[1]) / F.greatest(F.col(f"__{c}")[2] - F.col(f"__{c}")[0], F.lit(1e-6)), F.lit(0.0)), F.lit(0.0)) for c in channels}
    return joined.withColumns(scaled).select(*series.columns)


def moving_average(x: Column, rate: float, order: Window) -> Column:
    """A centred box filter of max(3, int(rate)) samples with zeros beyond the ends."""
    width = max(3, int(rate))
    return F.sum(x).over(order.rowsBetween(-(width // 2), width - 1 - width // 2)) / width


def invariants(series: DataFrame, rate: float = 30.0) -> DataFrame:
    """Adds acc_norm, gyro_norm, acc_jerk, gyro_jerk, linear_norm (gravity's moving average removed) and still."""
    w = Window.partitionBy("clip").orderBy("idx")
    out = series.withColumn("acc_norm", _length(CHANNELS[:3])).withColumn("gyro_norm", _length(CHANNELS[3:]))

    def jerk(channels: list[str]) -> Column:
        steps = [F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in channels]
        return F.sqrt(sum((s * s for s in steps), F.lit(0.0))) * rate

    out = out.withColumn("acc_jerk", jerk(CHANNELS[:3])).withColumn("gyro_jerk", jerk(CHANNELS[3:]))
    rest = [F.col(c) - moving_average(F.col(c), rate, w) for c in CHANNELS[:3]]
    out = out.withColumn("linear_norm", F.sqrt(sum((r * r for r in rest), F.lit(0.0))))
    median = F.percentile("acc_norm", F.lit(0.5)).over(Window.partitionBy("clip"))
    return out.withColumn("still", (F.abs(F.col("acc_norm") - median) < 0.05) & (F.col("gyro_norm") < 0.02))


#: The derived channels, in order.
DERIVED = ["acc_norm", "gyro_norm", "acc_jerk", "gyro_jerk", "linear_norm", "still"]


def preprocess(series: DataFrame, rate: float = 30.0) -> DataFrame:
    """clip, idx and twelve channels: the six and the six derived from them, each normalised within its clip."""
    derived = invariants(series, rate).withColumn("still", F.col("still").cast("double"))
    return robust_normalise(derived.select("clip", "idx", *CHANNELS, *DERIVED), CHANNELS + DERIVED)


def shard_normalise(series: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Every channel less the mean of all of the clip's numbers, over their deviation (1 where that is below ``floor`` or not finite)."""
    numbers = series.select("clip", F.explode(F.array(*CHANNELS)).alias("x"))
    m = numbers.groupBy("clip").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    scale = F.when((F.col("__s") >= floor) & (F.col("__s") < float("inf")), F.col("__s")).otherwise(1.0)
    return series.join(m, "clip").withColumns({c: (F.col(c) - F.col("__m")) / scale for c in CHANNELS}).select(*series.columns)


def quality_features(series: DataFrame, rate: float = 30.0) -> DataFrame:
    """Fifteen artefact measures and quality_score of each clip.

    Two passes over a clip's rows: steps and their medians, then shares. A clip
    of one sample has no steps, so spikes and high-frequency energy are 0.
    """
    clip, order = Window.partitionBy("clip"), Window.partitionBy("clip").orderBy("idx")
    s = series.select("clip", "idx", "ts", *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    s = s.withColumns({f"n_{c}": F.isnan(c) | F.col(c).isNull() for c in CHANNELS} | {f"i_{c}": F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) for c in CHANNELS})
    s = s.withColumns({c: _clean(c) for c in CHANNELS})
    s = s.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(order) for c in CHANNELS}).withColumn("dt", F.col("ts") - F.lag("ts").over(order))
    s = s.withColumn("acc_norm", _length(CHANNELS[:3])).withColumn("gyro_norm", _length(CHANNELS[3:]))
    s = s.withColumns({f"m_{c}": F.percentile(f"d_{c}", F.lit(0.5)).over(clip) for c in CHANNELS} | {"m_acc": F.percentile("acc_norm", F.lit(0.5)).over(clip)})
    s = s.withColumns({f"r_{c}": F.percentile(F.abs(F.col(f"d_{c}") - F.col(f"m_{c}")), F.lit(0.5)).over(clip) + 1e-6 for c in CHANNELS})

    def share(of) -> Column:
        return sum((F.avg(of(c).cast("double")) for c in CHANNELS), F.lit(0.0)) / len(CHANNELS)

    step = lambda c: F.abs(F.col(f"d_{c}"))
    stds = F.array_sort(F.array(*[F.stddev_pop(c) for c in CHANNELS]))
    out = s.groupBy("clip").agg(
        F.count("*").cast("double").alias("n_samples"),
        (F.count("*") / rate).alias("duration_sec"),
        share(lambda c: F.col(f"n_{c}") | F.col(f"i_{c}")).alias("missing_rate"),
        share(lambda c: F.col(f"n_{c}")).alias("nan_fraction"),
        share(lambda c: F.col(f"i_{c}")).alias("inf_fraction"),
        (sum(((F.var_pop(c) <= 1e-8).cast("double") for c in CHANNELS), F.lit(0.0)) / len(CHANNELS)).alias("flatline_fraction"),
        share(lambda c: F.abs(F.col(c)) >= 250).alias("saturation_fraction"),
        F.greatest(*[F.max(F.abs(F.col(c))) for c in CHANNELS]).alias("max_abs_value"),
        share(lambda c: F.abs(F.col(c)) >= 100).alias("extreme_value_fraction"),
        F.coalesce(share(lambda c: (step(c) > 25 * F.col(f"r_{c}")) | (step(c) > 100)), F.lit(0.0)).alias("spike_rate"),
        F.coalesce(sum((F.avg(step(c) * step(c)) for c in CHANNELS), F.lit(0.0)) / len(CHANNELS), F.lit(0.0)).alias("high_frequency_energy"),
        F.avg(((F.abs(F.col("acc_norm") - F.col("m_acc")) < 0.05) & (F.col("gyro_norm") < 0.02)).cast("double")).alias("stationary_fraction"),
        (F.element_at(stds, -1) / ((stds[2] + stds[3]) / 2 + 1e-6)).alias("axis_imbalance"),
        F.coalesce(F.avg((F.col("dt") <= 0).cast("double")), F.lit(0.0)).alias("repeated_timestamp_fraction"),
        F.coalesce(F.avg((F.abs(F.col("dt") - 1 / rate) > 0.5 / rate).cast("double")), F.lit(0.0)).alias("timestamp_jitter_fraction"),
    )
    return out.withColumn("quality_score", quality_score())


def quality_score() -> Column:
    """1 less the penalties of the quality features, within 0..1."""
    #: The weight of each measure.
    weights = {
        "missing_rate": 1.40, "nan_fraction": 1.10, "inf_fraction": 1.10, "flatline_fraction": 1.20, "saturation_fraction": 1.30,
        "repeated_timestamp_fraction": 0.80, "timestamp_jitter_fraction": 0.60,
    }
    over = lambda name, start, unit, most: F.when(F.col(name) > start, F.least((F.col(name) - start) / unit, F.lit(most))).otherwise(0.0)
    penalty = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))
    penalty = penalty + 8.0 * F.least("extreme_value_fraction", F.lit(0.10)) + 5.0 * F.least("spike_rate", F.lit(0.25))
    penalty = penalty + over("axis_imbalance", 25.0, 100.0, 0.20) + over("max_abs_value", 250.0, 250.0, 0.75) + F.when(F.col("stationary_fraction") > 0.98, 0.15).otherwise(0.0)
    return clip01(1 - penalty)


def window_starts(n: Column, width: int, stride: int) -> Column:
    """Starts of windows over n samples, the last aligned with the end; one window if there are no more samples than its width."""
    steps = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)).cast("int"), F.lit(stride))
    return F.array_distinct(F.concat(steps, F.array(F.greatest(n - width, F.lit(0)).cast("int"))))


def windows(series: DataFrame, width: int = 300, stride: int = 150) -> DataFrame:
    """The samples of each window: clip, window_idx, start and the sample's columns. A sample is repeated for each window it is in."""
    n = F.count("*").over(Window.partitionBy("clip"))
    all_starts = series.withColumn("__starts", window_starts(n, width, stride))
    inside = F.filter(F.transform("__starts", lambda s, i: F.struct(i.alias("window_idx"), s.alias("start"))), lambda w: (F.col("idx") >= w["start"]) & (F.col("idx") < w["start"] + width))
    return all_starts.withColumn("__w", F.explode(inside)).select("clip", "__w.window_idx", "__w.start", "idx", *[c for c in series.columns if c not in ("clip", "idx")])


def distribution_stats(rows: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """mean, std, rms, min, max and percentiles 5, 25, 50, 75, 95 of a column."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    named = [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("__p")]
    out = rows.groupBy(*by).agg(*named).withColumns({f"p{x}": F.col("__p")[i] for i, x in enumerate((5, 25, 50, 75, 95))}).drop("__p")
    return out.withColumnsRenamed({c: prefix + c for c in out.columns if c not in by}) if prefix else out


def spectrum(x: np.ndarray, rate: float) -> list[float]:
    """power / n, dominant frequency and its share, normalised entropy, centroid, spread, shares below 1 Hz and from 1 Hz, the mean removed."""
    if len(x) < 3:
        return [0.0] * 8
    power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)[1:]
    total = power.sum()
    if total <= 1e-12:
        return [0.0] * 8
    p = power / total
    top = int(power.argmax())
    centre = float(freq @ p)
    low = float(p[freq < 1].sum())
    return [total / len(x), freq[top], p[top], -float((p * np.log(p + 1e-12)).sum()) / np.log(len(p) + 1e-12), centre, float(np.sqrt(((freq - centre) ** 2) @ p)), low, 1 - low]


def _stats(x: np.ndarray) -> list[float]:
    x = x if len(x) else np.zeros(1)
    return [x.mean(), x.std(), np.sqrt((x * x).mean()), x.min(), x.max(), *np.percentile(x, [5, 25, 50, 75, 95])]


def window_features(series: DataFrame, width: int = 300, stride: int = 150, rate: float = 30.0, single: bool = True) -> DataFrame:
    """clip, window_idx, f: 75 numbers a window, namely distribution and spectral statistics of four signals and three of context.

    Spark has no Fourier transform, so a clip's windows are worked out together
    in one Arrow group; short clips are one window. Numbers are of single precision, or double where ``single`` is unset.
    """

    def of(window: np.ndarray) -> list[float]:
        acc, gyro = window[:, :3], window[:, 3:]
        size = lambda a: np.sqrt((a * a).sum(1))
        signals = [size(acc), size(gyro), size(np.diff(acc, axis=0)) * rate, size(np.diff(gyro, axis=0)) * rate]
        lean = lambda a: a.std(0).max() / (np.median(a.std(0)) + 1e-6)
        still = (np.abs(signals[0] - np.median(signals[0])) < 0.05) & (signals[1] < 0.02)
        return [x for s in signals for x in [*_stats(s), *spectrum(s, rate)]] + [still.mean(), lean(acc), lean(gyro)]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(pdf.sort_values("idx")[CHANNELS].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        last = max(len(x) - width, 0)
        starts = sorted({*range(0, last + 1, stride), last})
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "window_idx": range(len(starts)), "f": [np.array(of(x[s : s + width]), np.float32 if single else np.float64).tolist() for s in starts]})

    return series.select("clip", "idx", *CHANNELS).groupBy("clip").applyInPandas(each, f"clip {series.schema['clip'].dataType.simpleString()}, window_idx int, f array<{'float' if single else 'double'}>")


def periodicity(series: DataFrame, value: str, rate: float = 30.0) -> DataFrame:
    """clip, period_sec, strength: the strongest autocorrelation at lags of 0.35 to 3 seconds; zeros for clips under 4 seconds."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("idx")[value].to_numpy(float)
        lag = strength = 0.0
        if len(x) >= int(rate * 4):
            x = x - np.nanmean(x)
            size = np.linalg.norm(x)
            if np.isfinite(size) and size > 1e-8:
                x = x / size
                lags = range(max(1, int(0.35 * rate)), min(len(x) - 1, int(3 * rate)) + 1)
                found = [float(x[:-k] @ x[k:]) for k in lags]
                if len(found) > 1:
                    lag, strength = lags[int(np.argmax(found))], max(found)
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "period_sec": [lag / rate], "strength": [float(strength)]})

    return series.select("clip", "idx", value).groupBy("clip").applyInPandas(each, f"clip {series.schema['clip'].dataType.simpleString()}, period_sec double, strength double")


def trace_flags() -> Column:
    """The flags of a clip with quality features and p95 columns of its norms and jerks."""
    c = F.col
    #: The flags in order, with their limits.
    flags = [
        ("low_quality_score", c("quality_score") < 0.85),
        ("mostly_stationary", c("stationary_fraction") > 0.90),
        ("physical_abs_value_outlier", c("max_abs_value") > 60),
        ("spiky_or_extreme", (c("spike_rate") > 0.02) | (c("extreme_value_fraction") > 0)),
        ("flatline_or_missing", (c("flatline_fraction") > 0.20) | (c("missing_rate") > 0)),
        ("axis_imbalance", c("axis_imbalance") > 25),
        ("timestamp_irregularity", (c("timestamp_jitter_fraction") > 0.10) | (c("repeated_timestamp_fraction") > 0.01)),
        ("low_motion_energy", (c("gyro_norm_p95") < 0.02) & (c("acc_jerk_p95") < 1)),
        ("high_jerk", (c("gyro_jerk_p95") > 25) | (c("acc_jerk_p95") > 250)),
    ]
    found = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in flags]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("clean_motion")))


def trace_verdict(flags: Column) -> Column:
    artefacts = ["low_quality_score", "physical_abs_value_outlier", "spiky_or_extreme", "flatline_or_missing", "axis_imbalance", "timestamp_irregularity"]
    still = ["mostly_stationary", "low_motion_energy"]
    holds = lambda names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    return F.when(holds(artefacts), "likely_artifact").when(holds(still), "mostly_stationary").otherwise("plausible_motion")


def corrupted(series: DataFrame, mode: str, seed: str = "0") -> DataFrame:
    """Negative controls: flatline, spike, saturation, jitter or noise; draws depend on clip, sample and seed alone."""
    draw = lambda c: stable_random(F.lit(f"{seed}:{c}"), F.col("clip"), F.col("idx"))
    first = Window.partitionBy("clip").orderBy("idx")
    changes = {
        "flatline": lambda c: F.first(c).over(first),
        "spike": lambda c: F.when(draw("at") < 0.02, F.col(c) + F.when(draw(c) < 0.5, -500.0).otherwise(500.0)).otherwise(F.col(c)),
        "saturation": lambda c: F.when(F.col(c) < 0, -300.0).otherwise(300.0),
        "noise": lambda c: F.col(c) + F.stddev_pop(c).over(Window.partitionBy("clip")) * (draw(c) + draw(c + "'") - 1) * 2,
    }
    if mode == "jitter":
        return series.withColumn("ts", F.col("ts") + (draw("ts") - 0.5) / 10)
    return series.withColumns({c: changes[mode](c) for c in CHANNELS})


def motion_regimes(features: DataFrame) -> DataFrame:
    """``regime`` from each clip's acc_energy and gyro_energy against the corpus quartiles: low_motion, rotation_dominant, high_dynamic or mixed."""
    q = features.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{c}") for c in ("acc_energy", "gyro_energy")])
    a, g = F.col("acc_energy"), F.col("gyro_energy")
    low, high = (lambda c: F.col(f"__{c}")[0]), (lambda c: F.col(f"__{c}")[1])
    # one row of quartiles joins every clip
    regime = F.when((a <= low("acc_energy")) & (g <= low("gyro_energy")), "low_motion").when((g >= high("gyro_energy")) & (a < high("acc_energy")), "rotation_dominant").when(a >= high("acc_energy"), "high_dynamic").otherwise("mixed")
    return features.join(F.broadcast(q)).withColumn("regime", regime).drop("__acc_energy", "__gyro_energy")


def expanded_channels(series: DataFrame) -> DataFrame:
    """Fourteen channels: the six, both norms, the cross product of acc and gyro, and acc less its clip's mean."""
    a, g = CHANNELS[:3], CHANNELS[3:]
    col = F.col
    cross = [col(a[(i + 1) % 3]) * col(g[(i + 2) % 3]) - col(a[(i + 2) % 3]) * col(g[(i + 1) % 3]) for i in range(3)]
    mean = Window.partitionBy("clip")
    return series.withColumns(
        {"acc_norm": _length(a), "gyro_norm": _length(g)} | {f"cross_{'xyz'[i]}": x for i, x in enumerate(cross)} | {f"centred_{'xyz'[i]}": col(c) - F.avg(c).over(mean) for i, c in enumerate(a)}
    )
