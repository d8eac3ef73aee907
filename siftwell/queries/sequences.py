"""Queries on series, tokens and representations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import representations, timeseries, tokens as tk
from ..operators.timeseries import CHANNELS
from .base import SERIES, TOKENS, rounded, series, tokens


def _scaled(spark, sf_dir):
    """Channels near the size that gates expect."""
    s = series(spark, sf_dir)
    return s.withColumns({"acc_x": F.col("acc_x") / 10, "acc_y": F.col("acc_y") / 10, "gyro_z": F.col("gyro_z") / 100})


def series_quality(spark, sf_dir):
    return rounded(timeseries.quality_features(series(spark, sf_dir)))


def series_windows(spark, sf_dir):
    """Distribution statistics of the acceleration norm in windows of 300 samples by 150."""
    s = timeseries.invariants(series(spark, sf_dir)).select("clip", "idx", "acc_norm")
    return rounded(timeseries.distribution_stats(timeseries.windows(s), ["clip", "window_idx"], "acc_norm"))


def series_invariants(spark, sf_dir):
    s = timeseries.invariants(series(spark, sf_dir))
    return rounded(s.groupBy("clip").agg(*[F.avg(c).alias(c) for c in ("acc_norm", "gyro_norm", "acc_jerk", "gyro_jerk", "linear_norm")], F.avg(F.col("still").cast("double")).alias("still")))


def robust_normalised(spark, sf_dir):
    s = timeseries.robust_normalise(series(spark, sf_dir))
    return rounded(s.groupBy("clip").agg(*[F.sum(F.abs(F.col(c))).alias(c) for c in CHANNELS]), 4)


def expanded_channels(spark, sf_dir):
    s = timeseries.expanded_channels(series(spark, sf_dir))
    return rounded(s.groupBy("clip").agg(*[F.avg(c).alias(c) for c in ("cross_x", "cross_y", "cross_z")], *[F.max(c).alias(c) for c in ("centred_x", "centred_y", "centred_z")]), 4)


def motion_regimes(spark, sf_dir):
    s = series(spark, sf_dir)
    e = s.groupBy("clip").agg(F.avg(sum((F.col(c) * F.col(c) for c in CHANNELS[:3]), F.lit(0.0))).alias("acc_energy"), F.avg(sum((F.col(c) * F.col(c) for c in CHANNELS[3:]), F.lit(0.0))).alias("gyro_energy"))
    return rounded(timeseries.motion_regimes(e), 4)


def corrupted_quality(spark, sf_dir):
    """Quality of clips and of their corrupted copies."""
    s = series(spark, sf_dir)
    out = None
    for mode in ("flatline", "spike", "saturation", "jitter", "noise"):
        q = timeseries.quality_features(timeseries.corrupted(s, mode)).select("clip", F.lit(mode).alias("mode"), "quality_score")
        out = q if out is None else out.unionByName(q)
    return rounded(out)


def trace_verdicts(spark, sf_dir):
    s = timeseries.invariants(_scaled(spark, sf_dir))
    p95 = s.groupBy("clip").agg(*[F.percentile(c, F.lit(0.95)).alias(f"{c}_p95") for c in ("acc_norm", "gyro_norm", "acc_jerk", "gyro_jerk")])
    rows = timeseries.quality_features(_scaled(spark, sf_dir)).join(p95, "clip").withColumn("f", timeseries.trace_flags())
    return rows.select("clip", F.array_join("f", ",").alias("flags"), timeseries.trace_verdict(F.col("f")).alias("verdict"))


def window_features(spark, sf_dir):
    """Every number of the windows' features, a row each."""
    f = timeseries.window_features(series(spark, sf_dir), single=False)
    return rounded(f.select("clip", "window_idx", F.posexplode("f").alias("dim", "x")), 4)


def periodicity(spark, sf_dir):
    return rounded(timeseries.periodicity(timeseries.invariants(series(spark, sf_dir)), "acc_norm"))


def _window_vectors(spark, sf_dir):
    """Six channel means in windows of 100 by 50, as a small stand-in for window features."""
    w = timeseries.windows(series(spark, sf_dir), 100, 50)
    return w.groupBy("clip", "window_idx").agg(F.array(*[F.avg(c) for c in CHANNELS]).alias("f"))


def pooled_windows(spark, sf_dir):
    v = representations.mean_std_pool(_window_vectors(spark, sf_dir))
    return rounded(v.select("clip", F.posexplode("v").alias("dim", "x")))


def shape_statistics(spark, sf_dir):
    v = representations.shape_stats(_window_vectors(spark, sf_dir))
    return rounded(v.select("clip", F.posexplode("v").alias("dim", "x")))


def temporal_order(spark, sf_dir):
    v = representations.temporal_order(_window_vectors(spark, sf_dir))
    return rounded(v.select("clip", F.posexplode("v").alias("dim", "x")))


def autocorrelations(spark, sf_dir):
    return rounded(representations.autocorrelation(series(spark, sf_dir)))


def raw_shape(spark, sf_dir):
    """Every number of the raw shape, a row each; a little is added so that percentiles half-way between two digits round alike everywhere."""
    return rounded(representations.raw_shape(series(spark, sf_dir)).select("clip", F.posexplode("v").alias("dim", "x")).withColumn("x", F.col("x") + 1e-9))


def multiscale_summary(spark, sf_dir):
    return rounded(representations.multiscale_summary(series(spark, sf_dir)))


def token_histogram(spark, sf_dir):
    v = representations.token_histogram(tokens(spark, sf_dir), 3)
    return rounded(v.select("seq", F.posexplode("v").alias("place", "share")))


def _learned(t):
    return t.filter(F.pmod("seq", F.lit(2)) == 0), t.filter(F.pmod("seq", F.lit(2)) == 1)


def token_surprisal(spark, sf_dir):
    """Sequences of odd users under a grammar of the even users'."""
    known, new = _learned(tokens(spark, sf_dir))
    return rounded(tk.sequence_features(new, tk.fit_grammar(known)))


def token_nll(spark, sf_dir):
    known, new = _learned(tokens(spark, sf_dir))
    return rounded(tk.token_nll(new, tk.fit_grammar(known)))


def mined_phrases(spark, sf_dir):
    out = tk.mine_phrases(tokens(spark, sf_dir), 100, 4)
    return rounded(out.select(F.array_join("phrase", " ").alias("phrase"), "n", "count", "score", "rank"))


def encoded_phrases(spark, sf_dir):
    t = tokens(spark, sf_dir)
    out = tk.encode_phrases(t, tk.mine_phrases(t, 50, 4))
    return out.select("seq", "pos", F.array_join("phrase", " ").alias("phrase"))


def phrase_families(spark, sf_dir):
    out = tk.phrase_families(tokens(spark, sf_dir), 2, 3, 3)
    return out.select(F.array_join("phrase", " ").alias("phrase"), "support")


def phrase_holdout(spark, sf_dir):
    t = tokens(spark, sf_dir)
    kinds = [r[0] for r in t.select("token").distinct().orderBy("token").limit(2).collect()]
    return tk.phrase_holdout(t, [*kinds, kinds[0]])


def patch_codes(spark, sf_dir):
    """Patches of two windows, each coded by the nearest of four windows' patches."""
    p = tk.patches(_window_vectors(spark, sf_dir), 2)
    book = p.filter((F.col("clip") <= 4) & (F.col("patch_idx") == 0)).select(F.col("clip").cast("int").alias("code"), F.col("v").alias("centre"))
    return tk.encode_patches(p, book).select("clip", "patch_idx", "code")


def code_usage(spark, sf_dir):
    return rounded(tk.code_usage(tokens(spark, sf_dir).withColumnRenamed("token", "code"), 8))


QUERIES = {
    f.__name__: f
    for f in (
        series_quality, series_windows, series_invariants, robust_normalised, expanded_channels, motion_regimes, corrupted_quality, trace_verdicts, window_features, periodicity, pooled_windows, shape_statistics, temporal_order,
        autocorrelations, raw_shape, multiscale_summary, token_histogram, token_surprisal, token_nll, mined_phrases, encoded_phrases, phrase_families, phrase_holdout, patch_codes, code_usage,
    )
}

_ACC, _GYRO = "sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)", "sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z)"
_LAGS = ", ".join(f"{c} - lag({c}) OVER o AS d_{c}" for c in CHANNELS)


def _share(expr: str, prefix: str = "") -> str:
    return "(" + " + ".join(f"avg(({expr.format(c=c)})::INT)" for c in CHANNELS) + ") / 6"


def _quality(source: str) -> str:
    """Steps, their medians and shares of a series table, as CTEs that end in quality."""
    med = ", ".join(f"median(d_{c}) OVER (PARTITION BY clip) AS m_{c}" for c in CHANNELS)
    mad = ", ".join(f"median(abs(d_{c} - m_{c})) OVER (PARTITION BY clip) + 1e-6 AS r_{c}" for c in CHANNELS)
    return f"""steps AS (SELECT *, {_LAGS}, ts - lag(ts) OVER o AS dt, {_ACC} AS acc_norm, {_GYRO} AS gyro_norm FROM {source} WINDOW o AS (PARTITION BY clip ORDER BY idx)),
med AS (SELECT *, {med}, median(acc_norm) OVER (PARTITION BY clip) AS m_acc FROM steps), mad AS (SELECT *, {mad} FROM med),
agg AS (SELECT clip, count(*)::DOUBLE AS n_samples, count(*) / 30.0 AS duration_sec, 0.0 AS missing_rate, 0.0 AS nan_fraction, 0.0 AS inf_fraction,
({' + '.join(f'(var_pop({c}) <= 1e-8)::INT' for c in CHANNELS)}) / 6 AS flatline_fraction, {_share('abs({c}) >= 250')} AS saturation_fraction, greatest({', '.join(f'max(abs({c}))' for c in CHANNELS)}) AS max_abs_value, {_share('abs({c}) >= 100')} AS extreme_value_fraction,
coalesce({_share('abs(d_{c}) > 25 * r_{c} OR abs(d_{c}) > 100')}, 0) AS spike_rate, coalesce(({' + '.join(f'avg(d_{c} * d_{c})' for c in CHANNELS)}) / 6, 0) AS high_frequency_energy,
avg((abs(acc_norm - m_acc) < 0.05 AND gyro_norm < 0.02)::INT) AS stationary_fraction, greatest({', '.join(f'stddev_pop({c})' for c in CHANNELS)}) / (list_median([{', '.join(f'stddev_pop({c})' for c in CHANNELS)}]) + 1e-6) AS axis_imbalance,
coalesce(avg((dt <= 0)::INT), 0) AS repeated_timestamp_fraction, coalesce(avg((abs(dt - 1 / 30.0) > 0.5 / 30.0)::INT), 0) AS timestamp_jitter_fraction FROM mad GROUP BY clip),
quality AS (SELECT *, least(greatest(1 - (1.4 * missing_rate + 1.1 * nan_fraction + 1.1 * inf_fraction + 1.2 * flatline_fraction + 1.3 * saturation_fraction + 0.8 * repeated_timestamp_fraction + 0.6 * timestamp_jitter_fraction
+ 8 * least(extreme_value_fraction, 0.1) + 5 * least(spike_rate, 0.25) + CASE WHEN axis_imbalance > 25 THEN least((axis_imbalance - 25) / 100, 0.2) ELSE 0 END + CASE WHEN max_abs_value > 250 THEN least((max_abs_value - 250) / 250, 0.75) ELSE 0 END
+ CASE WHEN stationary_fraction > 0.98 THEN 0.15 ELSE 0 END), 0), 1) AS quality_score FROM agg)""".replace("list_median(", "list_aggregate(").replace("]) + 1e-6", "], 'median') + 1e-6")


_FIELDS = ["n_samples", "duration_sec", "missing_rate", "nan_fraction", "inf_fraction", "flatline_fraction", "saturation_fraction", "max_abs_value", "extreme_value_fraction", "spike_rate", "high_frequency_energy", "stationary_fraction", "axis_imbalance", "repeated_timestamp_fraction", "timestamp_jitter_fraction", "quality_score"]
_JERK = "sqrt(pow(coalesce(d_{0}_x, 0), 2) + pow(coalesce(d_{0}_y, 0), 2) + pow(coalesce(d_{0}_z, 0), 2)) * 30"
_STEPS = f"steps AS (SELECT *, {_LAGS}, {_ACC} AS acc_norm, {_GYRO} AS gyro_norm FROM {{0}} WINDOW o AS (PARTITION BY clip ORDER BY idx)), inv AS (SELECT *, {_JERK.format('acc')} AS acc_jerk, {_JERK.format('gyro')} AS gyro_jerk FROM steps)"
_AVG30 = {c: f"sum({c}) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30" for c in CHANNELS[:3]}
#: Windows of a width and stride, the last aligned with the end.
_WINDOWS = """sized AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM {source}), starts AS (SELECT clip, unnest(list_sort(list_distinct(list_append(range(0, greatest(n - {w}, 0) + 1, {s}), greatest(n - {w}, 0))))) AS start FROM (SELECT DISTINCT clip, n FROM sized)),
numbered AS (SELECT clip, start, row_number() OVER (PARTITION BY clip ORDER BY start) - 1 AS window_idx FROM starts), win AS (SELECT s.*, window_idx FROM sized s JOIN numbered w ON s.clip = w.clip AND s.idx >= w.start AND s.idx < w.start + {w})"""
_DIMS = f"""WITH {SERIES}, {_WINDOWS.format(source='series', w=100, s=50)}, means AS (SELECT clip, window_idx, {', '.join(f'avg({c}) AS {c}' for c in CHANNELS)} FROM win GROUP BY ALL),
x AS ({' UNION ALL '.join(f'SELECT clip, window_idx, {i} AS dim, {c} AS x FROM means' for i, c in enumerate(CHANNELS))}),
st AS (SELECT *, abs(x - lag(x) OVER o) AS step, ntile(3) OVER o AS part, row_number() OVER o AS nth, count(*) OVER (PARTITION BY clip, dim) AS n FROM x WINDOW o AS (PARTITION BY clip, dim ORDER BY window_idx))"""


def _stacked(stats: list[str]) -> str:
    """Statistic by statistic, six dimensions each, as the vectors are laid out."""
    return " UNION ALL ".join(f"SELECT clip, dim + {6 * i} AS dim, round(coalesce({s}, 0), 6) AS x FROM st GROUP BY clip, dim" for i, s in enumerate(stats))


_ORDER_STATS = [f"{f}(x) FILTER (part = {p})" for p in (1, 2, 3) for f in ("avg", "stddev_pop")]
_CONTEXT = "ctx AS (SELECT seq, pos, token, coalesce(lag(token, 2) OVER o, '<s>') AS a, coalesce(lag(token) OVER o, '<s>') AS b FROM tokens WINDOW o AS (PARTITION BY seq ORDER BY pos))"
_NLL = f"""WITH {TOKENS}, {_CONTEXT}, fit AS (SELECT a, b, token, count(*) AS n FROM ctx WHERE seq % 2 = 0 GROUP BY ALL), tot AS (SELECT a, b, sum(n) AS total FROM fit GROUP BY ALL), kinds AS (SELECT count(DISTINCT token) AS kinds FROM fit),
nll AS (SELECT c.seq, c.pos, c.token, coalesce(n, 0) AS seen, -ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 0.1 * kinds)) AS nll FROM ctx c LEFT JOIN fit USING (a, b, token) LEFT JOIN tot USING (a, b), kinds WHERE c.seq % 2 = 1)"""
_GRAMS = """grams AS (SELECT seq, pos, n, list_slice(ahead, 1, n) AS phrase, before, coalesce(ahead[n + 1], '</s>') AS after FROM
(SELECT seq, pos, coalesce(lag(token) OVER (PARTITION BY seq ORDER BY pos), '<s>') AS before, list(token) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND {most} FOLLOWING) AS ahead FROM tokens), range({least}, {most} + 1) r(n) WHERE n <= len(ahead))"""
_ENT = "SELECT phrase, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT phrase, {0}, count(*) AS c FROM grams GROUP BY ALL) GROUP BY phrase"

ORACLES = {
    "series_quality": f"WITH {SERIES}, {_quality('series')} SELECT clip, {', '.join(f'round({f}, 6) AS {f}' for f in _FIELDS)} FROM quality",
    "series_windows": f"""WITH {SERIES}, norms AS (SELECT clip, idx, {_ACC} AS x FROM series), {_WINDOWS.format(source='norms', w=300, s=150)} SELECT clip, window_idx, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(sqrt(avg(x * x)), 6) AS rms, round(min(x), 6) AS min, round(max(x), 6) AS max,
{', '.join(f'round(quantile_cont(x, {p / 100}), 6) AS p{p}' for p in (5, 25, 50, 75, 95))} FROM win GROUP BY ALL""",
    "series_invariants": f"""WITH {SERIES}, {_STEPS.format('series')}, lin AS (SELECT *, {', '.join(f'{c} - {e} AS l_{c}' for c, e in _AVG30.items())}, median(acc_norm) OVER (PARTITION BY clip) AS m FROM inv)
SELECT clip, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('acc_norm', 'gyro_norm', 'acc_jerk', 'gyro_jerk'))}, round(avg(sqrt(l_acc_x * l_acc_x + l_acc_y * l_acc_y + l_acc_z * l_acc_z)), 6) AS linear_norm, round(avg((abs(acc_norm - m) < 0.05 AND gyro_norm < 0.02)::INT), 6) AS still FROM lin GROUP BY clip""",
    "robust_normalised": f"""WITH {SERIES}, q AS (SELECT clip, {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in CHANNELS)} FROM series GROUP BY clip) SELECT clip, {', '.join(f'round(sum(abs(({c} - q_{c}[2]) / greatest(q_{c}[3] - q_{c}[1], 1e-6))), 4) AS {c}' for c in CHANNELS)} FROM series JOIN q USING (clip) GROUP BY clip""",
    "expanded_channels": f"""WITH {SERIES} SELECT clip, round(avg(acc_y * gyro_z - acc_z * gyro_y), 4) AS cross_x, round(avg(acc_z * gyro_x - acc_x * gyro_z), 4) AS cross_y, round(avg(acc_x * gyro_y - acc_y * gyro_x), 4) AS cross_z,
{', '.join(f'round(max(acc_{a}) - avg(acc_{a}), 4) AS centred_{a}' for a in 'xyz')} FROM series GROUP BY clip""",
    "motion_regimes": f"""WITH {SERIES}, e AS (SELECT clip, avg(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_energy, avg(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) AS gyro_energy FROM series GROUP BY clip), q AS (SELECT quantile_cont(acc_energy, [0.25, 0.75]) AS a, quantile_cont(gyro_energy, [0.25, 0.75]) AS g FROM e)
SELECT clip, round(acc_energy, 4) AS acc_energy, round(gyro_energy, 4) AS gyro_energy, CASE WHEN acc_energy <= a[1] AND gyro_energy <= g[1] THEN 'low_motion' WHEN gyro_energy >= g[2] AND acc_energy < a[2] THEN 'rotation_dominant' WHEN acc_energy >= a[2] THEN 'high_dynamic' ELSE 'mixed' END AS regime FROM e, q""",
    "pooled_windows": f"{_DIMS} {_stacked(['avg(x)', 'stddev_pop(x)'])}",
    "shape_statistics": f"{_DIMS} {_stacked(['avg(x)', 'stddev_pop(x)', 'min(x)', 'max(x)', 'quantile_cont(x, 0.25)', 'quantile_cont(x, 0.75)', 'avg(step)', 'max(step)'])}",
    "temporal_order": f"{_DIMS} {_stacked([*_ORDER_STATS, 'avg(step)', 'max(step)', 'CASE WHEN count(step) > 0 THEN avg(x) FILTER (nth > n - greatest(1, n // 3)) - avg(x) FILTER (nth <= greatest(1, n // 3)) END'])}",
    "autocorrelations": f"""WITH {SERIES}, x AS ({' UNION ALL '.join(f'SELECT clip, idx, {i} AS dim, {c} - avg({c}) OVER (PARTITION BY clip) AS x FROM series' for i, c in enumerate(CHANNELS))}), l AS (SELECT *, lag(x) OVER o AS l1, lag(x, 3) OVER o AS l3, lag(x, 10) OVER o AS l10 FROM x WINDOW o AS (PARTITION BY clip, dim ORDER BY idx))
SELECT clip, dim, {', '.join(f'round(coalesce(sum(x * l{k}) / (sum(x * x) + 1e-12), 0), 6) AS acf_{k}' for k in (1, 3, 10))} FROM l GROUP BY ALL""",
    "multiscale_summary": f"""WITH {SERIES}, x AS ({' UNION ALL '.join(f'SELECT clip, idx, {i} AS dim, {c} AS x FROM series' for i, c in enumerate(CHANNELS))}), l AS (SELECT *, ntile(5) OVER o AS chunk, abs(x - lag(x) OVER o) AS step FROM x WINDOW o AS (PARTITION BY clip, dim ORDER BY idx))
SELECT clip, chunk, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(sqrt(avg(x * x)), 6) AS rms, round(avg(step), 6) AS mean_step FROM l GROUP BY ALL""",
    "token_histogram": f"""WITH {TOKENS}, top AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS place FROM tokens GROUP BY token QUALIFY place < 3), size AS (SELECT seq, count(*) AS n FROM tokens GROUP BY seq), cnt AS (SELECT seq, place, count(*) AS c FROM tokens JOIN top USING (token) GROUP BY ALL)
SELECT seq, place, round(coalesce(c, 0) / n, 6) AS share FROM size CROSS JOIN top LEFT JOIN cnt USING (seq, place)""",
    "token_nll": f"{_NLL} SELECT seq, pos, token, seen, round(nll, 6) AS nll FROM nll",
    "token_surprisal": f"""{_NLL} SELECT seq, count(*) AS n_tokens, round(avg(nll), 6) AS token_nll_mean, round(quantile_cont(nll, 0.9), 6) AS token_nll_p90, round(quantile_cont(nll, 0.95), 6) AS token_nll_p95, round(coalesce(avg(nll) FILTER (pos > 0), 0), 6) AS transition_nll_mean, round(coalesce(quantile_cont(nll, 0.95) FILTER (pos > 0), 0), 6) AS transition_nll_p95,
CASE WHEN count(*) >= 2 THEN 1.0 ELSE 0.0 END AS rare_bigram, round(coalesce(avg((seen <= 1)::INT) FILTER (pos >= 2), 0), 6) AS rare_trigram, round(coalesce(avg((seen <= 1)::INT) FILTER (pos >= 2), 0), 6) AS rare_phrase,
CASE WHEN least(count(*), 5) = 3 THEN CASE WHEN count(*) FILTER (pos >= 2 AND seen = 0) > 0 THEN 3.0 ELSE 2.0 END ELSE least(count(*), 5)::DOUBLE END AS longest_unseen FROM nll GROUP BY seq""",
    "mined_phrases": f"""WITH {TOKENS}, {_GRAMS.format(least=2, most=4)}, c AS (SELECT phrase, count(*) AS count FROM grams GROUP BY phrase HAVING count(*) >= 2), s AS (SELECT phrase, len(phrase) AS n, count, count * len(phrase) * CASE WHEN len(list_distinct(phrase)) > 1 THEN 1.15 ELSE 0.55 END * (1 + l.h + r.h) AS score FROM c JOIN ({_ENT.format('before')}) l USING (phrase) JOIN ({_ENT.format('after')}) r USING (phrase))
SELECT array_to_string(phrase, ' ') AS phrase, n, count, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, n DESC, count DESC, phrase) AS rank FROM s QUALIFY rank <= 100""",
    "phrase_families": f"WITH {TOKENS}, {_GRAMS.format(least=2, most=3)} SELECT array_to_string(phrase, ' ') AS phrase, count(DISTINCT seq) AS support FROM grams GROUP BY phrase HAVING count(DISTINCT seq) >= 3",
    "phrase_holdout": f"""WITH {TOKENS}, k AS (SELECT list(token ORDER BY token) AS k FROM (SELECT DISTINCT token FROM tokens ORDER BY token LIMIT 2)), {_GRAMS.format(least=3, most=3)} SELECT seq, max((phrase = [k[1], k[2], k[1]])::INT) AS label FROM (SELECT DISTINCT seq FROM tokens) LEFT JOIN grams USING (seq), k GROUP BY seq""",
    "code_usage": f"WITH {TOKENS}, p AS (SELECT token, count(*) / sum(count(*)) OVER () AS p FROM tokens GROUP BY token) SELECT round(-sum(p * ln(p + 1e-12)), 6) AS entropy, round(exp(-sum(p * ln(p + 1e-12))), 6) AS perplexity, 8 - count(*) AS dead_codes FROM p",
}
