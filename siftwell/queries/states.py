"""Further queries on series, models and audits, and SQL for queries of other modules that takes more than a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..operators import audits, clusters, learning, metrics, ranking, representations, scores, timeseries, tokens as tk
from ..operators.timeseries import CHANNELS, DERIVED
from .base import CLIPS, SERIES, TOKENS, clips, rounded, series, table, tokens
from .evaluation import _DRAWN, _FACTS, _RANKED, _facts, _ranked
from .evaluation import ORACLES as _EVALUATION
from .greedy_sql import recursion
from .sequences import _ACC, _AVG30, _DIMS, _GYRO, _STEPS, _WINDOWS, _quality
from .sequences import ORACLES as _SEQUENCES


def preprocessed(spark, sf_dir):
    s = timeseries.preprocess(series(spark, sf_dir))
    return rounded(s.groupBy("clip").agg(F.count("*").alias("n"), *[F.sum(F.abs(c)).alias(c) for c in CHANNELS + DERIVED]), 3)


def shard_normalised(spark, sf_dir):
    s = timeseries.shard_normalise(series(spark, sf_dir))
    return rounded(s.groupBy("clip").agg(*[F.sum(F.abs(c)).alias(c) for c in CHANNELS]), 4)


def handcrafted_encoding(spark, sf_dir):
    """Every number of the encoding of the first forty clips, a row each; 360 of 512 are filled."""
    v = representations.handcrafted(series(spark, sf_dir).filter("clip <= 40"))
    return rounded(v.select("clip", F.posexplode("v").alias("dim", "x")), 4)


def short_forecast(spark, sf_dir):
    """Two values before tell the next: a ridge of two features has a closed form."""
    e = learning.forecast_examples(series(spark, sf_dir), "acc_y", 3, 64)
    mse = learning.forecast_mse(e.filter("clip % 2 = 0"), e.filter("clip % 2 = 1"), 2, 5.0)
    return spark.createDataFrame([(round(mse, 4),)], "mse double")


def blended_distances(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(c.select("id", "group_id", scores.blended_distance("quality", "stationary", 0.3, ["group_id"]).alias("score")))


def episode_splits(spark, sf_dir):
    return ranking.episode_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id")))


def source_families(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    marks = F.when(k % 4 == 0, "::x").when(k % 4 == 1, "|y").when(k % 4 == 2, "/z").otherwise("_worker")
    return clusters.source_families(c.select(F.concat(F.lit("fam"), k % 7, F.when(k % 11 > 0, marks).otherwise(""), F.when(k % 11 > 0, k.cast("string")).otherwise("")).alias("group")).distinct(), "group")


def rank_shifts(spark, sf_dir):
    rows = _ranked(spark, sf_dir).filter("group_id = 1")
    return audits.rank_shift(rows.filter("policy = 'quality' and rank <= 30"), rows.filter("policy = 'stationary' and rank <= 30"))


def source_concentration(spark, sf_dir):
    return rounded(audits.source_concentration(_ranked(spark, sf_dir).filter("rank <= 12"), ["policy", "group_id"], "cluster"))


def pairing_audit(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("value", F.when(F.pmod("episode", F.lit(5)) == 0, F.col("value")).otherwise(F.lit(0.25)))
    return rounded(audits.pairing_audit(f, ["episode"], "value"))


def replay_percentiles(spark, sf_dir):
    f = _facts(spark, sf_dir)
    replays = f.filter("policy = 'random'").select("episode", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("r"))
    replays = replays.select("episode", F.concat(F.lit("replay_"), "r").alias("policy"), F.round(stable_random(F.lit("replay"), F.col("r"), F.col("episode")), 2).alias("value"))
    return rounded(metrics.replay_percentile(f.select("episode", "policy", "value").unionByName(replays), "policy", "value", ["episode"], "replay_"))


def gate_verdict(spark, sf_dir):
    return audits.verdict(audits.decision_gates(_facts(spark, sf_dir), "episode", "policy", "value", "novelty", "random", "oracle"))


def duplicate_fractions(spark, sf_dir):
    """The share of repeated event types in each user's events, as sequences of one-token phrases."""
    return rounded(tk.duplicate_fraction(tokens(spark, sf_dir).select("seq", F.col("token").alias("phrase"))))


def ridge_classes(spark, sf_dir):
    """A class for each third of quantities, told by one feature."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.floor(F.col("l_quantity") / 17).cast("int").alias("y"))
    models = learning.ridge_classes(rows, ["x"], "y", 2.0)
    out = rows.select("x").distinct()
    return rounded(out.select("x", *[m.score().alias(f"score_{k}") for k, m in sorted(models.items())]), 4)


_ALL = (preprocessed, handcrafted_encoding, short_forecast, shard_normalised, blended_distances, episode_splits, source_families, rank_shifts, source_concentration, pairing_audit, replay_percentiles, gate_verdict, duplicate_fractions, ridge_classes)
QUERIES = {f.__name__: f for f in _ALL}

_H = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
_INV = f"{_STEPS.format('series')}, lin AS (SELECT *, {', '.join(f'{c} - {e} AS l_{c}' for c, e in _AVG30.items())}, median(acc_norm) OVER (PARTITION BY clip) AS m FROM inv), all12 AS (SELECT *, sqrt(l_acc_x * l_acc_x + l_acc_y * l_acc_y + l_acc_z * l_acc_z) AS linear_norm, (abs(acc_norm - m) < 0.05 AND gyro_norm < 0.02)::INT::DOUBLE AS still FROM lin)"
_SCALED = "series AS (SELECT * REPLACE (acc_x / 10 AS acc_x, acc_y / 10 AS acc_y, gyro_z / 100 AS gyro_z) FROM raw_series)"
_FLAGS = [
    ("low_quality_score", "quality_score < 0.85"), ("mostly_stationary", "stationary_fraction > 0.9"), ("physical_abs_value_outlier", "max_abs_value > 60"), ("spiky_or_extreme", "spike_rate > 0.02 OR extreme_value_fraction > 0"), ("flatline_or_missing", "flatline_fraction > 0.2 OR missing_rate > 0"),
    ("axis_imbalance", "axis_imbalance > 25"), ("timestamp_irregularity", "timestamp_jitter_fraction > 0.1 OR repeated_timestamp_fraction > 0.01"), ("low_motion_energy", "gyro_p95 < 0.02 AND accj_p95 < 1"), ("high_jerk", "gyroj_p95 > 25 OR accj_p95 > 250"),
]
_GATES = f"""{_FACTS}, {_DRAWN.format(n=201)}, w AS (SELECT episode, max(value) FILTER (policy = 'novelty') AS p, max(value) FILTER (policy = 'random') AS b, max(value) FILTER (policy = 'oracle') AS o FROM facts GROUP BY episode),
measured AS (SELECT 'episodes' AS gate, count(*)::DOUBLE AS measured, 20 AS lim FROM w UNION ALL SELECT 'interval', (SELECT quantile_cont(m, 0.025) FROM m WHERE policy = 'novelty'), 0.04 UNION ALL SELECT 'headroom', (SELECT avg((o - b > 0)::INT) FROM w), 0.7 UNION ALL SELECT 'wins', (SELECT avg((p > b)::INT) FROM w), 0.7)"""
_CHANGES = {
    "flatline": "first_value({c}) OVER (PARTITION BY clip ORDER BY idx)",
    "spike": "CASE WHEN {at} < 0.02 THEN {c} + CASE WHEN {d} < 0.5 THEN -500 ELSE 500 END ELSE {c} END",
    "saturation": "CASE WHEN {c} < 0 THEN -300.0 ELSE 300.0 END",
    "noise": "{c} + stddev_pop({c}) OVER (PARTITION BY clip) * ({d} + {e} - 1) * 2",
    "jitter": "{c}",
}


def _draw(name: str) -> str:
    return f"({_H.format(chr(39) + '0:' + name.replace(chr(39), chr(39) * 2) + ':' + chr(39) + ' || clip || ' + chr(39) + ':' + chr(39) + ' || idx')} / 281474976710655.0)"


def _corrupted() -> str:
    parts = []
    for mode, change in _CHANGES.items():
        columns = [f"({change.format(c=c, at=_draw('at'), d=_draw(c), e=_draw(c + chr(39)))})::DOUBLE AS {c}" for c in CHANNELS]
        ts = f"ts + ({_draw('ts')} - 0.5) / 10" if mode == "jitter" else "ts"
        inner = _quality("bad").replace("bad", f"bad_{mode}")
        parts.append(f"SELECT clip, '{mode}' AS mode, round(quality_score, 6) AS quality_score FROM (WITH bad_{mode} AS (SELECT clip, idx, {ts} AS ts, {', '.join(columns)} FROM series), {inner} SELECT * FROM quality)")
    return f"WITH {SERIES.replace('series AS (', 'series AS MATERIALIZED (', 1)} " + " UNION ALL ".join(parts)


def _far(order: str) -> str:
    return f"row_number() OVER (PARTITION BY episode_id ORDER BY d {order}, b)"


_EPISODES = f"""WITH {CLIPS}, g AS (SELECT id % 20 AS g, i, avg(x) AS x FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips) GROUP BY ALL), c AS (SELECT g, list(x ORDER BY i) AS v FROM g GROUP BY g),
d AS (SELECT a.g AS a, b.g AS b, greatest(1 - list_cosine_similarity(a.v, b.v), 0) AS d FROM c a JOIN c b ON a.g <> b.g), t AS (SELECT a AS target, row_number() OVER (ORDER BY avg(d) DESC, a) - 1 AS episode_id FROM d GROUP BY a QUALIFY episode_id < 3),
n AS (SELECT episode_id, b, {_far('ASC')} AS near, {_far('DESC')} AS far FROM d JOIN t ON a = target)
SELECT episode_id, b AS "group", CASE WHEN near <= 6 THEN 'candidate' ELSE 'support' END AS role, 'near' AS kind FROM n UNION ALL SELECT episode_id, b, CASE WHEN near <= 3 OR far <= 3 THEN 'candidate' ELSE 'support' END, 'mixed' FROM n
UNION ALL SELECT episode_id, target, 'target', kind FROM t, (VALUES ('near'), ('mixed')) k(kind)"""

_POWER = "pow(sum(y * cos(2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(y * sin(2 * pi() * ((k * i) % n) / n)), 2)"


def _raw_shape() -> str:
    """Levels, steps, shares of power in bands, autocorrelations and axis shares, six channels each."""
    level = ["avg(x)", "stddev_pop(x)", "min(x)", "max(x)", "quantile_cont(x, 0.25)", "quantile_cont(x, 0.75)", "avg(x * x)", "avg(abs(d))", "stddev_pop(d)", "max(abs(d))", "quantile_cont(abs(d), 0.95)", "avg(d * d)"]
    bands = [(0, 0.5), (0.5, 2), (2, 5), (5, 15.000001)]
    parts = [f"SELECT clip, {6 * j} + c AS dim, {e} AS x FROM d GROUP BY clip, c" for j, e in enumerate(level)]
    parts += [f"SELECT clip, {72 + 6 * j} + c, coalesce(sum(p) FILTER (f >= {a} AND f < {b}), 0) / (sum(p) + 1e-12) FROM f GROUP BY clip, c" for j, (a, b) in enumerate(bands)]
    parts += [f"SELECT clip, {96 + 6 * j} + c, coalesce(sum(y * l{k}), 0) / (sum(y * y) + 1e-12) FROM l GROUP BY clip, c" for j, k in enumerate((1, 3, 10))]
    parts.append("SELECT clip, 114 + c, e / sum(e) OVER (PARTITION BY clip, c // 3) FROM (SELECT clip, c, avg(x * x) AS e FROM d GROUP BY clip, c)")
    return f"""WITH {SERIES}, x AS (SELECT clip, idx AS i, unnest([0, 1, 2, 3, 4, 5]) AS c, unnest([{', '.join(CHANNELS)}]) AS x FROM series), d AS MATERIALIZED (SELECT *, x - lag(x) OVER (PARTITION BY clip, c ORDER BY i) AS d, x - avg(x) OVER (PARTITION BY clip, c) AS y, count(*) OVER (PARTITION BY clip, c) AS n FROM x),
f AS MATERIALIZED (SELECT clip, c, k, k * (1.0::DOUBLE / (any_value(n) * (1.0::DOUBLE / 30))) AS f, {_POWER} AS p FROM d, range(0, 400) t(k) WHERE k <= n // 2 GROUP BY clip, c, k), l AS MATERIALIZED (SELECT clip, c, y, {', '.join(f'lag(y, {k}) OVER (PARTITION BY clip, c ORDER BY i) AS l{k}' for k in (1, 3, 10))} FROM d)
SELECT clip, dim, round(x + 1e-9, 6) AS x FROM ({' UNION ALL '.join(parts)})"""


def _encoded() -> str:
    """The twelve channels over a clip and its quarters: six statistics of each part, channel by channel, and zeros up to 512."""
    channels = CHANNELS + DERIVED
    stats = ["avg(x)", "stddev_pop(x)", *[f"quantile_cont(x, {p})" for p in (0.1, 0.5, 0.9)]]
    values = ", ".join(f"({c} - q_{c}[2]) / greatest(q_{c}[3] - q_{c}[1], 1e-6)" for c in channels)
    return f"""WITH {SERIES.replace('FROM lineitem', 'FROM lineitem WHERE l_suppkey <= 40')}, {_INV}, q AS (SELECT clip, {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in channels)} FROM all12 GROUP BY clip),
x AS (SELECT clip, idx, unnest(range(0, 12)) AS c, unnest([{values}]) AS x FROM all12 JOIN q USING (clip)), h AS (SELECT *, ntile(4) OVER (PARTITION BY clip, c ORDER BY idx) AS part FROM x),
s AS (SELECT clip, idx, c, x, 0 AS part FROM x UNION ALL SELECT clip, idx, c, x, part FROM h), y AS MATERIALIZED (SELECT *, x - avg(x) OVER g AS y, count(*) OVER g AS n, row_number() OVER (PARTITION BY clip, c, part ORDER BY idx) - 1 AS i FROM s WINDOW g AS (PARTITION BY clip, c, part)),
f AS MATERIALIZED (SELECT clip, c, part, k, {_POWER} AS p FROM y, range(0, 400) t(k) WHERE k <= n // 2 GROUP BY clip, c, part, k), e AS (SELECT clip, c, part, p / (sum(p) OVER g + 1e-12) AS p, count(*) OVER g AS m FROM f WINDOW g AS (PARTITION BY clip, c, part)),
v AS ({' UNION ALL '.join(f'SELECT clip, part * 72 + {12 * j} + c AS dim, {e} AS x FROM y GROUP BY clip, c, part' for j, e in enumerate(stats))} UNION ALL SELECT clip, part * 72 + 60 + c, -sum(p * ln(p + 1e-12)) / ln(any_value(m)) FROM e GROUP BY clip, c, part)
SELECT clip, dim, round(x, 4) AS x FROM v UNION ALL SELECT DISTINCT clip, dim, 0 FROM series, range(360, 512) t(dim)"""


def _features() -> str:
    """Distribution and spectrum of four signals of each window, by sums of sines and cosines, and its context."""
    jerk = lambda a: f"sqrt(pow({a}_x - lag({a}_x) OVER o, 2) + pow({a}_y - lag({a}_y) OVER o, 2) + pow({a}_z - lag({a}_z) OVER o, 2)) * 30"
    shape = ["avg(x)", "stddev_pop(x)", "sqrt(avg(x * x))", "min(x)", "max(x)", *[f"quantile_cont(x, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95)]]
    bands = ["total / n", "top", "share", "entropy", "centre", "spread", "low", "1 - low"]
    lean = lambda a: "greatest({0}) / (list_aggregate([{0}], 'median') + 1e-6)".format(", ".join(f"stddev_pop({a}_{c})" for c in "xyz"))
    return f"""WITH {SERIES}, {_WINDOWS.format(source='series', w=300, s=150)}, w AS MATERIALIZED (SELECT *, {_ACC} AS s0, {_GYRO} AS s1, {jerk('acc')} AS s2, {jerk('gyro')} AS s3, row_number() OVER o - 1 AS i FROM win WINDOW o AS (PARTITION BY clip, window_idx ORDER BY idx)),
sig AS MATERIALIZED (SELECT clip, window_idx, s, i - (s // 2) AS i, x FROM (SELECT clip, window_idx, i, unnest([0, 1, 2, 3]) AS s, unnest([s0, s1, s2, s3]) AS x FROM w) WHERE x IS NOT NULL),
c AS MATERIALIZED (SELECT *, x - avg(x) OVER g AS y, count(*) OVER g AS n FROM sig WINDOW g AS (PARTITION BY clip, window_idx, s)),
f AS MATERIALIZED (SELECT clip, window_idx, s, k, any_value(n) AS n, k * 30.0 / any_value(n) AS f, pow(sum(y * cos(2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(y * sin(2 * pi() * ((k * i) % n) / n)), 2) AS p FROM c, range(1, 151) t(k) WHERE k <= n // 2 GROUP BY clip, window_idx, s, k),
p AS (SELECT *, sum(p) OVER g AS total, p / sum(p) OVER g AS q, count(*) OVER g AS m FROM f WINDOW g AS (PARTITION BY clip, window_idx, s)), q AS (SELECT *, sum(f * q) OVER (PARTITION BY clip, window_idx, s) AS centre FROM p),
b AS (SELECT clip, window_idx, s, any_value(total) AS total, any_value(n) AS n, arg_max(f, q) AS top, max(q) AS share, -sum(q * ln(q + 1e-12)) / ln(any_value(m) + 1e-12) AS entropy, any_value(centre) AS centre, sqrt(sum(pow(f - centre, 2) * q)) AS spread, coalesce(sum(q) FILTER (f < 1), 0) AS low FROM q GROUP BY clip, window_idx, s),
x AS (SELECT clip, window_idx, s * 18 + unnest(range(0, 10)) AS dim, unnest([{', '.join(shape)}]) AS x FROM sig GROUP BY clip, window_idx, s UNION ALL SELECT clip, window_idx, s * 18 + 10 + unnest(range(0, 8)), unnest(CASE WHEN total > 1e-12 THEN [{', '.join(bands)}] ELSE [0, 0, 0, 0, 0, 0, 0, 0] END) FROM b
UNION ALL SELECT clip, window_idx, 72 + unnest(range(0, 3)), unnest([avg((abs(s0 - md) < 0.05 AND s1 < 0.02)::INT), {lean('acc')}, {lean('gyro')}]) FROM (SELECT *, median(s0) OVER (PARTITION BY clip, window_idx) AS md FROM w) GROUP BY clip, window_idx) SELECT clip, window_idx, dim, round(x, 4) AS x FROM x"""


#: Lags of a centred signal from 0.35 to 3 seconds at 30 samples a second.
_PERIOD = f"""WITH {SERIES}, n AS (SELECT clip, idx, {_ACC} AS x FROM series), c AS (SELECT clip, idx, x - avg(x) OVER (PARTITION BY clip) AS x, count(*) OVER (PARTITION BY clip) AS n FROM n),
e AS (SELECT clip, sum(x * x) AS e, any_value(n) AS n FROM c GROUP BY clip), l AS (SELECT a.clip, k, sum(a.x * b.x) AS s FROM c a CROSS JOIN range(10, 91) t(k) JOIN c b ON b.clip = a.clip AND b.idx = a.idx + k WHERE k <= a.n - 1 GROUP BY a.clip, k),
m AS (SELECT clip, arg_max(k, (round(s, 9), -k)) AS k, max(s) AS s FROM l GROUP BY clip) SELECT clip, round(CASE WHEN e.n >= 120 AND sqrt(e) > 1e-8 THEN k / 30 ELSE 0 END, 6) AS period_sec, round(CASE WHEN e.n >= 120 AND sqrt(e) > 1e-8 THEN s / e ELSE 0 END, 6) AS strength FROM e JOIN m USING (clip)"""

_ENCODED = f"""WITH RECURSIVE {TOKENS}, ph AS MATERIALIZED (SELECT phrase FROM ({_SEQUENCES['mined_phrases']}) WHERE rank <= 50),
sq AS MATERIALIZED (SELECT seq, list(token ORDER BY pos) AS t FROM tokens GROUP BY seq),
cut AS (SELECT seq, 0 AS pos, NULL::VARCHAR[] AS phrase, 0 AS nxt FROM sq UNION ALL SELECT seq, nxt, p, nxt + len(p) FROM (SELECT c.seq, c.nxt, coalesce(max_by(p.ph, len(p.ph)), [any_value(t[nxt + 1])]) AS p
FROM cut c JOIN sq USING (seq) LEFT JOIN (SELECT string_split(phrase, ' ') AS ph FROM ph) p ON list_slice(t, nxt + 1, nxt + len(p.ph)) = p.ph WHERE nxt < len(t) GROUP BY c.seq, c.nxt))
SELECT seq, pos, array_to_string(phrase, ' ') AS phrase FROM cut WHERE phrase IS NOT NULL"""

_CODES = f"""{_DIMS}, wv AS MATERIALIZED (SELECT clip, window_idx, list(x ORDER BY dim) AS f FROM x GROUP BY ALL), nn AS (SELECT clip, count(*) AS n FROM wv GROUP BY clip),
stt AS (SELECT clip, n, unnest(list_sort(list_distinct(list_append(range(0, greatest(n - 2, 0) + 1, 2), greatest(n - 2, 0))))) AS start FROM nn), pn AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY start) - 1 AS patch_idx FROM stt),
pv AS MATERIALIZED (SELECT p.clip, patch_idx, list_concat(a.f, coalesce(b.f, a.f)) AS v FROM pn p JOIN wv a ON a.clip = p.clip AND a.window_idx = start LEFT JOIN wv b ON b.clip = p.clip AND b.window_idx = start + 1)
SELECT p.clip, p.patch_idx, arg_min(k.clip::INT, (round(list_distance(p.v, k.v), 9), k.clip)) AS code FROM pv p, pv k WHERE k.clip <= 4 AND k.patch_idx = 0 GROUP BY p.clip, p.patch_idx"""

_LLOYD_STEP = """a{i} AS MATERIALIZED (SELECT id, v, arg_min(code, (d, code)) AS code FROM (SELECT c.id, c.v, m.code, list_distance(c.v, m.v) AS d FROM clips c, m{i} m) GROUP BY ALL),
m{j} AS MATERIALIZED (SELECT m.code, coalesce(n.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT code, list(x ORDER BY i) AS v FROM (SELECT code, i, avg(x) AS x FROM (SELECT code, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY code) n USING (code))"""
_KMEANS = (
    f"WITH {CLIPS}, m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {_H.format(chr(39) + '13:' + chr(39) + ' || id')}, id) - 1 AS code, v FROM clips QUALIFY code < 4), "
    + ", ".join(_LLOYD_STEP.format(i=i, j=i + 1) for i in range(5))
    + " SELECT id, arg_min(code, (d, code))::INT AS code, round(min(d), 6) AS distance FROM (SELECT c.id, m.code, list_distance(c.v, m.v) AS d FROM clips c, m5 m) GROUP BY id"
)
_FEATURES = ["stationary", "max_abs", "token_nll_p95"]
_LINEAR = f"""WITH {CLIPS}, l AS (SELECT *, quality > 0.5 AS y FROM clips), s AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}, avg({f}) FILTER (y) AS p_{f}, avg({f}) FILTER (NOT y) AS n_{f}' for f in _FEATURES)} FROM l),
w AS (SELECT id, {' + '.join(f'(p_{f} - n_{f}) / s_{f} * (({f} - m_{f}) / s_{f} - ((p_{f} - m_{f}) / s_{f} + (n_{f} - m_{f}) / s_{f}) / 2)' for f in _FEATURES)} AS score FROM l, s) SELECT id, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS probability FROM w"""

#: Two source-blocked episodes over 25 groups, three orders of the gated candidates, and the targets' distance to each prefix.
_BENCHMARK = f"""WITH RECURSIVE {CLIPS}, e AS (SELECT e.e AS batch, g.g, (g.g - e.e * 4) % 25 AS t FROM range(0, 25) g(g), range(0, 2) e(e)), mem AS (SELECT batch, g, CASE WHEN (t + 25) % 25 < 4 THEN 'target' WHEN (t + 25) % 25 < 12 THEN 'candidate' ELSE 'support' END AS part FROM e),
pl AS MATERIALIZED (SELECT batch, part, c.* FROM clips c JOIN mem ON g = c.id % 25), gap AS (SELECT a.batch, a.id, min(1 - list_cosine_similarity(a.v, b.v)) AS gap FROM pl a JOIN pl b USING (batch) WHERE a.part <> 'support' AND b.part = 'support' GROUP BY ALL),
cand AS MATERIALIZED (SELECT batch, id, v, 0 AS score, 0 AS cluster, quality, gap, 0 AS gap_w, TRUE AS ok FROM pl JOIN gap USING (batch, id) WHERE part = 'candidate' AND quality >= 0.3 AND artifact <= 0.09),
sims AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM cand a JOIN cand b ON a.batch = b.batch), {recursion('least(c.gap, coalesce(1 - max(s.s), 9))', 'value DESC, quality DESC, id', 'TRUE', '10')},
ord AS (SELECT batch, id, step AS rank, 'kcenter_quality_gated' AS policy FROM pick WHERE step > 0 UNION ALL SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY quality DESC, id), 'quality_only' FROM cand UNION ALL SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY {_H.format("'random:' || id")}, id), 'random_valid' FROM cand),
ch AS (SELECT batch, policy, budget, id FROM ord, (VALUES (5), (10)) b(budget) WHERE rank <= budget), n AS (SELECT batch, policy, budget, count(*) AS n FROM ch GROUP BY ALL),
tg AS (SELECT ch.batch, policy, budget, t.id, any_value(gap.gap) AS old, least(any_value(gap.gap), min(1 - list_cosine_similarity(t.v, c.v))) AS new FROM ch JOIN cand c USING (batch, id) JOIN pl t ON t.batch = ch.batch AND t.part = 'target' JOIN gap ON gap.batch = t.batch AND gap.id = t.id GROUP BY ch.batch, policy, budget, t.id)
SELECT batch AS episode_id, policy, budget, any_value(n)::INT AS n_selected, any_value(n) < budget AS underfilled, round(avg(old), 6) AS mean_before, round(avg(new), 6) AS mean_after, round(avg(greatest((old - new) / greatest(old, 1e-12), 0)), 6) AS relative_gain FROM tg JOIN n USING (batch, policy, budget) GROUP BY batch, policy, budget"""

_FORECAST = f"""WITH e AS ({_EVALUATION['forecast_examples']}), s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my FROM e WHERE clip % 2 = 0),
z AS (SELECT clip, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, y - my AS y FROM e, s), g AS (SELECT sum(a * a) + 5 AS aa, sum(a * b) AS ab, sum(b * b) + 5 AS bb, sum(a * y) AS ay, sum(b * y) AS b_y FROM z WHERE clip % 2 = 0),
w AS (SELECT (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS u, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM g) SELECT round(avg(pow(y - u * a - v * b, 2)), 4) AS mse FROM z, w WHERE clip % 2 = 1"""

ORACLES = {
    "short_forecast": _FORECAST,
    "preprocessed": f"""WITH {SERIES}, {_INV}, q AS (SELECT clip, {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}' for c in CHANNELS + DERIVED)} FROM all12 GROUP BY clip) SELECT clip, count(*) AS n, {', '.join(f'round(sum(abs(({c} - q_{c}[2]) / greatest(q_{c}[3] - q_{c}[1], 1e-6))), 3) AS {c}' for c in CHANNELS + DERIVED)} FROM all12 JOIN q USING (clip) GROUP BY clip""",
    "shard_normalised": f"""WITH {SERIES}, x AS ({' UNION ALL '.join(f'SELECT clip, {c} AS x FROM series' for c in CHANNELS)}), m AS (SELECT clip, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS s FROM x GROUP BY clip) SELECT clip, {', '.join(f'round(sum(abs(({c} - m) / s)), 4) AS {c}' for c in CHANNELS)} FROM series JOIN m USING (clip) GROUP BY clip""",
    "blended_distances": f"""WITH {CLIPS} SELECT id, group_id, round(0.3 * (quality - min(quality) OVER w) / (max(quality) OVER w - min(quality) OVER w) + 0.7 * (stationary - min(stationary) OVER w) / (max(stationary) OVER w - min(stationary) OVER w), 6) AS score FROM clips WINDOW w AS (PARTITION BY group_id)""",
    "episode_splits": """WITH c AS (SELECT c_custkey AS episode_id, row_number() OVER (ORDER BY c_custkey) AS seat, count(*) OVER () AS n FROM customer) SELECT episode_id, CASE WHEN seat <= floor(n * 0.75) THEN 'train' WHEN seat <= floor(n * 0.75) + floor(n * 0.125) THEN 'validation' ELSE 'test' END AS split FROM c""",
    "source_families": """SELECT DISTINCT 'fam' || c_custkey % 7 || CASE WHEN c_custkey % 11 > 0 THEN ['::x', '|y', '/z', '_worker'][c_custkey % 4 + 1] || c_custkey ELSE '' END AS "group", 'fam' || c_custkey % 7 AS family FROM customer""",
    "rank_shifts": f"WITH {CLIPS}, {_RANKED}, a AS (SELECT id, rank FROM ranked WHERE group_id = 1 AND policy = 'quality' AND rank <= 30), b AS (SELECT id, rank FROM ranked WHERE group_id = 1 AND policy = 'stationary' AND rank <= 30) SELECT id, a.rank AS from_rank, b.rank AS to_rank, a.rank - b.rank AS shift FROM a FULL JOIN b USING (id)",
    "source_concentration": f"WITH {CLIPS}, {_RANKED}, n AS (SELECT policy, group_id, cluster, count(*) AS n FROM ranked WHERE rank <= 12 GROUP BY ALL) SELECT policy, group_id, round(max(n) / sum(n), 6) AS largest_share, count(*) AS groups FROM n GROUP BY ALL",
    "pairing_audit": f"WITH {_FACTS} SELECT episode, round(max(v) - min(v), 6) AS spread, max(v) - min(v) <= 1e-9 AS paired FROM (SELECT episode, CASE WHEN episode % 5 = 0 THEN value ELSE 0.25 END AS v FROM facts) GROUP BY episode",
    "replay_percentiles": f"""WITH {_FACTS}, r AS (SELECT episode, round({_H.format("'replay:' || r || ':' || episode")} / 281474976710655.0, 2) AS v FROM facts, range(1, 21) t(r) WHERE policy = 'random') SELECT f.episode, f.policy, round(f.value, 6) AS value, round(avg((v <= f.value)::INT), 6) AS percentile, round((1 + count(*) FILTER (v >= f.value)) / (1 + count(*)), 6) AS p FROM facts f JOIN r USING (episode) GROUP BY f.episode, f.policy, f.value""",
    "gate_verdict": f"WITH {_GATES} SELECT CASE count(*) FILTER (measured < lim) WHEN 0 THEN 'pass' WHEN 1 THEN 'conditional' ELSE 'fail' END AS decision, count(*) FILTER (measured < lim) AS failed FROM measured",
    "duplicate_fractions": f"WITH {TOKENS} SELECT seq, round(1 - count(DISTINCT token) / count(*), 6) AS duplicate_fraction FROM tokens GROUP BY seq",
    "ridge_classes": """WITH r AS (SELECT l_extendedprice AS x, floor(l_quantity / 17)::INT AS y FROM lineitem), s AS (SELECT avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM r),
b AS (SELECT k, sum((x - m) / s * ((y = k)::INT - (SELECT avg((y = k)::INT) FROM r))) / (any_value(n) + 2) AS w, avg((y = k)::INT) AS c FROM r, s, (VALUES (0), (1), (2)) t(k) GROUP BY k)
SELECT x, round(max(c + w * (x - m) / s) FILTER (k = 0), 4) AS score_0, round(max(c + w * (x - m) / s) FILTER (k = 1), 4) AS score_1, round(max(c + w * (x - m) / s) FILTER (k = 2), 4) AS score_2 FROM (SELECT DISTINCT x FROM r), s, b GROUP BY x""",
    # queries of other modules
    "decision_gates": f"WITH {_GATES} SELECT gate, measured >= lim AS passed, round(measured, 6) AS measured FROM measured",
    "corrupted_quality": _corrupted(),
    "trace_verdicts": f"""WITH {SERIES.replace('series AS', 'raw_series AS', 1)}, {_SCALED}, {_quality('series')}, st2 AS (SELECT * FROM ({f"WITH {_STEPS.format('series')} SELECT clip, quantile_cont(gyro_norm, 0.95) AS gyro_p95, quantile_cont(acc_jerk, 0.95) AS accj_p95, quantile_cont(gyro_jerk, 0.95) AS gyroj_p95 FROM inv GROUP BY clip"})),
f AS (SELECT clip, list_filter([{', '.join(f"CASE WHEN {on} THEN '{name}' END" for name, on in _FLAGS)}], lambda x: x IS NOT NULL) AS f FROM quality JOIN st2 USING (clip))
SELECT clip, CASE WHEN len(f) = 0 THEN 'clean_motion' ELSE array_to_string(f, ',') END AS flags, CASE WHEN list_has_any(f, ['low_quality_score', 'physical_abs_value_outlier', 'spiky_or_extreme', 'flatline_or_missing', 'axis_imbalance', 'timestamp_irregularity']) THEN 'likely_artifact' WHEN list_has_any(f, ['mostly_stationary', 'low_motion_energy']) THEN 'mostly_stationary' ELSE 'plausible_motion' END AS verdict FROM f""",
    "periodicity": _PERIOD,
    "window_features": _features(),
    "raw_shape": _raw_shape(),
    "handcrafted_encoding": _encoded(),
    "encoded_phrases": _ENCODED,
    "coverage_benchmark": _BENCHMARK,
    "difficulty_episodes": _EPISODES,
    "patch_codes": _CODES,
    "vector_codes": _KMEANS,
    "centroid_ranker": _LINEAR,
}
