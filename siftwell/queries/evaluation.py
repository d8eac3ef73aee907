"""Queries on clusters, metrics, episodes, learning and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..operators import audits, clusters, episodes, learning, metrics, neighbors, ranking, representations
from .base import CLIPS, SERIES, candidates, clips, rounded, series, table

POLICIES = ["novelty", "quality", "random", "oracle"]


def similarity_components(spark, sf_dir):
    return clusters.components(clips(spark, sf_dir).select("id", "v"), 0.42)


def cluster_medoids(spark, sf_dir):
    out = clusters.medoids(clips(spark, sf_dir).select("id", "v", F.col("group_id").alias("cluster")))
    return rounded(out.select("id", "cluster", "medoid_id", "medoid_distance"))


def split_clusters(spark, sf_dir):
    rows = clips(spark, sf_dir).select("id", F.col("group_id").cast("long").alias("cluster"), "v")
    return clusters.split_large(rows, 40, 20)


def round_robin_split(spark, sf_dir):
    rows = clips(spark, sf_dir).select("id", F.col("group_id").alias("cluster"), "quality")
    return clusters.round_robin_split(rows, 3, [F.desc("quality"), F.asc("id")]).select("id", "cluster", "child")


def vector_codes(spark, sf_dir):
    return rounded(clusters.kmeans(clips(spark, sf_dir).select("id", "v"), 4, 5)[0])


def group_centroids(spark, sf_dir):
    out = representations.centroids(clips(spark, sf_dir), "group_id")
    return rounded(out.select("group_id", "n", F.posexplode("v").alias("dim", "x")))


def _ranked(spark, sf_dir):
    """Every clip's place in its group by each of three policies."""
    c = clips(spark, sf_dir).select("id", "group_id", "quality", "stationary", "artifact", F.floor(F.col("stationary") * 3).cast("int").alias("label"), F.pmod("id", F.lit(7)).alias("cluster"), (F.col("artifact") > 0.08).alias("corrupted"))
    by = {"quality": [F.desc("quality")], "stationary": [F.desc("stationary")], "random": [stable_random(F.lit("p"), F.col("id"))]}
    parts = [ranking.ranked(c, *o, F.asc("id"), by=["group_id"]).withColumn("policy", F.lit(k)) for k, o in by.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ranking_metrics(spark, sf_dir):
    return rounded(metrics.ranking_metrics(_ranked(spark, sf_dir), 10, ["policy", "group_id"]))


def top_overlap(spark, sf_dir):
    return rounded(metrics.top_overlap(_ranked(spark, sf_dir), "policy", ["group_id"], 10))


def rank_correlations(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("x", F.round("quality", 1)).withColumn("y", F.round("stationary", 1))
    return rounded(metrics.correlations(rows, "x", "y", ["group_id"]))


def _facts(spark, sf_dir):
    """A made-up gain of each policy in each episode (a customer's first orders)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("k"))
    e = o.groupBy("episode").agg(F.min("k").alias("k"))
    p = e.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))
    draw = stable_random(F.col("policy"), F.col("episode"))
    return p.withColumn("value", F.when(F.col("policy") == "oracle", 0.5 + draw).otherwise(F.round(draw, 2)))


def paired_deltas(spark, sf_dir):
    return rounded(metrics.paired_deltas(_facts(spark, sf_dir), "policy", "value", ["episode"], "random"))


def policy_summary(spark, sf_dir):
    return rounded(metrics.policy_summary(_facts(spark, sf_dir), "policy", "value", ["episode"]))


def oracle_fractions(spark, sf_dir):
    out = metrics.oracle_fraction(_facts(spark, sf_dir), "policy", "value", ["episode"], "oracle")
    return rounded(out.groupBy("policy").agg(F.avg("fraction").alias("fraction"), F.min("fraction").alias("least")))


def bootstrap_intervals(spark, sf_dir):
    return rounded(metrics.bootstrap_interval(_facts(spark, sf_dir), ["policy"], "episode", "value", 50))


def leave_one_out(spark, sf_dir):
    out = metrics.leave_one_out(_facts(spark, sf_dir), ["policy"], "value")
    return rounded(out.select("policy", "episode", "without", "contribution"))


def group_gini(spark, sf_dir):
    return rounded(metrics.gini(clips(spark, sf_dir), "quality", ["group_id"]))


def numeric_summaries(spark, sf_dir):
    return rounded(metrics.numeric_summary(table(spark, sf_dir, "events"), "value", ["event_type"]))


def consensus_ranking(spark, sf_dir):
    runs = _ranked(spark, sf_dir).select(F.col("policy").alias("run"), "id", "rank", F.col("quality").alias("score"))
    return rounded(metrics.consensus(runs))


def selection_summaries(spark, sf_dir):
    return rounded(metrics.selection_summary(_ranked(spark, sf_dir), ["policy"], [5, 20]))


def centroid_ranker(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("label", (F.col("quality") > 0.5).cast("int"))
    model = learning.fit_centroid_ranker(rows, ["stationary", "max_abs", "token_nll_p95"], "label")
    return rounded(rows.select("id", model.score().alias("score"), model.probability().alias("probability")))


def ridge_line(spark, sf_dir):
    """Price by quantity: one feature, so that the fit has a closed form."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"))
    model = learning.fit_ridge(rows, ["x"], "y", 1.0)
    return rounded(rows.select("x", model.score().alias("fitted")).distinct(), 3)


def nearest_centroid(spark, sf_dir):
    c = clips(spark, sf_dir).select("role", F.col("group_id").alias("label"), "v")
    return rounded(learning.nearest_centroid_metrics(c.filter("role = 'support'"), c.filter("role = 'target'")))


def forecast_examples(spark, sf_dir):
    out = learning.forecast_examples(series(spark, sf_dir), "acc_y", 3, 64)
    return rounded(out)


def forecast_error(spark, sf_dir):
    e = learning.forecast_examples(series(spark, sf_dir), "acc_y")
    mse = learning.forecast_mse(e.filter("clip % 2 = 0"), e.filter("clip % 2 = 1"))
    return spark.createDataFrame([(round(mse, 6),)], "mse double")


def representation_ranks(spark, sf_dir):
    c = clips(spark, sf_dir)
    return spark.createDataFrame([(learning.effective_rank(c), learning.pca_error(c.filter("role = 'support'"), c.filter("role = 'target'")))], "effective_rank double, pca_error double")


def _groups(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group"), F.col("s_nationkey").alias("family"))


def source_blocked_episodes(spark, sf_dir):
    return episodes.source_blocked(_groups(spark, sf_dir), 4, 5, 10)


def random_episodes(spark, sf_dir):
    return episodes.random_episodes(_groups(spark, sf_dir), 3, 5, 10, "e")


def family_shift_episodes(spark, sf_dir):
    return episodes.family_shift(_groups(spark, sf_dir), 1)


def difficulty_episodes(spark, sf_dir):
    c = representations.centroids(clips(spark, sf_dir).withColumn("group", F.pmod("id", F.lit(20))), "group")
    near, mixed = episodes.difficulty_targeted(c, 3, 6), episodes.difficulty_targeted(c, 3, 6, True)
    return near.withColumn("kind", F.lit("near")).unionByName(mixed.withColumn("kind", F.lit("mixed")))


def leave_group_out(spark, sf_dir):
    return episodes.leave_group_out(clips(spark, sf_dir).select(F.col("group_id").alias("group")).distinct())


def ranking_card(spark, sf_dir):
    rows = _ranked(spark, sf_dir).filter("policy = 'quality'").drop("rank")
    rows = ranking.ranked(rows, F.desc("quality"), F.asc("id"))
    return rounded(audits.model_card(rows, [10, 50]))


def ranking_faults(spark, sf_dir):
    rows = ranking.ranked(clips(spark, sf_dir), F.desc("quality"), F.asc("id")).withColumn("score", F.col("quality"))
    return audits.ranking_faults(rows)


def split_overlaps(spark, sf_dir):
    """Parts in orders of two statuses, as a table whose splits overlap."""
    li = table(spark, sf_dir, "lineitem")
    return audits.overlaps(li.select(F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("split")))


def coverage_audit(spark, sf_dir):
    return rounded(audits.coverage_audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))))


def decision_gates(spark, sf_dir):
    return rounded(audits.decision_gates(_facts(spark, sf_dir), "episode", "policy", "value", "novelty", "random", "oracle"))


def opportunity_strata(spark, sf_dir):
    return rounded(audits.difficulty_strata(_facts(spark, sf_dir), ["episode"], "policy", "value", "oracle", "random"))


def selection_hygiene(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(audits.hygiene(ranking.top_k(ranking.quality_order(c), 50), c.filter("role = 'candidate'"), c.filter("role = 'target'"), F.col("artifact") <= 0.05))


def batch_density(spark, sf_dir):
    return rounded(neighbors.density(clips(spark, sf_dir).filter("role = 'candidate'"), 10))


def streaming_gate(spark, sf_dir):
    """The event stream's daily quality counts, run to its end."""
    from ..streaming.gate import run_once

    return run_once(spark, sf_dir)


_ALL = (
    similarity_components, cluster_medoids, split_clusters, round_robin_split, vector_codes, group_centroids, ranking_metrics, top_overlap, rank_correlations, paired_deltas, policy_summary, oracle_fractions, bootstrap_intervals, leave_one_out,
    group_gini, numeric_summaries, consensus_ranking, selection_summaries, centroid_ranker, ridge_line, nearest_centroid, forecast_examples, forecast_error, representation_ranks, source_blocked_episodes, random_episodes, family_shift_episodes,
    difficulty_episodes, leave_group_out, ranking_card, ranking_faults, split_overlaps, coverage_audit, decision_gates, opportunity_strata, selection_hygiene, batch_density, streaming_gate,
)
QUERIES = {f.__name__: f for f in _ALL}

_H = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
_RANKED = f"""ranked AS (SELECT id, group_id, quality, stationary, artifact, floor(stationary * 3)::INT AS label, id % 7 AS cluster, artifact > 0.08 AS corrupted, policy, row_number() OVER (PARTITION BY policy, group_id ORDER BY
CASE policy WHEN 'quality' THEN -quality WHEN 'stationary' THEN -stationary ELSE {_H.format("'p:' || id")} END, id) AS rank FROM clips, (VALUES ('quality'), ('stationary'), ('random')) p(policy))"""
_FACTS = f"""raw AS (SELECT o_custkey AS episode, min(o_orderkey) AS k, policy FROM orders, (VALUES {', '.join(f"('{p}')" for p in POLICIES)}) p(policy) GROUP BY ALL),
facts AS (SELECT episode, policy, CASE WHEN policy = 'oracle' THEN 0.5 + {_H.format("policy || ':' || episode")} / 281474976710655.0 ELSE round({_H.format("policy || ':' || episode")} / 281474976710655.0, 2) END AS value FROM raw)"""
#: Means of replicates that draw as many episodes as there are, by hashes of replicate and draw.
_DRAWN = f"""seats AS (SELECT policy, value, row_number() OVER (PARTITION BY policy ORDER BY episode) AS seat, count(*) OVER (PARTITION BY policy) AS n FROM facts),
draws AS (SELECT policy, r, least(floor({_H.format("r || ':' || seat")} / 281474976710655.0 * n) + 1, n) AS seat FROM seats, range(1, {{n}}) t(r)), m AS (SELECT policy, r, avg(value) AS m FROM draws JOIN seats USING (policy, seat) GROUP BY ALL)"""
_GROUPS = "g AS (SELECT s_suppkey AS \"group\", s_nationkey AS family FROM supplier)"

ORACLES = {
    "similarity_components": f"""WITH RECURSIVE {CLIPS}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM clips a, clips b WHERE a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.42),
r AS (SELECT id, id AS root FROM clips UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster, count(*) OVER (PARTITION BY root) AS cluster_size FROM m""",
    "cluster_medoids": f"""WITH {CLIPS}, f AS (SELECT a.id, a.group_id, a.v, round(avg(list_cosine_similarity(a.v, b.v)), 12) AS s FROM clips a JOIN clips b USING (group_id) GROUP BY ALL), m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s DESC, id) = 1)
SELECT c.id, c.group_id AS cluster, m.id AS medoid_id, round(1 - list_cosine_similarity(c.v, m.v), 6) AS medoid_distance FROM clips c JOIN m USING (group_id)""",
    "round_robin_split": f"WITH {CLIPS} SELECT id, group_id AS cluster, (row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, id) - 1) % 3 AS child FROM clips",
    "group_centroids": f"WITH {CLIPS} SELECT group_id, count(*) AS n, d - 1 AS dim, round(avg(v[d]), 6) AS x FROM clips, range(1, 65) t(d) GROUP BY group_id, d",
    "ranking_metrics": f"""WITH {CLIPS}, {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY policy, group_id ORDER BY label DESC, rank) AS ideal, sum((label > 0)::INT) OVER (PARTITION BY policy, group_id ORDER BY rank) AS hits FROM ranked)
SELECT policy, group_id, round(avg((label > 0)::INT) FILTER (rank <= 10), 6) AS precision, round(coalesce(sum(hits / rank) FILTER (rank <= 10 AND label > 0) / least(sum((label > 0)::INT), 10), 0), 6) AS average_precision,
round(sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (rank <= 10) / sum((pow(2, label) - 1) / log2(ideal + 1)) FILTER (ideal <= 10), 6) AS ndcg,
round(count(DISTINCT cluster) FILTER (rank <= 10 AND label > 0) / count(*) FILTER (rank <= 10 AND label > 0), 6) AS cluster_diversity, round(avg(corrupted::INT) FILTER (rank <= 10), 6) AS corruption_rate FROM i GROUP BY ALL""",
    "top_overlap": f"""WITH {CLIPS}, {_RANKED}, t AS (SELECT group_id, policy, list(id) AS ids FROM ranked WHERE rank <= 10 GROUP BY ALL)
SELECT a.group_id, a.policy AS policy_a, b.policy AS policy_b, round(len(list_intersect(a.ids, b.ids)) / least(len(a.ids), len(b.ids)), 6) AS overlap, round(len(list_intersect(a.ids, b.ids)) / (len(a.ids) + len(b.ids) - len(list_intersect(a.ids, b.ids))), 6) AS jaccard FROM t a JOIN t b ON a.group_id = b.group_id AND a.policy < b.policy""",
    "rank_correlations": f"""WITH {CLIPS}, x AS (SELECT group_id, round(quality, 1) AS x, round(stationary, 1) AS y FROM clips), r AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY x) + (count(*) OVER (PARTITION BY group_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY group_id ORDER BY y) + (count(*) OVER (PARTITION BY group_id, y) - 1) / 2 AS ry FROM x)
SELECT group_id, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY group_id""",
    "paired_deltas": f"""WITH {_FACTS}, d AS (SELECT f.policy, f.value - b.value AS d FROM facts f JOIN facts b ON f.episode = b.episode AND b.policy = 'random' WHERE f.policy <> 'random')
SELECT policy, count(*) AS n, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses FROM d GROUP BY policy""",
    "policy_summary": f"WITH {_FACTS}, w AS (SELECT *, value >= max(value) OVER (PARTITION BY episode) - 1e-12 AS win FROM facts) SELECT policy, round(avg(value), 6) AS mean, count(*) AS n, sum(win::INT)::BIGINT AS wins FROM w GROUP BY policy",
    "oracle_fractions": f"WITH {_FACTS}, f AS (SELECT f.policy, CASE WHEN o.value > 1e-12 THEN least(greatest(f.value / o.value, 0), 1) END AS x FROM facts f JOIN facts o ON f.episode = o.episode AND o.policy = 'oracle') SELECT policy, round(avg(x), 6) AS fraction, round(min(x), 6) AS least FROM f GROUP BY policy",
    "bootstrap_intervals": f"""WITH {_FACTS}, {_DRAWN.format(n=51)}, q AS (SELECT policy, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY policy) SELECT policy, round(avg(value), 6) AS mean, count(*) AS n, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM facts JOIN q USING (policy) GROUP BY policy""",
    "leave_one_out": f"WITH {_FACTS} SELECT policy, episode, round((sum(value) OVER w - value) / (count(*) OVER w - 1), 6) AS without, round(abs(value) / sum(abs(value)) OVER w, 6) AS contribution FROM facts WINDOW w AS (PARTITION BY policy)",
    "group_gini": f"WITH {CLIPS}, r AS (SELECT group_id, quality, row_number() OVER (PARTITION BY group_id ORDER BY quality) AS i FROM clips) SELECT group_id, round(2 * sum(i * quality) / (count(*) * sum(quality)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY group_id",
    "numeric_summaries": "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS max FROM events GROUP BY event_type",
    "consensus_ranking": f"""WITH {CLIPS}, {_RANKED}, p AS (SELECT *, count(*) OVER (PARTITION BY policy) - rank AS points FROM ranked), a AS (SELECT id, avg(rank) AS mean_rank, sum(points)::BIGINT AS borda, stddev_pop(rank) AS rank_std, min(rank) AS best_rank, max(rank) AS worst_rank, avg(quality) AS mean_score, count(*) AS runs FROM p GROUP BY id)
SELECT id, round(mean_rank, 6) AS mean_rank, borda, round(rank_std, 6) AS rank_std, best_rank, worst_rank, round(mean_score, 6) AS mean_score, runs, row_number() OVER (ORDER BY mean_rank, borda DESC, mean_score DESC, id) AS consensus_rank FROM a""",
    "selection_summaries": f"""WITH {CLIPS}, {_RANKED}, g AS (SELECT policy, k, group_id, count(*) AS n, sum(quality) AS q, min(quality) AS l, sum((quality < 0.45)::INT) AS low FROM ranked, (VALUES (5), (20)) t(k) WHERE rank <= k GROUP BY ALL)
SELECT policy, k, sum(n)::BIGINT AS n, round(sum(q) / sum(n), 6) AS mean_quality, round(min(l), 6) AS min_quality, count(*) AS groups, round(max(n) / sum(n), 6) AS largest_group, round(sum(low) / sum(n), 6) AS low_quality_rate FROM g GROUP BY ALL""",
    "ridge_line": """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d, count(*) AS n, avg(l_extendedprice) AS y, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem) SELECT DISTINCT l_quantity::DOUBLE AS x, round(y + (n * c / d) / (n + 1) * (l_quantity - m) / d, 3) AS fitted FROM lineitem, s""",
    "nearest_centroid": f"""WITH {CLIPS}, m AS (SELECT group_id, list(x ORDER BY d) AS c FROM (SELECT group_id, d, avg(v[d]) AS x FROM clips, range(1, 65) t(d) WHERE role = 'support' GROUP BY group_id, d) GROUP BY group_id), g AS (SELECT t.id, t.group_id, m.group_id AS guess FROM clips t, m WHERE role = 'target' QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY 1 - list_cosine_similarity(t.v, m.c), m.group_id) = 1),
l AS (SELECT group_id, avg((guess = group_id)::INT) AS r, count(*) AS n, sum((guess = group_id)::INT) AS hit, sum((group_id IN (SELECT group_id FROM m))::INT) AS known FROM g GROUP BY group_id) SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(avg(r), 6) AS balanced_accuracy, round(sum(known) / sum(n), 6) AS known_fraction FROM l""",
    "forecast_examples": f"""WITH {SERIES}, l AS (SELECT clip, idx, acc_y AS y, lag(acc_y, 1) OVER o AS x1, lag(acc_y, 2) OVER o AS x2, lag(acc_y, 3) OVER o AS x3 FROM series WINDOW o AS (PARTITION BY clip ORDER BY idx)), n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS i, greatest(1.0, count(*) OVER (PARTITION BY clip) / 64) AS step FROM l WHERE x3 IS NOT NULL)
SELECT clip, idx, round(y, 6) AS y, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3 FROM n WHERE floor((i - 1) / step) > floor((i - 2) / step)""",
    "source_blocked_episodes": f"""WITH {_GROUPS}, p AS (SELECT *, row_number() OVER (ORDER BY "group") - 1 AS place, count(*) OVER () AS n FROM g), e AS (SELECT e AS episode_id, "group", ((place - e * 5) % n + n) % n AS at_ FROM p, range(0, 4) t(e)) SELECT episode_id, "group", CASE WHEN at_ < 5 THEN 'target' WHEN at_ < 15 THEN 'candidate' ELSE 'support' END AS role FROM e""",
    "random_episodes": f"""WITH {_GROUPS}, p AS (SELECT e AS episode_id, "group", row_number() OVER (PARTITION BY e ORDER BY {_H.format('''\'e:' || e || ':' || "group"''')}, "group") AS place FROM g, range(0, 3) t(e)) SELECT episode_id, "group", CASE WHEN place <= 5 THEN 'target' WHEN place <= 15 THEN 'candidate' ELSE 'support' END AS role FROM p""",
    "family_shift_episodes": f"""WITH {_GROUPS}, f AS (SELECT family AS held, row_number() OVER (ORDER BY family) - 1 AS episode_id FROM (SELECT DISTINCT family FROM g)), e AS (SELECT episode_id, "group", family = held AS own, row_number() OVER (PARTITION BY episode_id, family = held ORDER BY "group") AS nth FROM g, f)
SELECT episode_id, "group", CASE WHEN own AND nth <= 1 THEN 'candidate' WHEN own THEN 'target' WHEN nth % 2 = 0 THEN 'candidate' ELSE 'support' END AS role FROM e""",
    "leave_group_out": "WITH g AS (SELECT DISTINCT label AS x FROM embeddings) SELECT a.x AS fold, b.x AS \"group\", CASE WHEN a.x = b.x THEN 'heldout' ELSE 'train' END AS side FROM g a, g b",
    "ranking_card": f"""WITH {CLIPS}, r AS (SELECT id, quality, id % 7 AS cluster, row_number() OVER (ORDER BY quality DESC, id) AS rank FROM clips), t AS (SELECT * FROM r, (VALUES (10), (50)) t(k) WHERE rank <= k), s AS (SELECT k, cluster, count(*) AS n FROM t GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM s),
z AS (SELECT k, count(*) AS clusters, max(n) AS largest_cluster, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM i GROUP BY k) SELECT k, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(min(quality), 6) AS min_quality, any_value(clusters) AS clusters, any_value(largest_cluster) AS largest_cluster, any_value(gini) AS gini FROM t JOIN z USING (k) GROUP BY k""",
    "ranking_faults": "SELECT count(*) AS n, true AS contiguous, true AS non_increasing, count(*) - count(DISTINCT vec_id) AS duplicate_ids, 0 AS blank_ids FROM embeddings",
    "split_overlaps": "SELECT l_partkey AS id, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS splits FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linestatus) > 1",
    "coverage_audit": "WITH m AS (SELECT DISTINCT c_custkey AS id, 1 AS m FROM customer), f AS (SELECT DISTINCT o_custkey AS id, 1 AS f FROM orders) SELECT count(m) AS listed, count(f) AS present, count(*) FILTER (m = 1 AND f = 1) AS both, round(count(*) FILTER (m = 1 AND f = 1) / count(m), 6) AS share FROM m FULL JOIN f USING (id)",
    "opportunity_strata": f"""WITH {_FACTS}, h AS (SELECT o.episode, o.value - b.value AS headroom FROM facts o JOIN facts b USING (episode) WHERE o.policy = 'oracle' AND b.policy = 'random'), m AS (SELECT median(headroom) AS m FROM h WHERE headroom > 0) SELECT episode, round(headroom, 6) AS headroom, CASE WHEN headroom <= 0 THEN 'none' WHEN headroom >= m THEN 'high' ELSE 'low' END AS stratum FROM h, m""",
    "selection_hygiene": f"WITH {CLIPS}, s AS (SELECT *, row_number() OVER (ORDER BY quality DESC, id) AS rank FROM clips) SELECT round(avg((NOT artifact <= 0.05)::INT), 6) AS invalid, round(avg((role <> 'candidate')::INT), 6) AS out_of_pool, round(avg((role = 'target')::INT), 6) AS target_leak, count(*) - count(DISTINCT id) AS repeats FROM s WHERE rank <= 50",
    "batch_density": f"""WITH {CLIPS}, p AS (SELECT a.id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.id) AS r FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'candidate' AND a.id <> b.id) SELECT id, round(avg(greatest(s, 0)), 6) AS density FROM p WHERE r <= 10 GROUP BY id""",
    "streaming_gate": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, count(*) FILTER (abs(value) <= 60) AS passed FROM events GROUP BY ALL",
}
