"""Queries on further selections, on labels and features for a learned ranker, and on evaluation gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..operators import audits, greedy, labels, metrics, neighbors, ranking, scores
from .base import CLIPS, SCORED, candidates, clips, rounded
from .evaluation import _RANKED, _ranked
from .greedy_sql import BATCHES, GATE, TARGETS, recursion
from .ranking import _batches, _gate


def _targets(spark, sf_dir):
    c = clips(spark, sf_dir)
    targets = c.filter("role = 'target'")
    before = neighbors.nearest_distance(targets, c.filter("role = 'support'")).withColumnRenamed("distance", "before")
    return targets.join(before, "id").withColumn("batch", F.pmod("id", F.lit(2)).cast("long"))


def prefix_fill_selection(spark, sf_dir):
    """Ten by groups with two of each, then by smaller clusters with three of each."""
    rows = _batches(spark, sf_dir).withColumn("child", F.col("group_id") * 3 + F.pmod("id", F.lit(3)))
    return greedy.prefix_then_fill(rows, 10, "group_id", "child", 2, 30, 3)


def learned_k_center_selection(spark, sf_dir):
    return greedy.learned_k_center(_batches(spark, sf_dir), 8, "score")


def target_family_selection(spark, sf_dir):
    rows = _batches(spark, sf_dir).withColumn("label", F.col("group_id"))
    c = clips(spark, sf_dir).select(F.pmod("id", F.lit(2)).cast("long").alias("batch"), F.col("group_id").alias("label"), "role", "id")
    known = c.filter("role = 'support' and id < 40").select("batch", "label")
    return rounded(greedy.target_families(rows, known, c.filter("role = 'target'").select("batch", "label"), 12))


def oracle_screened(spark, sf_dir):
    out = greedy.oracle_screen(_batches(spark, sf_dir), _targets(spark, sf_dir), 10)
    return rounded(out.select("batch", "id", "rank", "gain", "relative_gain"))


def oracle_pairs(spark, sf_dir):
    """The best two rows of each batch by trying every two of ten."""
    rows = greedy.oracle_screen(_batches(spark, sf_dir), _targets(spark, sf_dir), 10).drop("rank", "gain", "relative_gain")
    return rounded(greedy.oracle_exact(rows, _targets(spark, sf_dir), 2).select("batch", "id", "rank", "value"))


def gain_labels(spark, sf_dir):
    return rounded(labels.gain_labels(_batches(spark, sf_dir), _targets(spark, sf_dir)))


def hygiene_labels(spark, sf_dir):
    rows = _batches(spark, sf_dir)
    near = labels.distance_features(rows, "group_id").select("id", "nearest_similarity")
    gains = greedy.alone_gains(rows, _targets(spark, sf_dir))
    out = labels.hygiene_labels(rows.join(near, "id").join(gains, ["batch", "id"]), ["gain", "relative_gain"], 0.3, 0.9, 60.0, 0.45)
    return rounded(out.select("id", "hygiene_gate", "gated_gain", "gated_relative_gain"))


def distance_features(spark, sf_dir):
    return rounded(labels.distance_features(clips(spark, sf_dir).filter("role = 'candidate'"), "group_id"))


def labelled_features(spark, sf_dir):
    """Features of every clip with the label of its (episode, id), and metadata of every other clip under a prefix."""
    c = clips(spark, sf_dir).withColumn("episode", F.pmod("id", F.lit(3)))
    marks = c.select("episode", "id", (stable_random(F.lit("label"), F.col("id")) < 0.5).alias("label"))
    out = labels.with_labels(labels.select_split(c, "candidate", "role").select("episode", "id", "quality"), marks, ["episode", "id"])
    return rounded(labels.with_metadata(out, c.filter("id % 2 = 0").select("id", "stationary", "max_abs"), "quality_meta"))


def split_sets(spark, sf_dir):
    """How many ids are in two sets together, in both, and in one alone."""
    c = clips(spark, sf_dir)
    a, b = c.filter("quality >= 0.5").select("id"), c.filter("stationary <= 0.5").select("id")
    parts = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.union(b).exceptAll(b)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.sum("id").alias("sum_id"))
        out = one if out is None else out.unionByName(one)
    return out


def quality_novelty_ranking(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("quality", F.round("quality", 1))
    return rounded(ranking.quality_novelty_order(rows).select("id", "rank", "quality", "novelty"))


def blend_reasons(spark, sf_dir):
    rows = scores.scored(candidates(spark, sf_dir)).withColumn("singleton", F.col("id") % 10 == 3)
    reason = scores.blend_reason(_gate(), F.col("novelty_score"), F.col("singleton"))
    once = scores.consensus_reason(F.when(F.col("id") % 7 == 0, F.lit(" ")).otherwise(reason))
    return rows.select("id", reason.alias("reason"), once.alias("consensus"), scores.consensus_reason(once).alias("again"))


def selection_metrics(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("score", F.col("quality")).withColumn("redundancy", (F.col("stationary") > 0.7).cast("int")).withColumn("artifact", (F.col("artifact") > 0.08).cast("int"))
    return rounded(metrics.selection_metrics(rows, [5, 20], ["policy", "group_id"]))


def view_overlap(spark, sf_dir):
    policies = spark.createDataFrame([("kcenter_window", ["window"]), ("blend", ["window", "ts2vec"]), ("quality", [])], "policy string, families array<string>")
    views = spark.createDataFrame([("window_mean_std_pool",), ("TS2Vec_320",), ("morph_x",), ("raw_shape_stats",), ("other",)], "view string")
    return metrics.feature_overlap(policies, views)


def balanced_gains(spark, sf_dir):
    """The gain of all candidates over two views, and their mean."""
    c, out = clips(spark, sf_dir), None
    for view, v in (("whole", F.col("v")), ("head", F.slice("v", 1, 16)), ("tail", F.slice("v", 17, 48))):
        own = c.select("id", "role", v.alias("v"))
        one = neighbors.coverage(*[own.filter(F.col("role") == r).select("id", "v") for r in ("target", "support", "candidate")]).select(F.lit("all").alias("selection"), F.lit(view).alias("view"), "relative_gain")
        out = one if out is None else out.unionByName(one)
    return rounded(metrics.balanced_gain(out, ["selection"], ["whole", "head"]))


def retrieval_summary(spark, sf_dir):
    c = clips(spark, sf_dir)
    near = neighbors.knn_join(c.filter("role = 'candidate'"), c.filter("role = 'support'"), 10)
    return rounded(metrics.retrieval_summary(near))


def gate_thresholds(spark, sf_dir):
    support = clips(spark, sf_dir).filter("role = 'support'")
    return rounded(audits.gate_thresholds([("q45", "fixed", 0.45), ("over", "fixed", 1.7), ("support_q20", "support_quantile", 0.2), ("support_q75", "support_quantile", 75.0)], support))


def held_out_folds(spark, sf_dir):
    rows = clips(spark, sf_dir).select("id", F.floor(F.sqrt("id")).cast("long").alias("group"))
    return audits.held_out_folds(rows, 4, 3, 0.4, "folds")


def _eval_facts(spark, sf_dir):
    """Made-up gains of policies by fold, view and k, from nations' names."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("fold")).filter("fold < 5")
    lists = {"policy": ["capped", "free", "quality", "random"], "view": ["window", "raw_shape", "temporal"], "k": [10, 50]}
    for name, values in lists.items():
        n = n.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    base = F.when(F.col("policy").isin("capped", "free"), 0.3).otherwise(0.1) - F.when((F.col("view") == "temporal") & (F.col("policy") == "capped"), 0.25).otherwise(0.0)
    draw = stable_random(F.col("policy"), F.col("view"), F.col("k"), F.col("fold"))
    return n.withColumn("gain", base + 0.05 * draw).withColumn("fail_rate", F.lit(0.0))


def soundness_gates(spark, sf_dir):
    return audits.soundness_gates(_eval_facts(spark, sf_dir), "capped", "free", ["quality", "random"], ["window", "raw_shape"], ["temporal"], tolerance=0.05)


def benchmark_gates(spark, sf_dir):
    f = _eval_facts(spark, sf_dir).filter("view = 'window' and k = 10").withColumn("episode", F.col("fold")).withColumn("largest_share", 2 * F.col("gain"))
    return audits.benchmark_gates(f, "free", [("capped", "quality"), ("capped", "random")], True, 0.31)


_ALL = (
    prefix_fill_selection, learned_k_center_selection, target_family_selection, oracle_screened, oracle_pairs, gain_labels, hygiene_labels, distance_features, labelled_features, split_sets, quality_novelty_ranking, blend_reasons, selection_metrics,
    view_overlap, balanced_gains, retrieval_summary, gate_thresholds, held_out_folds, soundness_gates, benchmark_gates,
)
QUERIES = {f.__name__: f for f in _ALL}


def _capped(name: str, cluster: str, k: int, cap: int) -> str:
    """A selection capped by a cluster for the first k ranks, without a bonus."""
    sql = recursion("c.score - 0.25 * greatest(coalesce(max(s.s), 0), 0)", f"(step >= {k} OR taken < {cap}) DESC, value DESC, id")
    sql = sql.replace("list_contains(r.chosen, s.b)", f"list_contains(r.chosen, s.b) LEFT JOIN (SELECT id, {cluster} AS cl FROM cand) kk ON kk.id = s.b").replace(
        " AS value FROM pick r JOIN", f" AS value, count(*) FILTER (kk.cl = {cluster.replace('id', 'c.id').replace('cluster', 'c.cluster')}) AS taken FROM pick r JOIN"
    )
    return sql.replace("pick", name)


_ALONE = """al AS (SELECT c.batch, c.id, c.quality, avg(n.before) - avg(least(n.before, n.d)) AS gain, (avg(n.before) - avg(least(n.before, n.d))) / greatest(avg(n.before), 1e-12) AS relative_gain FROM cand c JOIN near_t n USING (id) GROUP BY ALL)"""
_GREEDY = """pick AS (SELECT batch, 0 AS step, []::BIGINT[] AS chosen, NULL::BIGINT AS id, NULL::DOUBLE AS value, NULL::DOUBLE AS rel FROM (SELECT DISTINCT batch FROM cand)
UNION ALL SELECT batch, step + 1, list_append(chosen, id), id, value, rel FROM (
  SELECT r.batch, r.step, r.chosen, c.id, c.quality, avg(least(n.before, coalesce(m.d, 9))) - avg(least(n.before, coalesce(m.d, 9), n.d)) AS value, (avg(least(n.before, coalesce(m.d, 9))) - avg(least(n.before, coalesce(m.d, 9), n.d))) / greatest(avg(least(n.before, coalesce(m.d, 9))), 1e-12) AS rel
  FROM pick r JOIN cand c ON c.batch = r.batch JOIN near_t n ON n.id = c.id LEFT JOIN (SELECT p.batch, x.t, min(x.d) AS d FROM pick p JOIN near_t x ON list_contains(p.chosen, x.id) GROUP BY p.batch, x.t) m ON m.t = n.t
  WHERE NOT list_contains(r.chosen, c.id) GROUP BY r.batch, r.step, r.chosen, c.id, c.quality)
  QUALIFY row_number() OVER (PARTITION BY batch ORDER BY round(value, 12) DESC, quality DESC, id) = 1)"""
_DIST = """u AS (SELECT id, group_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM clips WHERE role = 'candidate'),
p AS (SELECT a.id, min(1 - list_cosine_similarity(a.u, b.u)) AS nn, avg(1 - list_cosine_similarity(a.u, b.u)) AS mean FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id),
ce AS (SELECT group_id, list(m ORDER BY i) AS centre, any_value(n) AS n FROM (SELECT group_id, i, avg(x) AS m, count(*) AS n FROM (SELECT group_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u) GROUP BY ALL) GROUP BY group_id),
df AS (SELECT u.id, nn, mean, CASE WHEN n > 1 THEN 1 - list_cosine_similarity(u, centre) ELSE 1 END AS centroid FROM u JOIN p USING (id) JOIN ce USING (group_id))"""
_H = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
_EVAL = f"""facts AS (SELECT n_nationkey AS fold, policy, view, k, CASE WHEN policy IN ('capped', 'free') THEN 0.3::DOUBLE ELSE 0.1 END - CASE WHEN view = 'temporal' AND policy = 'capped' THEN 0.25 ELSE 0 END + 0.05 * {_H.format("policy || ':' || view || ':' || k || ':' || n_nationkey")} / 281474976710655.0 AS gain
FROM nation, (VALUES ('capped'), ('free'), ('quality'), ('random')) a(policy), (VALUES ('window'), ('raw_shape'), ('temporal')) b(view), (VALUES (10), (50)) c(k) WHERE n_nationkey < 5)"""


def _beats(views: str) -> str:
    return f"""(SELECT min(w) >= 3 FROM (SELECT c.policy, c.k, count(*) FILTER (o.g > c.g + 1e-12) AS w FROM (SELECT fold, policy, k, avg(gain) AS g FROM facts WHERE view IN ({views}) GROUP BY ALL) c
JOIN (SELECT fold, k, avg(gain) AS g FROM facts WHERE view IN ({views}) AND policy = 'capped' GROUP BY ALL) o USING (fold, k) WHERE c.policy IN ('quality', 'random') GROUP BY ALL))"""


_REASONS = f"""concat_ws('|', 'BLEND_KCENTER', CASE WHEN {GATE} THEN 'HYGIENE_PASS' ELSE 'HYGIENE_FALLBACK' END, CASE WHEN novelty_score >= 0.75 THEN 'HIGH_OLD_NOVELTY' END, CASE WHEN id % 10 = 3 THEN 'SINGLETON_CLUSTER' END)"""
_GAINS = " UNION ALL ".join(
    f"SELECT '{view}' AS view, (avg(old) - avg(least(old, new))) / greatest(avg(old), 1e-12) AS g FROM (SELECT a.id, min(1 - list_cosine_similarity({x.format('a.v')}, {x.format('b.v')})) FILTER (b.role = 'support') AS old, min(1 - list_cosine_similarity({x.format('a.v')}, {x.format('b.v')})) FILTER (b.role = 'candidate') AS new FROM clips a, clips b WHERE a.role = 'target' AND b.role <> 'target' GROUP BY a.id)"
    for view, x in (("whole", "{}"), ("head", "{}[:16]"))
)

ORACLES = {
    "prefix_fill_selection": f"""WITH RECURSIVE {BATCHES}, {_capped('pre', 'cluster', 10, 2)}, {_capped('fil', '(cluster * 3 + id % 3)', 30, 3)},
a AS (SELECT batch, id, step AS seat, 'prefix' AS stage FROM pre WHERE step BETWEEN 1 AND 10), b AS (SELECT batch, id, step AS seat, 'fill' AS stage FROM fil WHERE step > 0 AND id NOT IN (SELECT id FROM a))
SELECT batch, id, stage, row_number() OVER (PARTITION BY batch ORDER BY stage DESC, seat) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "learned_k_center_selection": f"""WITH RECURSIVE {BATCHES}, pl AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY batch ORDER BY ok DESC, score DESC, quality DESC, id) AS place, ok FROM cand),
{recursion('least(c.gap, coalesce(1 - max(s.s), 9))', 'value DESC, score DESC, id', 'c.id IN (SELECT id FROM pl WHERE ok AND place <= 12)').replace('c.quality, c.cluster, least', 'c.quality, c.cluster, c.score, least')}
SELECT cand.batch, cand.id, row_number() OVER (PARTITION BY cand.batch ORDER BY step NULLS LAST, place) AS rank FROM cand JOIN pl USING (id) LEFT JOIN (SELECT id, step FROM pick WHERE step > 0) USING (id)""",
    "target_family_selection": f"""WITH {BATCHES}, kn AS (SELECT DISTINCT id % 2 AS batch, group_id AS l FROM clips WHERE role = 'support' AND id < 40), wa AS (SELECT DISTINCT id % 2 AS batch, group_id AS l FROM clips WHERE role = 'target'),
o AS (SELECT batch, id, quality, cluster IN (SELECT l FROM wa WHERE wa.batch = cand.batch) AND cluster NOT IN (SELECT l FROM kn WHERE kn.batch = cand.batch) AND row_number() OVER (PARTITION BY batch, cluster ORDER BY quality DESC, id DESC) = 1 AS new FROM cand),
r AS (SELECT *, row_number() OVER w AS seat, count(*) FILTER (new) OVER w AS found FROM o WINDOW w AS (PARTITION BY batch ORDER BY new DESC, quality DESC, id DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT batch, count(*) AS n, count(*) FILTER (l IN (SELECT l FROM kn WHERE kn.batch = wa.batch)) AS have FROM wa GROUP BY batch)
SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY least(seat, 12), CASE WHEN seat > 12 THEN id END NULLS FIRST) AS rank, round(CASE WHEN seat <= 12 THEN (have + found) / n ELSE 0 END, 6) AS value FROM r JOIN s USING (batch)""",
    "oracle_screened": f"WITH {TARGETS}, {_ALONE} SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY relative_gain DESC, quality DESC, id) AS rank, round(gain, 6) AS gain, round(relative_gain, 6) AS relative_gain FROM al QUALIFY rank <= 10",
    "oracle_pairs": f"""WITH {TARGETS}, {_ALONE}, top AS MATERIALIZED (SELECT batch, id FROM al QUALIFY row_number() OVER (PARTITION BY batch ORDER BY relative_gain DESC, quality DESC, id) <= 10),
pr AS (SELECT a.batch, a.id AS i, b.id AS j, (avg(x.before) - avg(least(x.before, x.d, y.d))) / greatest(avg(x.before), 1e-12) AS value FROM top a JOIN top b ON a.batch = b.batch AND a.id < b.id JOIN near_t x ON x.id = a.id JOIN near_t y ON y.id = b.id AND y.t = x.t GROUP BY ALL),
be AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY batch ORDER BY value DESC, i, j) = 1) SELECT batch, unnest([i, j]) AS id, unnest([1, 2]) AS rank, round(value, 6) AS value FROM be""",
    "gain_labels": f"""WITH RECURSIVE {TARGETS}, {_ALONE}, {_GREEDY} SELECT p.batch, p.id, step AS greedy_rank, round(value, 6) AS gain_after_prefix, round(rel, 6) AS relative_gain_after_prefix, round(gain, 6) AS gain_alone, round(relative_gain, 6) AS relative_gain_alone FROM pick p JOIN al ON al.id = p.id WHERE step > 0""",
    "hygiene_labels": f"""WITH {TARGETS}, {_ALONE}, nn AS (SELECT a.id, max(list_cosine_similarity(a.v, b.v)) AS near FROM cand a JOIN cand b ON a.id <> b.id GROUP BY a.id),
g AS (SELECT id, ok AND near <= 0.45 AS hygiene_gate, gain, relative_gain FROM cand JOIN nn USING (id) JOIN al USING (id)) SELECT id, hygiene_gate, round(hygiene_gate::INT * gain, 6) AS gated_gain, round(hygiene_gate::INT * relative_gain, 6) AS gated_relative_gain FROM g""",
    "distance_features": f"WITH {CLIPS}, {_DIST} SELECT id, round(nn, 6) AS nn_distance, round(1 - nn, 6) AS nearest_similarity, round(mean, 6) AS mean_distance, round(centroid, 6) AS centroid_distance FROM df",
    "labelled_features": f"""WITH {CLIPS} SELECT id % 3 AS episode, id, round(quality, 6) AS quality, {_H.format("'label:' || id")} / 281474976710655.0 < 0.5 AS label, id % 2 = 0 AS has_quality_meta, CASE WHEN id % 2 = 0 THEN round(stationary, 6) END AS quality_meta_stationary, CASE WHEN id % 2 = 0 THEN round(max_abs, 6) END AS quality_meta_max_abs FROM clips WHERE role = 'candidate'""",
    "split_sets": f"""WITH {CLIPS}, a AS (SELECT id FROM clips WHERE quality >= 0.5), b AS (SELECT id FROM clips WHERE stationary <= 0.5)
SELECT 'union' AS kind, count(*) AS n, sum(id)::BIGINT AS sum_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*), sum(id)::BIGINT FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*), sum(id)::BIGINT FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*), sum(id)::BIGINT FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'except_all', count(*), sum(id)::BIGINT FROM a""",
    "quality_novelty_ranking": f"WITH {SCORED} SELECT id, row_number() OVER (ORDER BY round(quality, 1) DESC, novelty DESC, id) AS rank, round(quality, 1) AS quality, round(novelty, 6) AS novelty FROM scored",
    "blend_reasons": f"WITH {SCORED}, r AS (SELECT id, {_REASONS} AS reason FROM scored) SELECT id, reason, CASE WHEN id % 7 = 0 THEN 'CONSENSUS' ELSE reason || '|CONSENSUS' END AS consensus, consensus AS again FROM r",
    "selection_metrics": f"""WITH {CLIPS}, {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY policy, group_id ORDER BY label DESC, rank) AS ideal, row_number() OVER (PARTITION BY policy, group_id ORDER BY quality DESC) AS best, sum((label > 0)::INT) OVER (PARTITION BY policy, group_id ORDER BY rank) AS hits, count(DISTINCT cluster) OVER (PARTITION BY policy, group_id) AS all_clusters FROM ranked),
m AS (SELECT policy, group_id, k, avg((label > 0)::INT) FILTER (rank <= k) AS precision, coalesce(sum(hits / rank) FILTER (rank <= k AND label > 0) / least(sum((label > 0)::INT), k), 0) AS average_precision, coalesce(sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (rank <= k) / sum((pow(2, label) - 1) / log2(ideal + 1)) FILTER (ideal <= k), 0) AS ndcg,
coalesce(count(DISTINCT cluster) FILTER (rank <= k AND label > 0) / nullif(count(*) FILTER (rank <= k AND label > 0), 0), 0) AS cluster_diversity, count(DISTINCT cluster) FILTER (rank <= k) AS unique_clusters, count(*) FILTER (rank <= k) - count(DISTINCT cluster) FILTER (rank <= k) AS cluster_repeats, count(DISTINCT cluster) FILTER (rank <= k) / any_value(all_clusters) AS cluster_coverage,
avg(quality) FILTER (rank <= k) AS mean_quality, avg((quality < 0.45)::INT) FILTER (rank <= k) AS low_quality_rate, avg((artifact > 0.08)::INT) FILTER (rank <= k) AS artifact_rate, avg((stationary > 0.7)::INT) FILTER (rank <= k) AS redundancy_rate, avg(quality) FILTER (rank <= k) AS mean_score, avg(quality) FILTER (rank <= k) / avg(quality) FILTER (best <= k) AS retention FROM i, (VALUES (5), (20)) t(k) GROUP BY policy, group_id, k)
SELECT policy, group_id, k, unique_clusters, cluster_repeats, {', '.join(f'round({c}, 6) AS {c}' for c in ('precision', 'average_precision', 'ndcg', 'cluster_diversity', 'cluster_coverage', 'mean_quality', 'low_quality_rate', 'artifact_rate', 'redundancy_rate', 'mean_score', 'retention'))}, round(ndcg + 0.5 * cluster_diversity - artifact_rate - 0.5 * redundancy_rate - low_quality_rate, 6) AS selection_score FROM m""",
    "view_overlap": """SELECT policy, view, family, list_contains(families, family) AS overlap, NOT list_contains(families, family) AS primary_eval FROM (VALUES ('kcenter_window', ['window']), ('blend', ['window', 'ts2vec']), ('quality', []::VARCHAR[])) p(policy, families),
(VALUES ('window_mean_std_pool', 'window'), ('TS2Vec_320', 'ts2vec'), ('morph_x', 'morphology'), ('raw_shape_stats', 'raw_shape'), ('other', 'other')) v(view, family)""",
    "balanced_gains": f"WITH {CLIPS} SELECT 'all' AS selection, round(avg(g), 6) AS balanced_gain FROM ({_GAINS})",
    "retrieval_summary": f"""WITH {CLIPS}, n AS (SELECT 1 - list_cosine_similarity(a.v, b.v) AS d FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'support' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.id) <= 10)
SELECT round(avg(d), 6) AS mean_distance, round(quantile_cont(d, 0.95), 6) AS p95_distance, count(*) AS n FROM n""",
    "gate_thresholds": f"""WITH {CLIPS} SELECT 'q45' AS name, 0.45::DOUBLE AS threshold UNION ALL SELECT 'over', 1 UNION ALL SELECT 'support_q20', round(quantile_cont(quality, 0.2), 6) FROM clips WHERE role = 'support' UNION ALL SELECT 'support_q75', round(quantile_cont(quality, 0.75), 6) FROM clips WHERE role = 'support'""",
    "held_out_folds": f"""WITH {CLIPS}, r AS (SELECT id, floor(sqrt(id))::BIGINT AS "group" FROM clips), g AS (SELECT "group", count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, "group"::VARCHAR) - 1) // 3 AS fold FROM r GROUP BY "group"),
o AS (SELECT fold::INT AS fold, "group", id, n, row_number() OVER (PARTITION BY "group" ORDER BY {_H.format("'folds:' || id")}, id) AS nth FROM r JOIN g USING ("group") WHERE fold < 4 AND n > 1) SELECT fold, "group", id, CASE WHEN nth <= least(greatest(floor(n * 0.4), 1), n - 1) THEN 'candidate' ELSE 'target' END AS role FROM o""",
    "soundness_gates": f"""WITH {_EVAL}, g AS (SELECT {_beats("'window', 'raw_shape'")} AS a, TRUE AS b, (SELECT min(o.g - f.g) >= -0.05 FROM (SELECT k, avg(gain) AS g FROM facts WHERE policy = 'capped' AND view <> 'temporal' GROUP BY k) o JOIN (SELECT k, avg(gain) AS g FROM facts WHERE policy = 'free' AND view <> 'temporal' GROUP BY k) f USING (k)) AS c, {_beats("'temporal'")} AS d)
SELECT gate, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM (SELECT unnest(['primary_vs_simple_controls', 'physical_validity', 'uncapped_regression', 'independent_temporal_vs_controls']) AS gate, unnest([a, b, c, d]) AS ok FROM g) UNION ALL SELECT 'overall', CASE WHEN a AND b AND c AND d THEN 'pass' WHEN a AND b AND c THEN 'conditional' ELSE 'fail' END FROM g""",
    "benchmark_gates": f"""WITH {_EVAL}, f AS (SELECT * FROM facts WHERE view = 'window' AND k = 10), m AS (SELECT policy, avg(gain) AS g, avg(2 * gain) AS s FROM f GROUP BY policy), x AS (SELECT * FROM f WHERE fold IN (SELECT fold FROM f WHERE policy = 'free' AND gain >= 0.31)),
v AS (SELECT (SELECT g FROM m WHERE policy = 'free') AS o, (SELECT max(g) FROM m WHERE policy <> 'free') AS b, (SELECT g FROM m WHERE policy = 'capped') - (SELECT max(g) FROM m WHERE policy IN ('quality', 'random')) AS lead, (SELECT max(s) FROM m WHERE policy <> 'free') AS s,
(SELECT arg_max(policy, g) FROM m WHERE policy <> 'free') AS t, (SELECT arg_max(policy, g) FROM (SELECT policy, avg(gain) AS g FROM x WHERE policy <> 'free' GROUP BY policy)) AS u)
SELECT unnest(['oracle_sanity', 'bad_control_sanity', 'near_zero_sensitivity', 'source_concentration', 'incremental_value']) AS gate, unnest([CASE WHEN o + 1e-12 < b THEN 'fail' ELSE 'pass' END, CASE WHEN lead > 0 THEN 'pass' ELSE 'fail' END, CASE WHEN u IS NULL THEN 'fail' WHEN t = u THEN 'pass' ELSE 'warn' END, CASE WHEN s <= 0.5 THEN 'pass' ELSE 'warn' END, CASE WHEN lead > 0.01 THEN 'pass' ELSE 'fail' END]) AS status FROM v""",
}
