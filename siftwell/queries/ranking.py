"""Queries on novelty, scores, orders, caps and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..operators import greedy, neighbors, ranking, scores
from . import greedy_sql
from .base import CLIPS, SCORED, candidates, clips, mm, rounded

REASON = """CASE WHEN quality < 0.45 THEN 'LOW_QUALITY' WHEN novelty_score >= 0.65 AND density_score >= 0.45 THEN 'COHESIVE_NEW_WORKFLOW' WHEN novelty_score >= 0.65 THEN 'HIGH_NOVELTY_SINGLETON'
  {rare}WHEN novelty_score < 0.35 AND density_score >= 0.65 THEN 'REDUNDANT_KNOWN_WORKFLOW' ELSE 'RARE_MOTION_PRIMITIVES' END"""
PLAIN_REASON = REASON.format(rare="")
GATE = "(quality >= 0.3 AND stationary <= 0.9 AND max_abs <= 60)"


def _gate():
    return ranking.passes(quality=0.3, stationary=0.9, max_abs=60.0)


def novelty_ranking(spark, sf_dir):
    """Gated candidates by novelty, at most two of a group before the rest."""
    order = ranking.gated_order(scores.scored(candidates(spark, sf_dir)), _gate())
    out = ranking.capped_order(order, "group_id", 2, F.col("passed")).withColumn("reason_code", scores.reason_code())
    return rounded(out.select("id", "group_id", "rank", "passed", "within_cap", "novelty", "density", "final_score", "reason_code"))


def support_features(spark, sf_dir):
    c = clips(spark, sf_dir)
    near = neighbors.knn_join(c.filter("role = 'candidate'"), c.filter("role = 'support'"), 10)
    return rounded(neighbors.support_features(near, (1, 5, 10)))


def nearest_neighbours(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(neighbors.knn_join(c.filter("role = 'candidate'"), c.filter("role = 'support'"), 3, "euclidean"))


def support_tau(spark, sf_dir):
    return rounded(neighbors.support_tau(clips(spark, sf_dir).filter("role = 'support'")))


def coverage_gain(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(neighbors.coverage(c.filter("role = 'target'"), c.filter("role = 'support'"), c.filter("role = 'candidate'"), tau=0.6))


def scored_reasons(spark, sf_dir):
    out = scores.scored(candidates(spark, sf_dir)).withColumn("reason_code", scores.reason_code())
    return rounded(out.select("id", "novelty_score", "density_score", "ranker_score", "final_score", "reason_code"))


def simple_ranking(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("cluster_size", F.count("*").over(Window.partitionBy("group_id", F.pmod("id", F.lit(3)))))
    out = scores.simple_ranking(rows)
    return rounded(out.select("id", "novelty_score", "support_score", "grammar_score", "final_score", "reason_code"))


def grammar_promotion(spark, sf_dir):
    out = scores.grammar_promotion(scores.scored(candidates(spark, sf_dir)))
    return rounded(out.select("id", "grammar_score", "grammar_component", "promotion", "final_score", "reason_code"))


def stationary_guard(spark, sf_dir):
    out = scores.stationary_guard(scores.scored(candidates(spark, sf_dir)))
    return rounded(out.select("id", "guarded", "unguarded_score", "ranker_score", "final_score"))


def spike_hygiene(spark, sf_dir):
    """The artefact gate's order and soft penalties over a base ranking."""
    base = ranking.score_order(scores.scored(candidates(spark, sf_dir)).withColumn("score", F.col("final_score")))
    out = ranking.passed_first(base, F.col("artifact") <= 0.05).withColumn("penalty", scores.spike_penalty(F.col("artifact"), 0.02, 0.5, 0.25))
    return rounded(out.select("id", "rank", "base_rank", "rank_score", "failed", "penalty"))


def score_recipes(spark, sf_dir):
    return rounded(scores.score_recipes(candidates(spark, sf_dir)))


def threshold_grid(spark, sf_dir):
    return scores.threshold_grid(scores.scored(candidates(spark, sf_dir)), [0.4, 0.5, 0.65], [0.3, 0.45])


def quality_orders(spark, sf_dir):
    """Quality, random and stratified random places of every clip within its role."""
    c = clips(spark, sf_dir).select("id", "role", "quality", "stationary", "max_abs")
    q = ranking.quality_order(c, ["role"]).withColumnRenamed("rank", "quality_place")
    r = ranking.random_order(q, "7", _gate(), ["role"]).withColumnRenamed("rank", "random_place").drop("draw")
    s = ranking.stratified_random_order(r, "9", 20, ["role"]).withColumnRenamed("rank", "stratified_place")
    return s.select("id", "role", "quality_place", "random_place", "stratified_place")


def failing_checks(spark, sf_dir):
    checks = {"quality": F.col("quality") >= 0.3, "stationary": F.col("stationary") <= 0.9, "max_abs": F.col("max_abs") <= 60}
    return clips(spark, sf_dir).select("id", ranking.failing(checks).alias("failing"))


def submission_scores(spark, sf_dir):
    base = ranking.score_order(scores.scored(candidates(spark, sf_dir)).withColumn("score", F.round("final_score", 3)))
    out = ranking.monotone_scores(base, "score", 1e-6)
    return rounded(out.select("id", "rank", "score", "submitted"), 8)


def hash_splits(spark, sf_dir):
    out = ranking.stratified_hash_split(clips(spark, sf_dir).select("id", "group_id"), "group_id", 0.25, "split")
    return out.withColumn("shard", F.pmod("id", F.lit(4))).select("id", "group_id", "split", "shard")


def worker_coverage(spark, sf_dir):
    return ranking.worker_coverage(clips(spark, sf_dir).select("id", "group_id"), "group_id", "id", 5)


def _batches(spark, sf_dir):
    c = scores.scored(candidates(spark, sf_dir))
    near = neighbors.nearest_distance(c, clips(spark, sf_dir).filter("role = 'support'")).withColumnRenamed("distance", "support_distance")
    return c.join(near, "id").withColumn("batch", F.pmod("id", F.lit(2)).cast("long")).withColumn("score", F.col("final_score")).withColumn("cluster", F.col("group_id")).withColumn("eligible", _gate()).withColumn("w", F.slice("v", 1, 16))


def k_center_selection(spark, sf_dir):
    """Farthest first within each of two batches."""
    return rounded(greedy.k_center(_batches(spark, sf_dir)))


def mmr_selection(spark, sf_dir):
    return rounded(greedy.mmr(_batches(spark, sf_dir)))


def cluster_cap_selection(spark, sf_dir):
    return rounded(greedy.cluster_capped(_batches(spark, sf_dir), [(10, 2), (30, 5)]))


def blended_k_center_selection(spark, sf_dir):
    rows = _batches(spark, sf_dir)
    w = clips(spark, sf_dir).filter("role = 'support'").select("id", F.slice("v", 1, 16).alias("v"))
    near = neighbors.nearest_distance(rows.select("id", F.col("w").alias("v")), w).withColumnRenamed("distance", "support_distance_w")
    return rounded(greedy.blended_k_center(rows.join(near, "id")))


def cover_gap_selection(spark, sf_dir):
    tau = neighbors.support_tau(clips(spark, sf_dir).filter("role = 'support'")).first()["tau"]
    return rounded(greedy.cover_gap(_batches(spark, sf_dir), tau))


def oracle_selection(spark, sf_dir):
    """Greedy selection that sees the targets: three rows of each batch."""
    c = clips(spark, sf_dir)
    targets = c.filter("role = 'target'")
    before = neighbors.nearest_distance(targets, c.filter("role = 'support'")).withColumnRenamed("distance", "before")
    rows = targets.join(before, "id").withColumn("batch", F.pmod("id", F.lit(2)).cast("long"))
    return rounded(greedy.oracle_greedy(_batches(spark, sf_dir), rows, 3))


def acquisition_rounds(spark, sf_dir):
    """Three rounds of five by k-center, what is chosen joining the support."""
    c = clips(spark, sf_dir).withColumn("batch", F.lit(0).cast("long")).filter("role <> 'target'")

    def order(own, support):
        near = neighbors.nearest_distance(own, support).withColumnRenamed("distance", "support_distance")
        return greedy.k_center(own.join(near, "id").withColumn("eligible", _gate()))

    return greedy.acquisition_rounds(c, 3, 5, order)


def random_draws(spark, sf_dir):
    return rounded(clips(spark, sf_dir).select("id", stable_random(F.lit("fold"), F.col("id")).alias("draw")))


QUERIES = {
    f.__name__: f
    for f in (
        novelty_ranking, support_features, nearest_neighbours, support_tau, coverage_gain, scored_reasons, simple_ranking, grammar_promotion, stationary_guard, spike_hygiene, score_recipes, threshold_grid,
        quality_orders, failing_checks, submission_scores, hash_splits, worker_coverage, k_center_selection, mmr_selection, cluster_cap_selection, blended_k_center_selection, cover_gap_selection, oracle_selection, acquisition_rounds, random_draws,
    )
}

_SUPPORT_NEAR = f"""WITH {CLIPS}, near AS (SELECT a.id AS query_id, b.id AS ref_id, 1 - list_cosine_similarity(a.v, b.v) AS distance FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'support'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM near)"""
_D = "('0x' || substr(sha256('{}:' || id), 1, 12))::BIGINT"

ORACLES = {
    "novelty_ranking": f"""WITH {SCORED}, gated AS (SELECT *, {GATE} AS passed FROM scored),
ordered AS (SELECT *, row_number() OVER (ORDER BY passed DESC, novelty DESC, quality DESC, id) AS base_rank FROM gated),
capped AS (SELECT *, passed AND row_number() OVER (PARTITION BY group_id, passed ORDER BY base_rank) <= 2 AS within_cap FROM ordered)
SELECT id, group_id, row_number() OVER (ORDER BY within_cap DESC, base_rank) AS rank, passed, within_cap, round(novelty, 6) AS novelty, round(density, 6) AS density, round(final_score, 6) AS final_score, {PLAIN_REASON} AS reason_code FROM capped""",
    "support_features": f"""{_SUPPORT_NEAR} SELECT query_id, {', '.join(f"round(avg(distance) FILTER (rank <= {k}), 6) AS mean_{k}, round(stddev_pop(distance) FILTER (rank <= {k}), 6) AS std_{k}" for k in (1, 5, 10))} FROM ranked GROUP BY query_id""",
    "nearest_neighbours": f"""WITH {CLIPS}, near AS (SELECT a.id AS query_id, b.id AS ref_id, list_distance(a.v, b.v) AS d FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'support'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM near) SELECT query_id, ref_id, round(d, 6) AS distance, rank FROM ranked WHERE rank <= 3""",
    "support_tau": f"""WITH {CLIPS}, near AS (SELECT a.id, min(1 - list_cosine_similarity(a.v, b.v)) AS d FROM clips a, clips b WHERE a.role = 'support' AND b.role = 'support' AND a.id <> b.id GROUP BY a.id) SELECT round(quantile_cont(d, 0.9), 6) AS tau FROM near""",
    "coverage_gain": f"""WITH {CLIPS}, near AS (SELECT a.id, min(1 - list_cosine_similarity(a.v, b.v)) FILTER (b.role = 'support') AS old, min(1 - list_cosine_similarity(a.v, b.v)) AS after FROM clips a, clips b WHERE a.role = 'target' AND b.role <> 'target' GROUP BY a.id)
SELECT round(avg(old), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(avg(old - after), 6) AS gain, round(avg(old - after) / greatest(avg(old), 1e-12), 6) AS relative_gain, round(avg(greatest((old - after) / greatest(old, 1e-12), 0)), 6) AS mean_relative_gain,
round(avg((old <= 0.6)::INT), 6) AS covered_before, round(avg((after <= 0.6)::INT), 6) AS covered_after, round(quantile_cont(old, 0.9) - quantile_cont(after, 0.9), 6) AS tail_gain FROM near""",
    "scored_reasons": f"""WITH {SCORED} SELECT id, round(novelty_score, 6) AS novelty_score, round(density_score, 6) AS density_score, round(ranker_score, 6) AS ranker_score, round(final_score, 6) AS final_score, {PLAIN_REASON} AS reason_code FROM scored""",
    "simple_ranking": f"""WITH {SCORED}, sized AS (SELECT *, count(*) OVER (PARTITION BY group_id, id % 3) AS cluster_size FROM base),
parts AS (SELECT *, 0.5 * (CASE WHEN max(novelty) OVER () - min(novelty) OVER () <= 1e-12 THEN least(greatest(novelty, 0), 1) ELSE (novelty - min(novelty) OVER ()) / (max(novelty) OVER () - min(novelty) OVER ()) END) + 0.5 * least(greatest(novelty, 0), 1) AS n,
least(greatest(0.65 * density + 0.35 * ln(1 + greatest(cluster_size, 1)) / ln(11), 0), 1) AS s, least(greatest(0.6 * (1 - exp(-greatest(token_nll_p95, 0) / 4)) + 0.4 * rare_phrase, 0), 1) AS g FROM sized)
SELECT id, round(n, 6) AS novelty_score, round(s, 6) AS support_score, round(g, 6) AS grammar_score, round(least(greatest(quality * (CASE WHEN cluster_size <= 1 THEN 0.75 ELSE 1 END) * (0.5 * n + 0.3 * s + 0.2 * g), 0), 1), 6) AS final_score,
CASE WHEN quality < 0.45 THEN 'LOW_QUALITY' WHEN n >= 0.5 AND s >= 0.45 THEN 'COHESIVE_NEW_WORKFLOW' WHEN rare_phrase >= 0.2 OR token_nll_p95 >= 3 THEN 'RARE_TEMPORAL_COMPOSITION' WHEN n >= 0.65 THEN 'HIGH_NOVELTY_SINGLETON'
WHEN s >= 0.65 AND n < 0.3 THEN 'REDUNDANT_KNOWN_WORKFLOW' WHEN g > 0.25 THEN 'RARE_MOTION_PRIMITIVES' ELSE 'REDUNDANT_KNOWN_WORKFLOW' END AS reason_code FROM parts""",
    "grammar_promotion": f"""WITH {SCORED}, m AS (SELECT *, 0.65 * ({mm('token_nll_p95')}) + 0.25 * ({mm('transition_nll_p95')}) + 0.1 * ({mm('longest_unseen')}) AS mix FROM scored), g AS (SELECT *, {mm('mix')} AS grammar_score FROM m),
c AS (SELECT *, CASE WHEN has_grammar THEN grammar_score * density_score * (quality >= 0.45 AND density_score >= 0.35)::INT ELSE 0 END AS grammar_component FROM g),
f AS (SELECT * EXCLUDE (final_score), final_score AS base_score, CASE WHEN has_grammar THEN least(greatest(quality * (0.8 * ranker_score + 0.2 * grammar_component), 0), 1) ELSE final_score END AS final_score FROM c),
p AS (SELECT *, CASE WHEN has_grammar THEN final_score - base_score ELSE 0 END AS promotion FROM f)
SELECT id, round(grammar_score, 6) AS grammar_score, round(grammar_component, 6) AS grammar_component, round(promotion, 6) AS promotion, round(final_score, 6) AS final_score,
{REASON.format(rare="WHEN grammar_component >= 0.75 AND promotion >= 0.08 AND density_score >= 0.35 THEN 'RARE_TEMPORAL_COMPOSITION' ")} AS reason_code FROM p""",
    "stationary_guard": f"""WITH {SCORED}, g AS (SELECT *, novelty_score >= 0.65 AND density_score < 0.35 AND stationary >= 0.9 AS guarded FROM scored), r AS (SELECT * EXCLUDE (ranker_score), CASE WHEN guarded THEN ranker_score * 0.35 ELSE ranker_score END AS ranker_score FROM g)
SELECT id, guarded, round(final_score, 6) AS unguarded_score, round(ranker_score, 6) AS ranker_score, round(CASE WHEN guarded THEN quality * ranker_score ELSE final_score END, 6) AS final_score FROM r""",
    "spike_hygiene": f"""WITH {SCORED}, b AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, quality DESC, id) AS base_rank, artifact > 0.05 AS failed FROM scored), o AS (SELECT *, row_number() OVER (ORDER BY failed, base_rank) AS rank, count(*) OVER () AS n FROM b)
SELECT id, rank, base_rank, round((n - rank + 1)::DOUBLE / n, 6) AS rank_score, failed, round(CASE WHEN artifact <= 0.02 THEN 1 ELSE greatest(0.25, 1 - 0.5 * (artifact - 0.02) / 0.02) END, 6) AS penalty FROM o""",
    "score_recipes": f"""WITH {SCORED}, w AS (SELECT id, quality, novelty_score AS novelty, density_score AS density, ranker_score AS novelty_density, quality * novelty_score AS quality_novelty, final_score AS quality_novelty_density FROM scored)
SELECT id, recipe, round(value, 6) AS value FROM (UNPIVOT w ON quality, novelty, density, novelty_density, quality_novelty, quality_novelty_density INTO NAME recipe VALUE value)""",
    "threshold_grid": f"""WITH {SCORED}, g AS (SELECT a AS novelty_at, b AS density_at, CASE WHEN quality < 0.45 THEN 'LOW_QUALITY' WHEN novelty_score >= a AND density_score >= b THEN 'COHESIVE_NEW_WORKFLOW' WHEN novelty_score >= a THEN 'HIGH_NOVELTY_SINGLETON' WHEN density_score >= b THEN 'REDUNDANT_KNOWN_WORKFLOW' ELSE 'RARE_MOTION_PRIMITIVES' END AS reason_code
FROM scored, (VALUES (0.4::DOUBLE), (0.5), (0.65)) x(a), (VALUES (0.3::DOUBLE), (0.45)) y(b)) SELECT novelty_at, density_at, reason_code, count(*) AS n FROM g GROUP BY ALL""",
    "quality_orders": f"""WITH {CLIPS}, q AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY quality DESC, id) AS quality_place, row_number() OVER (PARTITION BY role ORDER BY {GATE} DESC, {_D.format('7')}, id) AS random_place FROM clips)
SELECT id, role, quality_place, random_place, row_number() OVER (PARTITION BY role ORDER BY quality_place <= 40 DESC, CASE WHEN quality_place <= 40 THEN {_D.format('9')} END NULLS LAST, quality_place) AS stratified_place FROM q""",
    "failing_checks": f"""WITH {CLIPS} SELECT id, concat_ws(',', CASE WHEN NOT quality >= 0.3 THEN 'quality' END, CASE WHEN NOT stationary <= 0.9 THEN 'stationary' END, CASE WHEN NOT max_abs <= 60 THEN 'max_abs' END) AS failing FROM clips""",
    "submission_scores": f"""WITH {SCORED}, s AS (SELECT id, quality, round(final_score, 3) AS score FROM scored), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, quality DESC, id) AS rank FROM s)
SELECT id, rank, score, round(min(score + 1e-6 * rank) OVER (ORDER BY rank) - 1e-6 * rank, 8) AS submitted FROM r""",
    "hash_splits": f"""WITH {CLIPS}, r AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {_D.format('split')}, id) AS nth, count(*) OVER (PARTITION BY group_id) AS n FROM clips)
SELECT id, group_id, CASE WHEN nth <= least(greatest(round_even(n * 0.25, 0), 1), greatest(n - 1, 1)) THEN 'eval' ELSE 'train' END AS split, id % 4 AS shard FROM r""",
    "worker_coverage": f"""WITH {CLIPS} SELECT id, group_id FROM (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY id) AS r FROM clips) WHERE r <= 5""",
    "random_draws": f"""WITH {CLIPS} SELECT id, round({_D.format('fold')} / 281474976710655.0, 6) AS draw FROM clips""",
}

ORACLES.update(greedy_sql.ORACLES)
