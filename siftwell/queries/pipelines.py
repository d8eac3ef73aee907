"""Queries that run whole plans: selection, benchmark, submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes, ranking, scores
from ..plans import benchmark, select as select_plan
from ..sources import readers
from .base import SCORED, candidates, clips, rounded, series
from .ranking import GATE, PLAIN_REASON


def select_clips(spark, sf_dir):
    """Suppliers' series: a third are candidates against the others."""
    s = series(spark, sf_dir)
    support, own = s.filter(F.pmod("clip", F.lit(3)) < 2), s.filter(F.pmod("clip", F.lit(3)) == 2)
    out = select_plan.select(support, own, select_plan.SelectConfig(min_quality=0.1, max_abs=200.0, similarity=0.9999))
    return out.select("clip", "rank", "passed", "within_cap", "novelty", "density", "final_score", "quality", "cluster", "cluster_size", "reason_code")


def coverage_benchmark(spark, sf_dir):
    """Policies and budgets over episodes of groups, as coverage facts."""
    c = clips(spark, sf_dir).drop("role").withColumn("group", F.pmod("id", F.lit(25))).withColumn("score", F.col("quality")).withColumn("cluster", F.col("group_id"))
    members = episodes.source_blocked(c.select("group").distinct(), 2, 4, 8)
    return rounded(benchmark.run(c, members, ["quality_only", "random_valid", "kcenter_quality_gated"], [5, 10], ranking.passes(quality=0.3, artifact=0.09)))


def policy_orders(spark, sf_dir):
    """Every policy that a window states, over the gated candidates of two batches: their orders."""
    from .ranking import _batches

    rows = _batches(spark, sf_dir).filter(F.col("eligible"))
    names = ["quality_only", "old_novelty_only", "old_novelty_quality_gated", "quality_then_novelty", "source_capped_novelty", "artifact_gated_novelty", "score", "random_valid", "random_valid_replay_7"]
    out = None
    for name in names:
        one = benchmark.policy(name)(rows).select(F.lit(name).alias("policy"), "batch", "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def submission_rows(spark, sf_dir):
    rows = ranking.score_order(scores.scored(candidates(spark, sf_dir)).withColumn("score", F.col("novelty"))).withColumn("reason_code", scores.reason_code())
    return rounded(readers.submission(rows))


QUERIES = {f.__name__: f for f in (select_clips, coverage_benchmark, policy_orders, submission_rows)}
_ORDERS = {
    "quality_only": "quality DESC, id", "old_novelty_only": "novelty DESC, id", "old_novelty_quality_gated": "novelty DESC, quality DESC, id", "quality_then_novelty": "quality DESC, novelty DESC, id",
    "source_capped_novelty": "nth <= 2 DESC, novelty DESC, quality DESC, id", "artifact_gated_novelty": "artifact > 0.05, novelty DESC, quality DESC, id", "score": "final_score DESC, quality DESC, id",
    "random_valid": "('0x' || substr(sha256('random:' || id), 1, 12))::BIGINT, id", "random_valid_replay_7": "('0x' || substr(sha256('random_valid_replay_7:' || id), 1, 12))::BIGINT, id",
}
ORACLES = {
    "policy_orders": f"""WITH {SCORED}, c AS (SELECT *, id % 2 AS batch, row_number() OVER (PARTITION BY id % 2, group_id ORDER BY novelty DESC, quality DESC, id) AS nth FROM scored WHERE {GATE}) """
    + " UNION ALL ".join(f"SELECT '{n}' AS policy, batch, id, row_number() OVER (PARTITION BY batch ORDER BY {o}) AS rank FROM c" for n, o in _ORDERS.items()),
    "submission_rows": f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY novelty DESC, quality DESC, id) AS before FROM scored)
SELECT id::VARCHAR AS worker_id, row_number() OVER (ORDER BY final_score DESC, before) AS rank, round(final_score, 6) AS score, round(quality, 6) AS quality_score, {PLAIN_REASON} AS reason_code FROM r""",
}
