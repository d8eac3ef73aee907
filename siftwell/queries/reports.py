"""Queries on reports and evaluations over rankings and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from ..operators import audits, metrics, neighbors, ranking, reports, representations, scores, tokens as tk
from ..plans import rerank
from ..storage import materialise
from .base import CLIPS, SCORED, TOKENS, candidates, clips, rounded, tokens
from .evaluation import _GROUPS, _RANKED, _facts, _groups, _ranked
from .evaluation import ORACLES as _EVALUATION
from .greedy_sql import BATCHES, CLUSTER_CAP, K_CENTER, MMR
from .labels import _eval_facts
from .labels import ORACLES as _LABELS
from .ranking import _batches
from .ranking import ORACLES as _RANKING
from .sequences import _DIMS, _learned, _window_vectors
from .sequences import ORACLES as _SEQUENCES


def shadow_deltas(spark, sf_dir):
    """The ranking with grammar's part against the one without."""
    rows = scores.scored(candidates(spark, sf_dir))
    base = ranking.score_order(rows.withColumn("score", F.col("final_score")))
    new = ranking.score_order(scores.grammar_promotion(rows).withColumn("score", F.col("final_score")))
    return rounded(reports.rank_deltas(base, new, [10, 50]))


def sampling_stability(spark, sf_dir):
    """Novelty over three random halves of the support."""
    c = clips(spark, sf_dir)
    runs = spark.range(1, 4).select(F.col("id").alias("run"))
    support = c.filter("role = 'support'").select("id", "v").join(F.broadcast(runs), F.lit(True)).filter(stable_random(F.concat(F.lit("half"), F.col("run")), F.col("id")) < 0.5)
    out = reports.novelty_by_run(runs, c.filter("role = 'candidate'"), support, 5)
    return rounded(reports.rank_stability(out, [10, 50]))


def leave_cluster_out(spark, sf_dir):
    """Each group held out of the support; candidates of the group should rank first."""
    c = clips(spark, sf_dir)
    runs = c.select(F.col("group_id").cast("long").alias("run")).distinct()
    out = reports.novelty_without_group(runs, c.filter("role = 'candidate'"), c.filter("role = 'support'"), "group_id", 5).join(c.select("id", "group_id"), "id")
    rows = out.withColumn("label", (F.col("group_id") == F.col("run")).cast("int")).withColumn("cluster", F.col("group_id")).withColumn("corrupted", F.lit(False))
    return rounded(metrics.ranking_metrics(rows, 10, ["run"]).drop("corruption_rate"))


def pseudo_evaluation(spark, sf_dir):
    """New clips are positives, a sample of old ones and corrupted copies negatives; ranked by quality times novelty."""
    c = clips(spark, sf_dir)
    held = stable_random(F.lit("negative"), F.col("id")) < 0.2
    old = c.filter("role = 'support'")
    rows = c.filter("role = 'candidate'").select("id", "v", "quality", "group_id", F.lit(1).alias("label"), F.lit(False).alias("corrupted"))
    rows = rows.unionByName(old.filter(held).select("id", "v", "quality", "group_id", F.lit(0).alias("label"), F.lit(False).alias("corrupted")))
    rows = rows.unionByName(c.filter("role = 'candidate' and id % 4 = 0").select((F.col("id") + 1_000_000).alias("id"), F.transform("v", lambda x: -x).alias("v"), (F.col("quality") * 0.5).alias("quality"), "group_id", F.lit(0).alias("label"), F.lit(True).alias("corrupted")))
    scored = rows.join(neighbors.novelty(rows, old.filter(~held), 5), "id").withColumn("score", F.col("quality") * F.col("novelty")).withColumn("cluster", F.col("group_id"))
    return rounded(metrics.ranking_metrics(ranking.score_order(scored).withColumn("kind", F.lit("all")), 50, ["kind"]))


def trace_packs(spark, sf_dir):
    """The artefact gate's first ten, the ten after, and what the gate pushed out, by flags."""
    base = ranking.score_order(scores.scored(candidates(spark, sf_dir)).withColumn("score", F.col("final_score")))
    rows = ranking.passed_first(base, F.col("artifact") <= 0.05)
    flags = F.array_compact(F.array(F.when(F.col("quality") < 0.5, F.lit("low_quality")), F.when(F.col("artifact") > 0.05, F.lit("artifact")), F.when(F.col("stationary") > 0.8, F.lit("still")), F.lit("any")))
    return rounded(reports.pack_summary(reports.audit_packs(rows, 10), flags))


def gate_effect(spark, sf_dir):
    return reports.selection_effect(_ranked(spark, sf_dir).filter("policy <> 'random' or group_id = 1"), "policy", "quality", "stationary", ["group_id"], 20)


def selection_contrasts(spark, sf_dir):
    c = clips(spark, sf_dir)
    return rounded(reports.selection_contrasts(ranking.top_k(ranking.quality_order(c.filter("role = 'candidate'")), 20), c.filter("role = 'candidate'"), ["quality", "stationary", "max_abs", "artifact"]))


def regime_mix(spark, sf_dir):
    c = clips(spark, sf_dir).withColumn("regime", F.concat(F.lit("r"), F.floor(F.col("stationary") * 4).cast("string")))
    return rounded(reports.regime_mix(c.filter("max_abs > 60"), c, "regime"))


def validation_report(spark, sf_dir):
    return rounded(reports.validation_report(_facts(spark, sf_dir), "policy", "value", "episode", "random", 50))


def claim_memo(spark, sf_dir):
    gates = audits.soundness_gates(_eval_facts(spark, sf_dir), "capped", "free", ["quality", "random"], ["window", "raw_shape"], ["temporal"], tolerance=0.05)
    return reports.memo(gates)


def candidate_roles(spark, sf_dir):
    c = clips(spark, sf_dir)
    own = c.filter("role = 'candidate'")
    near = neighbors.knn_join(own, own, 1, leave_self_out=True).select(F.col("query_id").alias("id"), (1 - F.col("distance")).alias("nearest_similarity"))
    out = reports.candidate_roles(own.select("id", "group_id", "quality").join(near, "id"), c.filter("role = 'support' and group_id < 6"), 0.15, 0.45)
    return rounded(out)


def family_label_holdout(spark, sf_dir):
    return reports.family_label_holdout(_groups(spark, sf_dir), 3, 2, 2, 10)


def token_support(spark, sf_dir):
    v = materialise(representations.token_histogram(tokens(spark, sf_dir), 4).select(F.col("seq").alias("id"), "v"), "histograms")
    return rounded(reports.token_support(v, neighbors.knn_of_copies(v, 10)))


def grammar_pipeline(spark, sf_dir):
    """Fitted on even users' events, scored on odd users'; the splits share no sequence."""
    known, new = _learned(tokens(spark, sf_dir))
    splits = known.select(F.col("seq").alias("id"), F.lit("fit").alias("split")).unionByName(new.select(F.col("seq").alias("id"), F.lit("score").alias("split"))).distinct()
    n = audits.disjoint(splits).groupBy("split").agg(F.count("*").alias("sequences"))
    features = tk.sequence_features(new, tk.fit_grammar(known)).agg(F.avg("token_nll_mean").alias("mean_nll"), F.percentile("token_nll_p95", F.lit(0.9)).alias("p90_of_p95"))
    return rounded(n.join(F.broadcast(features), F.lit(True)), 5)


def masked_pool(spark, sf_dir):
    v = reports.masked_pool(_window_vectors(spark, sf_dir), F.pmod(F.col("clip") + F.col("window_idx"), F.lit(3)) > 0)
    return rounded(v.select("clip", F.posexplode("v").alias("dim", "x")))


def rerankers(spark, sf_dir):
    return rerank.rerank(_batches(spark, sf_dir), sorted(rerank.RERANKERS))


def group_counts(spark, sf_dir):
    return clips(spark, sf_dir).groupBy("role", "group_id").agg(F.count("*").alias("n"))


def sql_surface(spark, sf_dir):
    """A query in SQL over the registered views and functions."""
    rerank.register(spark, sf_dir, ["embeddings"])
    return rounded(spark.sql("SELECT a.vec_id AS id, round(stable_draw('sql', CAST(a.vec_id AS STRING)), 6) AS draw, cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))


_ALL = (
    shadow_deltas, sampling_stability, leave_cluster_out, pseudo_evaluation, trace_packs, gate_effect, selection_contrasts, regime_mix, validation_report, claim_memo, candidate_roles, family_label_holdout, token_support,
    grammar_pipeline, masked_pool, rerankers, group_counts, sql_surface,
)
QUERIES = {f.__name__: f for f in _ALL}

_H = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
_METRICS = """round(avg((label > 0)::INT) FILTER (rank <= {k}), 6) AS precision, round(coalesce(sum(hits / rank) FILTER (rank <= {k} AND label > 0) / least(sum((label > 0)::INT), {k}), 0), 6) AS average_precision,
round(coalesce(sum((pow(2, label) - 1) / log2(rank + 1)) FILTER (rank <= {k}) / sum((pow(2, label) - 1) / log2(ideal + 1)) FILTER (ideal <= {k}), 0), 6) AS ndcg, round(coalesce(count(DISTINCT cluster) FILTER (rank <= {k} AND label > 0) / nullif(count(*) FILTER (rank <= {k} AND label > 0), 0), 0), 6) AS cluster_diversity"""
_PLACES = "row_number() OVER (PARTITION BY {by} ORDER BY label DESC, rank) AS ideal, sum((label > 0)::INT) OVER (PARTITION BY {by} ORDER BY rank) AS hits"
_FEATURES = ["quality", "stationary", "max_abs", "artifact"]


def _reranked() -> str:
    """Each reranker's SQL as a part; those that are windows over the batches' rows, and those that other queries state."""
    orders = {
        "score": "score DESC, quality DESC, id",
        "quality_only": "quality DESC, novelty DESC, id",
        "quality_gated_old_novelty": "ok DESC, novelty DESC, quality DESC, id",
    }
    rows = f"{BATCHES.replace('quality, gap, gap_w', 'quality, novelty, gap, gap_w')}"
    parts = [f"SELECT '{n}' AS reranker, batch, id, row_number() OVER (PARTITION BY batch ORDER BY {o}) AS rank FROM cand" for n, o in orders.items()]
    capped = "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ok DESC, novelty DESC, quality DESC, id) AS br FROM cand"
    capped = f"SELECT *, ok AND row_number() OVER (PARTITION BY batch, cluster, ok ORDER BY br) <= 2 AS within FROM ({capped})"
    parts.append(f"SELECT 'source_cap', batch, id, row_number() OVER (PARTITION BY batch ORDER BY within DESC, br) FROM ({capped})")
    parts += [f"SELECT '{n}', batch, id, rank FROM ({q})" for n, q in (("mmr", MMR), ("kcenter", K_CENTER), ("tiered_cluster_cap", CLUSTER_CAP))]
    parts.append(f"SELECT 'cluster_aware', batch, id, rank FROM ({CLUSTER_CAP.replace('step >= 30', 'step >= 0')})")
    parts.append(f"SELECT 'cluster_cap', batch, id, rank FROM ({CLUSTER_CAP.replace('step >= 30', 'step >= 10')})")
    return f"WITH {rows} " + " UNION ALL ".join(parts)


ORACLES = {
    "shadow_deltas": f"""WITH a AS (SELECT s.id, s.final_score, quality FROM ({_RANKING['scored_reasons']}) s JOIN (WITH {CLIPS} SELECT id, quality FROM clips) q USING (id)), b AS (SELECT p.id, p.final_score, quality FROM ({_RANKING['grammar_promotion']}) p JOIN (WITH {CLIPS} SELECT id, quality FROM clips) q USING (id)),
x AS (SELECT id, row_number() OVER (ORDER BY final_score DESC, quality DESC, id) AS a FROM a), y AS (SELECT id, row_number() OVER (ORDER BY final_score DESC, quality DESC, id) AS b FROM b)
SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_change, max(abs(a - b)) AS largest_change, round(count(*) FILTER (a <= 10 AND b <= 10) / 10, 6) AS overlap_10, round(count(*) FILTER (a <= 50 AND b <= 50) / 50, 6) AS overlap_50 FROM x JOIN y USING (id)""",
    "sampling_stability": f"""WITH {CLIPS}, n AS (SELECT run, a.id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM clips a, clips b, range(1, 4) r(run) WHERE a.role = 'candidate' AND b.role = 'support' AND {_H.format("'half' || run || ':' || b.id")} / 281474976710655.0 < 0.5 QUALIFY row_number() OVER (PARTITION BY run, a.id ORDER BY d, b.id) <= 5),
k AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY avg(d) DESC, id) AS rank FROM n GROUP BY run, id) SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, round(corr(a.rank, b.rank), 6) AS spearman, round(count(*) FILTER (a.rank <= 10 AND b.rank <= 10) / 10, 6) AS overlap_10, round(count(*) FILTER (a.rank <= 50 AND b.rank <= 50) / 50, 6) AS overlap_50 FROM k a JOIN k b ON a.id = b.id AND a.run < b.run GROUP BY ALL""",
    "leave_cluster_out": f"""WITH {CLIPS}, n AS (SELECT g.run, a.id, a.group_id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM clips a, clips b, (SELECT DISTINCT group_id AS run FROM clips) g WHERE a.role = 'candidate' AND b.role = 'support' AND b.group_id <> g.run QUALIFY row_number() OVER (PARTITION BY run, a.id ORDER BY d, b.id) <= 5),
k AS (SELECT run, id, any_value(group_id) AS cluster, (any_value(group_id) = run)::INT AS label, row_number() OVER (PARTITION BY run ORDER BY avg(d) DESC, id) AS rank FROM n GROUP BY run, id), i AS (SELECT *, {_PLACES.format(by='run')} FROM k) SELECT run, {_METRICS.format(k=10)} FROM i GROUP BY run""",
    "pseudo_evaluation": f"""WITH {CLIPS}, h AS (SELECT *, role = 'support' AND {_H.format("'negative:' || id")} / 281474976710655.0 < 0.2 AS held FROM clips),
r AS (SELECT id, v, quality, group_id, (role = 'candidate')::INT AS label, FALSE AS corrupted FROM h WHERE role = 'candidate' OR held UNION ALL SELECT id + 1000000, list_transform(v, lambda x: -x), quality * 0.5, group_id, 0, TRUE FROM h WHERE role = 'candidate' AND id % 4 = 0),
n AS (SELECT r.id, 1 - list_cosine_similarity(r.v, b.v) AS d FROM r, h b WHERE b.role = 'support' AND NOT b.held QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY d, b.id) <= 5), s AS (SELECT r.*, quality * nov AS score FROM r JOIN (SELECT id, avg(d) AS nov FROM n GROUP BY id) USING (id)),
k AS (SELECT *, group_id AS cluster, 'all' AS kind, row_number() OVER (ORDER BY score DESC, quality DESC, id) AS rank FROM s), i AS (SELECT *, {_PLACES.format(by='kind')} FROM k) SELECT kind, {_METRICS.format(k=50)}, round(avg(corrupted::INT) FILTER (rank <= 50), 6) AS corruption_rate FROM i GROUP BY kind""",
    "trace_packs": f"""WITH {SCORED}, b AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, quality DESC, id) AS br, artifact > 0.05 AS failed FROM scored), r AS (SELECT *, row_number() OVER (ORDER BY failed, br) AS rank FROM b),
p AS (SELECT *, unnest(list_filter([CASE WHEN rank <= 10 THEN 'top' END, CASE WHEN rank BETWEEN 11 AND 20 THEN 'boundary' END, CASE WHEN failed AND br <= 10 AND rank > 10 THEN 'pushed_out' END], lambda x: x IS NOT NULL)) AS pack FROM r), f AS (SELECT pack, unnest(list_filter([CASE WHEN quality < 0.5 THEN 'low_quality' END, CASE WHEN failed THEN 'artifact' END, CASE WHEN stationary > 0.8 THEN 'still' END, 'any'], lambda x: x IS NOT NULL)) AS flag FROM p)
SELECT pack, flag, count(*) AS n, round(count(*) / any_value(o), 6) AS share FROM f JOIN (SELECT pack, count(*) AS o FROM p GROUP BY pack) USING (pack) GROUP BY pack, flag""",
    "gate_effect": f"""WITH {CLIPS}, {_RANKED}, a AS (SELECT group_id, id FROM ranked WHERE policy = 'quality' AND rank <= 20), b AS (SELECT group_id, id FROM ranked WHERE policy = 'stationary' AND rank <= 20)
SELECT coalesce(a.group_id, b.group_id) AS group_id, count(*) FILTER (b.id IS NULL) AS left_out, count(*) FILTER (a.id IS NULL) AS brought_in, count(*) FILTER (a.id IS NULL OR b.id IS NULL) = 0 AS no_op FROM a FULL JOIN b ON a.group_id = b.group_id AND a.id = b.id GROUP BY 1""",
    "selection_contrasts": f"""WITH {CLIPS}, c AS (SELECT *, row_number() OVER (ORDER BY quality DESC, id) AS r FROM clips WHERE role = 'candidate') """
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}) FILTER (r <= 20), 6) AS selected_mean, round(avg({f}), 6) AS pool_mean, round((avg({f}) FILTER (r <= 20) - avg({f})) / stddev_pop({f}), 6) AS contrast FROM c" for f in _FEATURES),
    "regime_mix": f"""WITH {CLIPS}, c AS (SELECT 'r' || floor(stationary * 4)::INT AS regime, count(*) AS p, count(*) FILTER (max_abs > 60) AS s FROM clips GROUP BY 1) SELECT regime, round(s / sum(s) OVER (), 6) AS selected_share, round(p / sum(p) OVER (), 6) AS pool_share, round(s / sum(s) OVER () / (p / sum(p) OVER ()), 6) AS lift FROM c""",
    "validation_report": f"SELECT policy, mean, n, low, high, mean_delta, median_delta, wins, ties, losses FROM ({_EVALUATION['bootstrap_intervals']}) a LEFT JOIN (SELECT * EXCLUDE (n) FROM ({_EVALUATION['paired_deltas']})) b USING (policy)",
    "claim_memo": f"""WITH g AS ({_LABELS['soundness_gates']}) SELECT CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'claims supported' ELSE count(*) FILTER (status = 'fail') || ' gates failed' END || chr(10) || string_agg(gate || ': ' || status, chr(10) ORDER BY gate || ': ' || status) AS text FROM g""",
    "candidate_roles": f"""WITH {CLIPS}, n AS (SELECT a.id, a.group_id, a.quality, max(list_cosine_similarity(a.v, b.v)) AS s FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'candidate' AND a.id <> b.id GROUP BY ALL)
SELECT group_id, id, round(quality, 6) AS quality, round(s, 6) AS nearest_similarity, CASE WHEN quality < 0.15 THEN 'low_quality' WHEN s >= 0.45 THEN 'near_duplicate' WHEN group_id IN (SELECT group_id FROM clips WHERE role = 'support' AND group_id < 6) THEN 'known_like' ELSE 'heldout_novel' END AS role FROM n""",
    "family_label_holdout": f"""WITH {_GROUPS}, f AS (SELECT family AS held, row_number() OVER (ORDER BY family) - 1 AS episode_id FROM g GROUP BY family HAVING count(*) > 2 QUALIFY episode_id < 3), e AS (SELECT episode_id, "group", family = held AS own, row_number() OVER (PARTITION BY episode_id, family = held ORDER BY "group") AS nth FROM g, f),
r AS (SELECT episode_id, "group", CASE WHEN own AND nth <= 2 THEN 'target' WHEN own AND nth <= 4 THEN 'candidate' WHEN own THEN 'unused' WHEN nth <= 10 THEN 'candidate' ELSE 'support' END AS role FROM e) SELECT * FROM r WHERE role <> 'unused'""",
    "token_support": f"""WITH {TOKENS}, top AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS place FROM tokens GROUP BY token QUALIFY place < 4), z AS (SELECT seq, count(*) AS n FROM tokens GROUP BY seq),
h AS MATERIALIZED (SELECT seq AS id, list(x ORDER BY place) AS v FROM (SELECT z.seq, top.place, count(t.token) / any_value(z.n) AS x FROM z CROSS JOIN top LEFT JOIN tokens t ON t.seq = z.seq AND t.token = top.token GROUP BY z.seq, top.place) GROUP BY seq),
m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM h) GROUP BY i)),
n AS (SELECT a.id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC) AS r FROM h a JOIN h b ON a.id <> b.id)
SELECT n.id, round(avg(s) FILTER (r <= 5), 6) AS top5, round(avg(s) FILTER (r <= 10), 6) AS top10, round(any_value(list_cosine_similarity(v, m)), 6) AS centroid_similarity FROM n JOIN h USING (id), m GROUP BY n.id""",
    "masked_pool": f"{_DIMS}, vx AS (SELECT * FROM x WHERE (clip + window_idx) % 3 > 0) " + " UNION ALL ".join(f"SELECT clip, dim + {6 * i} AS dim, round({s}, 6) AS x FROM vx GROUP BY clip, dim" for i, s in enumerate(("avg(x)", "max(x)", "stddev_pop(x)"))),
    "grammar_pipeline": f"""WITH {TOKENS}, f AS ({_SEQUENCES['token_surprisal']}) SELECT CASE WHEN seq % 2 = 0 THEN 'fit' ELSE 'score' END AS split, count(DISTINCT seq) AS sequences, (SELECT round(avg(token_nll_mean), 5) FROM f) AS mean_nll, (SELECT round(quantile_cont(token_nll_p95, 0.9), 5) FROM f) AS p90_of_p95 FROM tokens GROUP BY 1""",
    "rerankers": _reranked(),
    "group_counts": f"WITH {CLIPS} SELECT role, group_id, count(*) AS n FROM clips GROUP BY ALL",
    "sql_surface": f"SELECT a.vec_id AS id, round({_H.format(chr(39) + 'sql:' + chr(39) + ' || a.vec_id')} / 281474976710655.0, 6) AS draw, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
