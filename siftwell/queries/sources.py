"""Queries that write files made from the provided tables to the shared folder and read them with the sources' readers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import labels, ranking, scores
from ..operators.timeseries import CHANNELS
from ..sources import readers
from ..storage import workspace
from .base import CLIPS, SCORED, SERIES, TOKENS, candidates, clips, rounded, series, table, tokens
from .ranking import GATE, PLAIN_REASON, _gate


def _by_clip(rows, value, path):
    """A directory per clip with one text file of the lines ``value`` in order."""
    rows.select("clip", "idx", value.alias("value")).repartition("clip").sortWithinPartitions("clip", "idx").select("clip", "value").write.partitionBy("clip").text(path)


def _clip_of(path_column):
    return F.regexp_extract(path_column, r"clip=(\d+)", 1).cast("long")


def jsonl_series(spark, sf_dir):
    """Series as JSON lines in four shapes of record, the first 200 samples of each clip."""
    s, path = series(spark, sf_dir).filter("clip <= 20"), workspace(spark, "jsonl")
    acc, gyro = (F.array(*CHANNELS[i : i + 3]) for i in (0, 3))
    micros = F.round(F.col("ts") * 1e6).cast("long").alias("t_us")
    shapes = [
        F.to_json(F.struct(micros, acc.alias("acc"), gyro.alias("gyro"))),
        F.to_json(F.struct(F.col("ts").alias("timestamp"), acc.alias("a?c"), gyro.alias("gyro"))),
        F.to_json(F.struct(F.col("ts").alias("timestamp"), *CHANNELS)),
        F.concat(F.lit("\r\n"), F.to_json(F.struct(micros, *[F.col(c).alias(f"x{i}") for i, c in enumerate(CHANNELS)])), F.lit("\r")),
    ]
    line = shapes[0]
    for i in (1, 2, 3):
        line = F.when(F.pmod("clip", F.lit(4)) == i, shapes[i]).otherwise(line)
    _by_clip(s, line, path)
    got = readers.read_jsonl(spark, path, max_samples=200)
    return rounded(got.withColumn("clip", _clip_of("clip")).select("clip", "idx", F.round("ts", 3).alias("ts"), *CHANNELS))


def csv_series(spark, sf_dir):
    """Series as CSV files with three kinds of header."""
    s, path = series(spark, sf_dir).filter("clip <= 12"), workspace(spark, "csv")
    heads = ["TIME,ACC_X,Acc_Y,acc_z,Gyro_X,gyro_y,gyro_z", "a,b,c,d,e,f,time", "gyro_z,gyro_y,gyro_x,acc_z,acc_y,acc_x"]
    rows = [F.concat_ws(",", "ts", *CHANNELS), F.concat_ws(",", *CHANNELS, "ts"), F.concat_ws(",", *CHANNELS[::-1])]
    kind = F.pmod("clip", F.lit(3))
    line = F.when(kind == 0, F.concat(F.when(F.col("idx") == 0, heads[0] + "\n").otherwise(""), rows[0])).when(kind == 1, F.concat(F.when(F.col("idx") == 0, heads[1] + "\n").otherwise(""), rows[1])).otherwise(F.concat(F.when(F.col("idx") == 0, heads[2] + "\n").otherwise(""), rows[2]))
    _by_clip(s, line, path)
    got = readers.read_worker_csv(spark, path)
    return rounded(got.withColumn("clip", _clip_of("clip")).select("clip", "idx", F.round("ts", 3).alias("ts"), *CHANNELS))


def csv_manifest(spark, sf_dir):
    """Customers as a manifest: ids that are blank come from the worker, else from the path."""
    c, path = table(spark, sf_dir, "customer"), workspace(spark, "manifest")
    k = F.col("c_custkey")
    rows = c.select(F.when(k % 3 == 0, F.concat(F.lit("s"), k)).alias("sample_id"), F.when(k % 3 == 1, F.concat(F.lit("w"), k)).alias("worker_id"), F.concat(F.lit("data/dir/clip_"), k, F.lit(".jsonl")).alias("file_path"))
    rows.write.csv(path, header=True)
    return readers.csv_manifest(spark, path)


def line_manifest(spark, sf_dir):
    """URLs a line with comments and blank lines between."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey"), workspace(spark, "lines")
    k = F.col("c_custkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://host.example/a/worker_"), k % 7, F.lit("/clip_"), k, F.lit(".jsonl?x=1"))).otherwise(F.concat(F.lit("  /plain/dir/file"), k, F.lit(".csv")))
    c.coalesce(1).sortWithinPartitions("c_custkey").select(F.concat(F.when(k % 5 == 0, "# note\n\n").otherwise(""), url).alias("value")).write.text(path)
    return readers.line_manifest(spark, path)


def shard_reading(spark, sf_dir):
    """Embeddings in two views; ids that come again in a later shard; the first shard alone; and the manifest's order."""
    path = workspace(spark, "shards")
    c = clips(spark, sf_dir).select("id", "v")
    views = {"whole": F.col("v"), "head": F.slice("v", 1, 4)}
    for view, v in views.items():
        rows = c.select("id", v.alias("v"), F.lit(view).alias("view"))
        again = rows.filter("id % 10 = 0").withColumn("v", F.transform("v", lambda x: x + 1))
        for name, part in (("a", rows.filter("id % 3 > 0")), ("b", rows.filter("id % 3 = 0").unionByName(again))):
            part.drop("view").coalesce(1).sortWithinPartitions("id", "v").write.parquet(f"{path}-{name}/view={view}")
    both = f"{path}-all"
    # shards are files; names decide their order
    for name in "ab":
        spark.read.parquet(f"{path}-{name}").coalesce(1).sortWithinPartitions("view", "id", "v").write.mode("append").partitionBy("view").parquet(both)
    got = readers.read_embeddings(spark, f"{path}-b", view="head", ids=c.filter("id % 2 = 0").select("id"))
    manifest = c.filter("id % 30 = 0").select("id", (-F.col("id")).alias("pos"))
    placed = readers.in_order(got, manifest).select(F.lit("ordered").alias("kind"), "pos", "id", F.element_at("v", 1).alias("x"))
    first = readers.read_shards(spark, f"{path}-b", "whole", 1).select(F.lit("shard").alias("kind"), F.lit(0).cast("long").alias("pos"), "id", F.element_at("v", 1).alias("x"))
    n = readers.read_embeddings(spark, both).groupBy("view").agg(F.count("*").alias("pos"), F.sum("id").alias("id")).select(F.col("view").alias("kind"), "pos", "id", F.lit(None).cast("double").alias("x"))
    return rounded(placed.unionByName(first).unionByName(n))


def grammar_tables(spark, sf_dir):
    """Grammar features of two tables, joined by a clip's own id or that of the clip it was made from."""
    c = clips(spark, sf_dir).select("id", "token_nll_p95", F.when(F.col("id") % 2 == 0, "old").otherwise("new").alias("split"))
    one = c.filter("id % 3 = 0").select(F.col("id").cast("string").alias("id"), "split", "token_nll_p95")
    two = c.filter("id % 6 = 0 or id % 5 = 0").select(F.col("id").cast("string").alias("id"), "split", (F.col("token_nll_p95") + 10).alias("token_nll_p95"))
    features = readers.grammar_features([one, two]).drop("split")
    rows = c.select("id", F.floor(F.col("id") / 2).cast("long").alias("source_id"))
    return rounded(readers.join_by_keys(rows, ["id", "source_id"], features))


def quality_metadata(spark, sf_dir):
    """Quality columns from CSV and from JSON lines, joined to the clips under a prefix."""
    c, path = clips(spark, sf_dir), workspace(spark, "quality")
    c.filter("id % 2 = 0").select(F.when(F.col("id") % 10 > 0, F.concat(F.lit(" "), "id")).alias("sample_id"), F.when(F.col("id") % 4 == 0, "bad").otherwise(F.col("quality").cast("string")).alias("quality"), "stationary").write.csv(f"{path}/csv", header=True)
    c.filter("id % 2 = 1").select(F.col("id").alias("sample_id"), "quality", "stationary").write.json(f"{path}/jsonl")
    both = readers.read_quality(spark, csv=f"{path}/csv").unionByName(readers.read_quality(spark, jsonl=f"{path}/jsonl"))
    return rounded(labels.with_metadata(c.select(F.col("id").cast("string").alias("id")), both, "quality"))


def token_files(spark, sf_dir):
    path = workspace(spark, "tokens")
    readers.write_tokens(tokens(spark, sf_dir).withColumn("seq", F.col("seq").cast("string")), path)
    return readers.read_tokens(spark, path)


def _selection(spark, sf_dir):
    order = ranking.gated_order(scores.scored(candidates(spark, sf_dir)), _gate())
    out = ranking.capped_order(order, "group_id", 2, F.col("passed")).withColumn("reason_code", scores.reason_code())
    sizes = out.groupBy("group_id").agg(F.count("*").alias("cluster_size"))
    return out.join(sizes, "group_id").withColumn("cluster", F.col("group_id")).withColumn("score", F.col("novelty")).withColumn("raw_path", F.concat(F.lit("clips/"), "id", F.lit(".jsonl")))


def ranked_file(spark, sf_dir):
    """The fifteen columns of a ranking, written as CSV and read again."""
    path = workspace(spark, "ranked")
    readers.write_ranked(readers.ranked_rows(_selection(spark, sf_dir), "source_cap", 0.3, 0.9, 60.0), path)
    got = spark.read.csv(path, header=True)
    kinds = {"rank": "int", "score": "double", "quality_score": "double", "old_novelty_score": "double", "stationary_fraction": "double", "max_abs_value": "double", "new_cluster_id": "int", "new_cluster_size": "long"}
    kinds |= {c: "boolean" for c in ("quality_gate_pass", "physical_validity_pass", "was_selected_by_source_cap_fallback")}
    return rounded(got.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in readers.RANKED_COLUMNS]), 5)


def selection_trace(spark, sf_dir):
    rows = _selection(spark, sf_dir).select(
        "rank", F.col("id").cast("string").alias("sample_id"), F.col("id").cast("string").alias("worker_id"), F.col("final_score").alias("base_score"), "final_score", F.col("score").alias("rerank_score"), F.col("cluster").alias("cluster_id"),
        F.col("cluster_size").alias("new_cluster_size"), F.col("passed").alias("quality_gate_pass"), (F.col("passed") & ~F.col("within_cap")).alias("was_selected_by_source_cap_fallback"), F.col("quality").alias("quality_score"), "reason_code",
    )
    return rounded(readers.trace_rows(rows))


def final_ids(spark, sf_dir):
    """Submission rows whose hashed ids become the stems of a manifest's URLs."""
    path = workspace(spark, "urls")
    url = F.concat(F.lit("https://host.example/w/clip_"), "id", F.lit(".jsonl"))
    c = clips(spark, sf_dir).withColumn("url", url)
    c.select("url").write.text(path)
    rows = ranking.score_order(scores.scored(candidates(spark, sf_dir)).withColumn("score", F.col("novelty"))).withColumn("reason_code", scores.reason_code())
    sent = readers.submission(rows.withColumn("id", F.sha2(url, 256)))
    return rounded(readers.with_final_ids(sent, readers.line_manifest(spark, path)))


def balanced_urls(spark, sf_dir):
    return ranking.balanced_urls(clips(spark, sf_dir).select("id", "group_id"), "group_id", 7, 40, "urls").select("id", "group_id", "rank")


def report_files(spark, sf_dir):
    """A report's JSON and Markdown, read again line by line."""
    path = workspace(spark, "report")
    n = clips(spark, sf_dir).groupBy("role").count().collect()
    readers.write_report({r["role"]: r["count"] for r in n}, path, "roles", spark)
    got = json.loads(spark.read.text(f"{path}/roles.json", wholetext=True).first()[0])
    lines = spark.read.text(f"{path}/roles.md").filter(F.col("value").startswith("- "))
    return lines.select(F.regexp_extract("value", "- (.*):", 1).alias("role"), F.regexp_extract("value", ": (.*)", 1).cast("long").alias("n"), F.lit(sum(got.values())).cast("long").alias("total"))


_ALL = (jsonl_series, csv_series, csv_manifest, line_manifest, shard_reading, grammar_tables, quality_metadata, token_files, ranked_file, selection_trace, final_ids, balanced_urls, report_files)
QUERIES = {f.__name__: f for f in _ALL}

_CHANNELS = ", ".join(f"round({c}, {{0}}) AS {c}" for c in CHANNELS)
_SELECTED = f"""{SCORED}, gated AS (SELECT *, {GATE} AS passed FROM scored), ordered AS (SELECT *, row_number() OVER (ORDER BY passed DESC, novelty DESC, quality DESC, id) AS base_rank FROM gated),
capped AS (SELECT *, passed AND row_number() OVER (PARTITION BY group_id, passed ORDER BY base_rank) <= 2 AS within_cap FROM ordered),
sel AS (SELECT *, row_number() OVER (ORDER BY within_cap DESC, base_rank) AS rank, count(*) OVER (PARTITION BY group_id) AS cluster_size FROM capped)"""
_REASONS = "concat_ws(',', CASE WHEN NOT quality >= 0.3 THEN 'quality' END, CASE WHEN NOT stationary <= 0.9 THEN 'stationary_fraction' END, CASE WHEN NOT max_abs <= 60 THEN 'max_abs_value' END)"

ORACLES = {
    "jsonl_series": f"WITH {SERIES} SELECT clip, idx, round(ts, 3) AS ts, {_CHANNELS.format(6)} FROM series WHERE clip <= 20 AND idx < 200",
    "csv_series": f"WITH {SERIES} SELECT clip, idx, CASE WHEN clip % 3 < 2 THEN round(ts, 3) END AS ts, {_CHANNELS.format(6)} FROM series WHERE clip <= 12",
    "csv_manifest": """SELECT CASE c_custkey % 3 WHEN 0 THEN 's' || c_custkey WHEN 1 THEN 'w' || c_custkey ELSE 'clip_' || c_custkey END AS id, 'data/dir/clip_' || c_custkey || '.jsonl' AS raw_path, CASE WHEN c_custkey % 3 = 1 THEN 'w' || c_custkey END AS "group" FROM customer""",
    "line_manifest": """WITH u AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'https://host.example/a/worker_' || c_custkey % 7 || '/clip_' || c_custkey || '.jsonl?x=1' ELSE '/plain/dir/file' || c_custkey || '.csv' END AS url FROM customer)
SELECT row_number() OVER (ORDER BY k) - 1 AS pos, url, sha256(url) AS id, CASE WHEN k % 2 = 0 THEN 'worker_' || k % 7 ELSE ':file' || k END AS worker FROM u""",
    "shard_reading": f"""WITH {CLIPS} SELECT 'ordered' AS kind, -id AS pos, id, round(v[1], 6) AS x FROM clips WHERE id % 30 = 0 UNION ALL SELECT 'shard', 0, id, round(v[1] + CASE WHEN id % 3 > 0 THEN 1 ELSE 0 END, 6) FROM clips WHERE id % 3 = 0 OR id % 10 = 0
UNION ALL SELECT view, count(*), sum(id)::BIGINT, NULL FROM clips, (VALUES ('whole'), ('head')) t(view) GROUP BY view""",
    "grammar_tables": f"""WITH {CLIPS}, f AS (SELECT id, CASE WHEN id % 3 = 0 THEN token_nll_p95 ELSE token_nll_p95 + 10 END AS x FROM clips WHERE id % 3 = 0 OR id % 5 = 0)
SELECT c.id, c.id // 2 AS source_id, a.x IS NOT NULL OR b.x IS NOT NULL AS has_grammar, round(coalesce(a.x, b.x), 6) AS token_nll_p95 FROM clips c LEFT JOIN f a ON a.id = c.id LEFT JOIN f b ON b.id = c.id // 2""",
    "quality_metadata": f"""WITH {CLIPS} SELECT id::VARCHAR AS id, id % 10 > 0 AS has_quality, CASE WHEN id % 10 > 0 AND id % 4 > 0 THEN round(quality, 6) END AS quality_quality, CASE WHEN id % 10 > 0 THEN round(stationary, 6) END AS quality_stationary FROM clips""",
    "token_files": f"WITH {TOKENS} SELECT seq::VARCHAR AS seq, pos, token FROM tokens",
    "ranked_file": f"""WITH {_SELECTED} SELECT id::VARCHAR AS sample_id, rank, round(novelty, 5) AS score, round(quality, 5) AS quality_score, round(novelty, 5) AS old_novelty_score, quality >= 0.3 AS quality_gate_pass, {_REASONS} = '' AS physical_validity_pass, nullif({_REASONS}, '') AS physical_validity_failure_reasons,
round(stationary, 5) AS stationary_fraction, round(max_abs, 5) AS max_abs_value, group_id AS new_cluster_id, cluster_size AS new_cluster_size, passed AND NOT within_cap AS was_selected_by_source_cap_fallback, 'source_cap' AS reranker, 'clips/' || id || '.jsonl' AS raw_path FROM sel""",
    "selection_trace": f"""WITH {_SELECTED} SELECT rank, id::VARCHAR AS worker_id, id::VARCHAR AS sample_id, round(final_score, 6) AS base_score, round(final_score, 6) AS final_score, round(novelty, 6) AS rerank_score, group_id AS cluster_id, NULL::VARCHAR AS new_cluster_parent_id, cluster_size AS new_cluster_size,
FALSE AS was_selected_by_fallback, passed AS quality_gate_pass, passed AND NOT within_cap AS was_selected_by_source_cap_fallback, round(quality, 6) AS quality_score, {PLAIN_REASON} AS reason_code FROM sel""",
    "final_ids": f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY novelty DESC, quality DESC, id) AS before FROM scored)
SELECT 'clip_' || id AS worker_id, row_number() OVER (ORDER BY final_score DESC, before) AS rank, round(final_score, 6) AS score, round(quality, 6) AS quality_score, {PLAIN_REASON} AS reason_code FROM r""",
    "balanced_urls": f"""WITH {CLIPS}, o AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY ('0x' || substr(sha256('urls:' || id), 1, 12))::BIGINT, id) AS nth FROM clips QUALIFY nth <= 7) SELECT id, group_id, row_number() OVER (ORDER BY nth, group_id) AS rank FROM o QUALIFY rank <= 40""",
    "report_files": f"WITH {CLIPS} SELECT role, count(*) AS n, (SELECT count(*) FROM clips) AS total FROM clips GROUP BY role",
}
