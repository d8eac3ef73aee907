"""Manifests, sensor files and their sinks.

Paths may be of any store that Spark reads; files are read by Spark's own
readers, so that splits, retries and pruning are Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import failing, numbered
from ..operators.timeseries import CHANNELS

#: Names under which a time column may come.
TIME_NAMES = ["timestamp", "time", "t", "ts"]


#: Where a row stands among the rows of its file: the split it was read in, and its place there.
_PLACE = ["__split", "__row"]


def _lines(spark: SparkSession, paths) -> DataFrame:
    """file, value and the place of each line; a file of any size is read in splits."""
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"))
    return rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", r"\r$", ""))


def _blank_as_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def line_manifest(spark: SparkSession, path: str) -> DataFrame:
    """pos, url, id, worker: a path or URL a line; blank lines and those that begin with # don't count.

    The id is the SHA-256 of the trimmed line; the worker the first part of the
    path that begins with "worker", else the host and file name.
    """
    kept = _lines(spark, path).withColumn("url", F.trim("value")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    placed = kept.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy(*_PLACE)) - 1)
    return placed.select("pos", "url", F.sha2("url", 256).alias("id"), worker_of(F.col("url")).alias("worker"))


def worker_of(url: Column) -> Column:
    part = F.regexp_extract(url, r"(?:^|/)(worker[^/?#]*)", 1)
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.when(part != "", part).otherwise(F.concat_ws(":", host, url_stem(url)))


def url_stem(url: Column) -> Column:
    """The file name without its last ending."""
    return F.regexp_extract(url, r"([^/?#]+?)(?:\.[^./?#]*)?(?:[?#].*)?$", 1)


def csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, raw_path, group: the path from raw_path, path or file_path; the id from sample_id, worker_id or the path's stem; an error if there is no path column."""
    rows = spark.read.csv(path, header=True)
    of = lambda names: F.coalesce(*[_blank_as_null(F.col(n)) for n in names if n in rows.columns], F.lit(None).cast("string"))
    paths = ["raw_path", "path", "file_path"]
    if not set(paths) & set(rows.columns):
        raise ValueError(f"a manifest needs one of {paths}")
    raw = of(paths)
    return rows.select(F.coalesce(of(["sample_id", "worker_id"]), url_stem(raw)).alias("id"), raw.alias("raw_path"), of(["source_group_id", "worker_id"]).alias("group"))


def read_jsonl(spark: SparkSession, paths, max_samples: int | None = None, recover: bool = True) -> DataFrame:
    """A series table of JSON-lines files, one clip each: clip (the file), idx, ts and channels.

    A record's channels come from arrays acc and gyro; where the acc key is
    mangled and ``recover`` is set, from the one other array of three numbers;
    else from the six named keys; else from its first six numbers. t_us is in
    microseconds. Lines that are blank or no JSON object don't count; no usable line at all is an error.
    """
    rows = _lines(spark, paths).filter(F.trim("value") != "").withColumnRenamed("file", "clip")
    fields = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    rows = rows.withColumn("m", fields).filter(F.col("m").isNotNull())

    def triple(c: Column) -> Column:
        a = F.from_json(c, "array<double>")
        return F.when(F.size(a) == 3, a)

    get = lambda k: F.try_element_at("m", F.lit(k))
    others = F.filter(F.map_entries("m"), lambda e: ~e["key"].isin("gyro", "acc", "timestamp", "t_us") & triple(e["value"]).isNotNull())
    mangled = F.when((F.size(others) == 1) & get("gyro").isNotNull(), triple(others[0]["value"])) if recover else F.lit(None).cast("array<double>")
    both = F.concat(F.coalesce(triple(get("acc")), mangled), triple(get("gyro")))
    named = F.array(*[get(k).try_cast("double") for k in CHANNELS])
    named = F.when(~F.exists(named, lambda x: x.isNull()), named)
    numbers = F.slice(F.filter(F.transform(F.filter(F.map_entries("m"), lambda e: ~e["key"].isin("timestamp", "t_us", *TIME_NAMES)), lambda e: e["value"].try_cast("double")), lambda x: x.isNotNull()), 1, 6)
    six = F.coalesce(both, named, F.when(F.size(numbers) == 6, numbers))
    ts = F.coalesce(get("timestamp").try_cast("double"), get("t_us").try_cast("double") / 1e6)
    good = rows.withColumn("six", six).withColumn("ts", ts).filter(F.col("six").isNotNull())
    if good.isEmpty():
        raise ValueError("no samples in the files")
    out = good.withColumn("idx", F.row_number().over(Window.partitionBy("clip").orderBy(*_PLACE)) - 1)
    if max_samples is not None:
        out = out.filter(F.col("idx") < max_samples)
    return out.select("clip", "idx", "ts", *[F.col("six")[i].alias(c) for i, c in enumerate(CHANNELS)])


def read_worker_csv(spark: SparkSession, path: str) -> DataFrame:
    """A series table of CSV files, each with its own header: channel names in any case, else the first six numeric columns that aren't times.

    Files are grouped by their first line; the driver holds the list of files, as Spark does to read them.
    """
    place = Window.partitionBy("file").orderBy(*_PLACE)
    heads = _lines(spark, path).withColumn("__n", F.row_number().over(place)).filter("__n = 1").groupBy("value").agg(F.collect_list("file").alias("files")).orderBy("value").collect()
    out = None
    for head in heads:
        one = _csv_of_one_header(spark, head["files"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no files with a header")
    return out


def _csv_of_one_header(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = spark.read.csv(files, header=True, inferSchema=True)
    lower = {c.lower(): c for c in rows.columns}
    time = next((lower[t] for t in TIME_NAMES if t in lower), None)
    if all(c in lower for c in CHANNELS):
        picked = [lower[c] for c in CHANNELS]
    else:
        numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != time]
        if len(numeric) < 6:
            raise ValueError(f"fewer than six numeric columns: {rows.columns}")
        picked = numeric[:6]
    numbered = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split")).withColumn("__row", F.monotonically_increasing_id())
    idx = F.row_number().over(Window.partitionBy("__file").orderBy(*_PLACE)) - 1
    return numbered.select(F.col("__file").alias("clip"), idx.alias("idx"), (F.col(time).cast("double") if time else F.lit(None).cast("double")).alias("ts"), *[F.col(p).cast("double").alias(c) for p, c in zip(picked, CHANNELS)])


def grammar_features(tables: list[DataFrame], key: str = "id", split: str = "split") -> DataFrame:
    """Several feature tables as one: the first row of an id within a split counts, by table and then by the table's rows; an id in two splits is an error."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("__order", F.lit(i)).withColumn("__row", F.monotonically_increasing_id())
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    twice = out.groupBy(key).agg(F.countDistinct(split).alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"{twice} ids are in several splits")
    first = F.row_number().over(Window.partitionBy(key, split).orderBy("__order", "__row"))
    return out.withColumn("__n", first).filter("__n = 1").drop("__n", "__order", "__row")


def join_by_keys(rows: DataFrame, keys: list[str], features: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the features of the first of several keys that has any; has_grammar says whether one did. Rows are told apart by ``id``."""
    each = rows.select(F.col("id").alias("__id"), F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("__at", "__key"))
    values = [c for c in features.columns if c != key]
    found = each.join(features.withColumn("__key", F.col(key).cast("string")).drop(key), "__key")
    best = found.groupBy("__id").agg(F.min_by(F.struct(*values), "__at").alias("__f"))
    return rows.join(best, F.col("id") == F.col("__id"), "left").withColumn("has_grammar", F.col("__f").isNotNull()).select(*rows.columns, "has_grammar", *[F.col(f"__f.{v}").alias(v) for v in values])


def read_embeddings(spark: SparkSession, path: str, view: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """id, view, v of a table partitioned by view; only the partition and ids asked for are read, and the first row of an id counts, by shard name and place in the shard."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    if view is not None:
        rows = rows.filter(F.col("view") == view)
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "view").orderBy("__file", "__row"))
    return rows.withColumn("__n", nth).filter("__n = 1").drop("__n", "__file", "__row")


def read_shards(spark: SparkSession, path: str, view: str, shards: int, ids: DataFrame | None = None) -> DataFrame:
    """id, v of a view from its first ``shards`` files in name order, of the ids asked for; the first row of an id counts."""
    rows = spark.read.parquet(path).filter(F.col("view") == view).select("id", "v", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # file names are few: one for each shard
    first = rows.select("__file").distinct().orderBy("__file").limit(shards)
    rows = rows.join(F.broadcast(first), "__file", "left_semi")
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("__file", "__row"))
    return rows.withColumn("__n", nth).filter("__n = 1").select("id", "v")


def in_order(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """pos, id, v: the manifest's rows in its order with their vectors; an error if one has none."""
    missing = manifest.join(rows, "id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids of the manifest have no vector")
    return manifest.select("pos", "id").join(rows.select("id", "v"), "id").select("pos", "id", "v")


def read_quality(spark: SparkSession, csv: str | None = None, jsonl: str | None = None, key: str = "sample_id") -> DataFrame:
    """id and numeric quality columns of a CSV file with a header or of JSON lines; rows with a blank id don't count, and what is no number is null."""
    if (csv is None) == (jsonl is None):
        raise ValueError("give either csv or jsonl")
    rows = spark.read.csv(csv, header=True) if csv is not None else spark.read.json(jsonl)
    values = [c for c in rows.columns if c != key]
    return rows.filter(_blank_as_null(F.col(key).cast("string")).isNotNull()).select(F.trim(F.col(key).cast("string")).alias("id"), *[F.col(c).cast("string").try_cast("double").alias(c) for c in values])


def write_embeddings(rows: DataFrame, path: str) -> None:
    """id, view, v as Parquet, a directory for each view; views that are written again replace theirs alone."""
    rows.select("id", "v", "view").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("view").parquet(path)


#: The columns of a ranked file, of a selection trace and of a submission.
RANKED_COLUMNS = [
    "sample_id", "rank", "score", "quality_score", "old_novelty_score", "quality_gate_pass", "physical_validity_pass", "physical_validity_failure_reasons",
    "stationary_fraction", "max_abs_value", "new_cluster_id", "new_cluster_size", "was_selected_by_source_cap_fallback", "reranker", "raw_path",
]
TRACE_COLUMNS = [
    "rank", "worker_id", "sample_id", "base_score", "final_score", "rerank_score", "cluster_id", "new_cluster_parent_id", "new_cluster_size",
    "was_selected_by_fallback", "quality_gate_pass", "was_selected_by_source_cap_fallback", "quality_score", "reason_code",
]
SUBMISSION_COLUMNS = ["worker_id", "rank", "score", "quality_score", "reason_code"]


def ranked_rows(rows: DataFrame, reranker: str, min_quality: float, max_stationary: float, max_abs: float) -> DataFrame:
    """Ranked clips under the fixed columns of a ranked file.

    ``rows`` has id, rank, score, quality, novelty, stationary, max_abs, cluster, cluster_size, passed, within_cap and
    raw_path. Failing physical checks are listed by name; a row that passed but fell behind its source's cap is a fallback.
    """
    checks = {"quality": F.col("quality") >= min_quality, "stationary_fraction": F.col("stationary") <= max_stationary, "max_abs_value": F.col("max_abs") <= max_abs}
    reasons = failing(checks)
    named = {
        "sample_id": F.col("id").cast("string"), "rank": F.col("rank").cast("int"), "score": F.col("score"), "quality_score": F.col("quality"), "old_novelty_score": F.col("novelty"), "quality_gate_pass": F.col("quality") >= min_quality,
        "physical_validity_pass": reasons == "", "physical_validity_failure_reasons": reasons, "stationary_fraction": F.col("stationary"), "max_abs_value": F.col("max_abs"), "new_cluster_id": F.col("cluster"),
        "new_cluster_size": F.col("cluster_size"), "was_selected_by_source_cap_fallback": F.col("passed") & ~F.col("within_cap"), "reranker": F.lit(reranker), "raw_path": F.col("raw_path"),
    }
    return rows.select(*[named[c].alias(c) for c in RANKED_COLUMNS])


def write_ranked(rows: DataFrame, path: str) -> None:
    """The fixed columns as CSV with a header, files in rank order."""
    rows.select(*RANKED_COLUMNS).orderBy("rank").write.mode("overwrite").csv(path, header=True)


def trace_rows(rows: DataFrame) -> DataFrame:
    """The columns of a selection trace; those that a selection doesn't have are null, flags false."""
    flags = {"was_selected_by_fallback", "quality_gate_pass", "was_selected_by_source_cap_fallback"}
    default = lambda c: F.lit(False) if c in flags else F.lit(None)
    return rows.select(*[(F.coalesce(F.col(c), default(c)) if c in rows.columns else default(c).cast("boolean" if c in flags else "string")).alias(c) for c in TRACE_COLUMNS])


def write_report(report: dict, folder: str, name: str, spark: SparkSession) -> None:
    """A report of small values as one JSON file and one Markdown file with a line for each, by Spark's text writer."""
    import json

    lines = [f"# {name}", "", *[f"- {k}: {v}" for k, v in sorted(report.items())]]
    for kind, text in (("json", json.dumps(report, indent=2, sort_keys=True)), ("md", "\n".join(lines))):
        spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.{kind}")


def submission(rows: DataFrame) -> DataFrame:
    """Rows in order of final_score (former rank among equals), numbered anew, with the fixed columns."""
    placed = numbered(rows.withColumnRenamed("rank", "__former"), F.desc("final_score"), F.asc("__former"))
    return placed.select(F.col("id").cast("string").alias("worker_id"), "rank", F.col("final_score").alias("score"), F.col("quality").alias("quality_score"), "reason_code")


def with_final_ids(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Submission rows whose hashed ids become the URL stems of a manifest; an error if any is missing."""
    stems = manifest.select(F.col("id").alias("worker_id"), url_stem(F.col("url")).alias("__stem"))
    missing = rows.join(stems, "worker_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids are not in the manifest")
    return rows.join(stems, "worker_id").withColumn("worker_id", F.col("__stem")).select(*SUBMISSION_COLUMNS)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """A JSON line for each sequence with its tokens in order."""
    rows = tokens.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))
    rows.write.mode("overwrite").json(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    rows = spark.read.schema(f"seq string, tokens array<{kind}>").json(path)
    return rows.select("seq", F.posexplode("tokens").alias("pos", "token"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of the files in tar archives; an archive is read by one task, member by member."""
    import io
    import tarfile

    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                with tarfile.open(fileobj=io.BytesIO(raw.as_py()), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.name]), pa.array([tar.extractfile(m).read()], pa.binary())], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")
