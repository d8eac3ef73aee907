"""Tables in the shape that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import stable_random


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a clip: id, group_id, v, role and reproducible quality measures."""
    e = table(spark, sf_dir, "embeddings")
    draw = lambda name: stable_random(F.lit(name), F.col("vec_id"))
    role = F.when(F.pmod("vec_id", F.lit(5)) < 3, "support").when(F.pmod("vec_id", F.lit(5)) == 3, "candidate").otherwise("target")
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").alias("group_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), role.alias("role"), draw("quality").alias("quality"),
        draw("stationary").alias("stationary"), (draw("max_abs") * 80).alias("max_abs"), (draw("artifact") * 0.1).alias("artifact"), (draw("nll") * 5).alias("token_nll_p95"),
        (draw("transition") * 5).alias("transition_nll_p95"), (draw("rare") * 0.5).alias("rare_phrase"), F.floor(draw("unseen") * 6).cast("double").alias("longest_unseen"), (draw("has") < 0.8).alias("has_grammar"),
    )


def _draw(name: str, key: str = "vec_id") -> str:
    return f"(('0x' || substr(sha256('{name}:' || {key}), 1, 12))::BIGINT / 281474976710655.0)"


CLIPS = f"""clips AS (
  SELECT vec_id AS id, label AS group_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    CASE WHEN vec_id % 5 < 3 THEN 'support' WHEN vec_id % 5 = 3 THEN 'candidate' ELSE 'target' END AS role,
    {_draw('quality')} AS quality, {_draw('stationary')} AS stationary, {_draw('max_abs')} * 80 AS max_abs, {_draw('artifact')} * 0.1 AS artifact,
    {_draw('nll')} * 5 AS token_nll_p95, {_draw('transition')} * 5 AS transition_nll_p95, {_draw('rare')} * 0.5 AS rare_phrase,
    floor({_draw('unseen')} * 6)::DOUBLE AS longest_unseen, {_draw('has')} < 0.8 AS has_grammar
  FROM embeddings)"""

#: Candidates with novelty (k = 5 over the support) and density (k = 10 over the batch).
SCORED = f"""{CLIPS}, near AS (
  SELECT a.id, 1 - list_cosine_similarity(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.id) AS r
  FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'support'),
nov AS (SELECT id, avg(d) AS novelty FROM near WHERE r <= 5 GROUP BY id),
peers AS (
  SELECT a.id, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.id) AS r
  FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'candidate' AND a.id <> b.id),
dens AS (SELECT id, avg(greatest(s, 0)) AS density FROM peers WHERE r <= 10 GROUP BY id),
base AS (SELECT c.*, novelty, coalesce(density, 0) AS density FROM clips c JOIN nov USING (id) LEFT JOIN dens USING (id)),
scaled AS (SELECT *, {{mm_novelty}} AS novelty_score, {{mm_density}} AS density_score FROM base),
scored AS (SELECT *, 0.75 * novelty_score + 0.25 * density_score AS ranker_score, quality * (0.75 * novelty_score + 0.25 * density_score) AS final_score FROM scaled)"""


def mm(x: str, over: str = "") -> str:
    """Min-max over all rows in SQL; equal values give 0."""
    low, high = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return f"CASE WHEN {high} - {low} <= 1e-12 THEN 0 ELSE ({x} - {low}) / ({high} - {low}) END"


SCORED = SCORED.format(mm_novelty=mm("novelty"), mm_density=mm("density"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates with novelty over the support and density in the batch."""
    from ..operators.neighbors import density, novelty

    c = clips(spark, sf_dir)
    own, support = c.filter("role = 'candidate'"), c.filter("role = 'support'")
    return own.join(novelty(own, support, 5), "id").join(density(own, 10), "id")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results can be compared by value."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's line items in time order as six channels."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(
        F.col("l_suppkey").alias("clip"), (F.row_number().over(order) - 1).alias("idx"), (F.unix_micros(F.to_timestamp("l_shipdate")) / 1e6).alias("ts"), F.col("l_quantity").cast("double").alias("acc_x"), (F.col("l_extendedprice") / 1000).alias("acc_y"),
        (F.col("l_discount") * 100).alias("acc_z"), (F.col("l_tax") * 100).alias("gyro_x"), F.col("l_linenumber").cast("double").alias("gyro_y"), F.dayofmonth("l_shipdate").cast("double").alias("gyro_z"),
    )


SERIES = """series AS (
  SELECT l_suppkey AS clip, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
    epoch_us(l_shipdate) / 1e6 AS ts, l_quantity::DOUBLE AS acc_x, l_extendedprice / 1000 AS acc_y, l_discount * 100 AS acc_z, l_tax * 100 AS gyro_x,
    l_linenumber::DOUBLE AS gyro_y, day(l_shipdate)::DOUBLE AS gyro_z FROM lineitem)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types in time order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("seq"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), F.col("event_type").alias("token"))


TOKENS = "tokens AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events)"
