"""Rerankers by name, and the engine's SQL surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import greedy, ranking

#: Builders by name: each takes (batch, id, v, score, quality, novelty, cluster, parent, support_distance, eligible) and gives batch, id, rank.
RERANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "score": lambda r: ranking.score_order(r, ["batch"]),
    "quality_only": lambda r: ranking.quality_novelty_order(r, ["batch"]),
    "quality_gated_old_novelty": lambda r: ranking.gated_order(r, F.col("eligible"), ["batch"]),
    "source_cap": lambda r: ranking.capped_order(ranking.gated_order(r, F.col("eligible"), ["batch"]), "cluster", 2, F.col("passed"), ["batch"]),
    "mmr": lambda r: greedy.mmr(r),
    "cluster_aware": lambda r: greedy.cluster_capped(r, []),
    "cluster_cap": lambda r: greedy.cluster_capped(r, [(10, 2)]),
    "tiered_cluster_cap": lambda r: greedy.cluster_capped(r, [(10, 2), (30, 5)]),
    "kcenter": lambda r: greedy.k_center(r),
}


def rerank(rows: DataFrame, names: list[str]) -> DataFrame:
    """reranker, batch, id, rank by each of the named rerankers; an unknown name is an error."""
    if unknown := sorted(set(names) - set(RERANKERS)):
        raise ValueError(f"no such rerankers: {unknown}; known: {sorted(RERANKERS)}")
    out = None
    for name in names:
        one = RERANKERS[name](rows).select(F.lit(name).alias("reranker"), "batch", "id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


#: SQL functions that the engine offers beside Spark's own: name, parameters, type and body.
FUNCTIONS = [
    ("stable_draw", "name STRING, id STRING", "DOUBLE", "CAST(conv(substring(sha2(concat(name, ':', id), 256), 1, 12), 16, 10) AS DOUBLE) / 281474976710655"),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / greatest(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 1e-12D)"),
]


def register(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """The tables of a folder as views, and the engine's functions, for ``spark.sql``."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
