"""One query per operator over its whole table, with production parameters, and SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers' package has a file, on the driver and every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_gear_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages; a document that shares none has no row. Those with n_repeated > 0 are the spans to cut."""
    from .substrings import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_chunks", "keeper", "n_repeated")


def op3_pigeonhole_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_links is the exact number of other sets that a row's set is linked with; copies are one set."""
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), every_link=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, scan

    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"), "n_random")


def op5_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_near, the words in proximity matches: spans of at most 14 words that hold all words of a window."""
    from .positional import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "item_ids")


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose fold is not 2."""
    from .langid import fold
    from .quality import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = learn(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs.select("doc_id", held_out, "text"), ranking, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose fold is not 1."""
    from .langid import fold, identify, learn_dictionaries

    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.filter(fold(F.col("doc_id"), 3) != 1))
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), dictionaries, ["doc_id", "held_out"])


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), "text")


def op9_whole_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_line_chunks, but every line of a repeat of several lines goes."""
    from .linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return found.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), "text")


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_gear_substrings": op2_gear_substrings,
    "op3_pigeonhole_jaccard": op3_pigeonhole_jaccard,
    "op4_randomness_secrets": op4_randomness_secrets,
    "op5_dictionary_warc": op5_dictionary_warc,
    "op6_positional_decontamination": op6_positional_decontamination,
    "op7_quality_ranking": op7_quality_ranking,
    "op8_compression_langid": op8_compression_langid,
    "op9_line_chunks": op9_line_chunks,
    "op10_mtree_topk": op10_mtree_topk,
    # what a query above leaves out because its SQL states its columns and rule
    "op9_whole_repeats": op9_whole_repeats,
}

ORACLES: dict[str, str] = {
    "op3_pigeonhole_jaccard": sql.OP3,
    "op5_dictionary_warc": sql.OP5,
    "op6_positional_decontamination": sql.OP6,
    "op9_line_chunks": sql.OP9,
    "op10_mtree_topk": sql.OP10,
}
