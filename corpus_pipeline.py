"""A training corpus from raw documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.catalog import table, tokenizer_path
from siftwell.llm.common import materialise
from siftwell.llm.jaccard import jaccard_components, one_of_each
from siftwell.llm.langid import identify, learn_dictionaries
from siftwell.llm.linededup import dedup_lines
from siftwell.llm.packing import pack
from siftwell.llm.positional import contamination, without_contaminated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't clear; fills in a null ``lang``.

    Null texts and texts without a letter go; rows are judged one by one, repeated
    ones alike; ties of languages have no margin and go; very long texts are judged
    whole; all columns stay, whatever their names; an empty table stays empty.
    """
    row = F.col("row")
    found = identify(docs, learn_dictionaries(docs), None).filter("not rejected")
    return found.select(*[(F.coalesce(row["lang"], "lang_pred") if c == "lang" else row.getField(c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all lines of repeats of several lines; a document of which nothing is left goes.

    The first place of a repeat stays, by doc_id (nulls last), text and line; rows that
    repeat id and text lose the same lines; null texts and texts of one line stay as they
    are; very long texts are cut like any others; n_chars follows the text; all
    columns stay, whatever their names but the operator's two counts; an empty table stays empty.
    """
    found = dedup_lines(docs, whole=True).filter("__n_removed = 0 or text <> ''")
    n_chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id (nulls last), then text hash.

    Of rows that repeat id and text one stays; null, empty and wordless texts are like nothing and stay; very
    long texts are compared whole; all columns stay, whatever their names; an empty table stays empty.
    """
    return one_of_each(docs, jaccard_components(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark text: any window of 10 words of an item, or a shorter item whole.

    Null and wordless texts stay; repeated rows go or stay alike; very long texts are searched whole; all
    columns stay, whatever their names; an empty table, of documents or items, takes nothing.
    """
    return without_contaminated(docs, contamination(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 1024: a row per piece.

    Null texts count as empty and give their end token; repeated rows and null ids are packed like
    any others; other columns are left out, whatever their names; an empty table gives no pieces.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: The compression classifier has no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
