"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone.

A rolling hash over the last two lines' hashes decides after which lines a chunk
ends, so that inserted lines shift no later boundary. Of every chunk of several
lines that occurs again anywhere, the first occurrence (smallest doc_id, then
text, then place) stays; the others go once their bytes equal the first's.

Such chunks part a repeated passage where they will, so that its ends, and any
chunk of one line, stay. With ``whole`` the units are each two neighbouring lines
instead, which overlap: every line of a repeat of two lines and more is in one
that repeats, wherever the repeat begins, and goes. What a line says stays in the
first of its places, as a unit's first occurrence comes before those it removes.

Defined results: a null text stays null and an empty one empty; chunks of a
single line always stay; rows that repeat both doc_id and text are treated
alike, so that what one keeps the other keeps; null ids come after all others; very
long texts are cut like any others; further columns pass through, whatever their
names, but for columns named as the two counts, which give way; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines are parted by this character alone.
LINE = "\n"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_bounds(lines: Column, every: int) -> Column:
    """Arrays of struct(first, last), line numbers from 0, of the chunks of an array of lines."""
    hashes = F.transform(lines, line_hash)
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)

    def ends(h: Column) -> Column:
        return F.filter(numbers, lambda i: (i == F.size(lines) - 1) | (F.pmod(h[i] + 31 * F.when(i > 0, h[i - 1]).otherwise(0), F.lit(every)) == 0))

    # an array of one array lets the lambda name the hashes, so that they are computed once
    last = F.transform(F.array(hashes), ends)[0]
    return F.transform(F.array(last), lambda e: F.transform(e, lambda c, k: F.struct(F.when(k > 0, e[k - 1] + 1).otherwise(0).alias("first"), c.alias("last"))))[0]


def line_pairs(lines: Column) -> Column:
    """Arrays of struct(first, last) of each two neighbouring lines of an array of several."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0))), lambda i: F.struct(i.alias("first"), (i + 1).alias("last")))


def _chunk_text(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["first"] + 1, c["last"] - c["first"] + 1), LINE)


def removals(docs: DataFrame, every: int, whole: bool = False) -> DataFrame:
    """__id, __hash and the numbers of the chunks (or pairs of lines) to remove, for the documents that lose any.

    Digests of chunks alone go through the aggregation that finds repeats, with
    partial sums first. A document then moves once, to its repeated chunks'
    numbers, and only those chunks' texts go on to be compared, by a join that
    Spark splits where one chunk is very common.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__hash"), "text")

    def chunks(rows: DataFrame) -> DataFrame:
        return rows.withColumn("lines", F.split("text", LINE, -1)).withColumn("bounds", line_pairs(F.col("lines")) if whole else chunk_bounds(F.col("lines"), every))

    several = F.filter(
        F.transform("bounds", lambda c, k: F.struct(k.alias("no"), F.unhex(F.md5(_chunk_text(F.col("lines"), c))).alias("digest"), (c["last"] > c["first"]).alias("several"))), lambda c: c["several"]
    )
    places = chunks(keyed.filter(F.col("text").contains(LINE))).select("doc_id", "__hash", F.explode(several).alias("c")).select("doc_id", "__hash", "c.no", "c.digest")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "no")
    repeated = places.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    found = places.join(repeated, "digest").select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), F.struct("no", "digest", (place == F.col("first")).alias("first")).alias("c"))
    by_doc = found.groupBy("__id", "__h").agg(F.collect_set("c").alias("found"))
    texts = chunks(keyed.join(by_doc, keyed["doc_id"].eqNullSafe(by_doc["__id"]) & (keyed["__hash"] == by_doc["__h"])).drop("doc_id", "__hash"))
    texts = texts.select("__id", F.col("__h").alias("__hash"), "lines", "bounds", F.explode("found").alias("c")).select("__id", "__hash", "c.*", _chunk_text(F.col("lines"), F.col("bounds")[F.col("c.no")]).alias("chunk"))
    firsts = texts.filter("first").groupBy("digest").agg(F.min("chunk").alias("first_chunk"))
    same = texts.filter("not first").join(firsts, "digest").filter(F.col("chunk") == F.col("first_chunk"))
    return same.groupBy("__id", "__hash").agg(F.collect_set("no").alias("__gone"))


def dedup_lines(docs: DataFrame, every: int = 3, whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and __n_lines and __n_removed, the lines before and those cut.

    ``every`` is the mean length of a chunk in lines; with ``whole`` all lines of each repeat of several lines are cut.
    """
    gone = removals(docs.select("doc_id", "text"), every, whole)
    text, ours = F.col("row")["text"], ("__n_lines", "__n_removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ours]).alias("row"), "doc_id", F.xxhash64("text").alias("k_hash"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["k_hash"] == gone["__hash"]), "left").select("row", "__gone")
    lines, none = F.split(text, LINE, -1), F.col("__gone").isNull()
    if whole:
        chunks = F.transform(F.col("__lines"), lambda _, i: F.struct(i.alias("first"), i.alias("last")))
        kept = F.filter(F.col("__chunks"), lambda c, i: ~F.array_contains("__gone", i) & ~F.array_contains("__gone", i - 1))
    else:
        chunks = chunk_bounds(F.col("__lines"), every)
        kept = F.filter(F.col("__chunks"), lambda c, k: ~F.array_contains("__gone", k))
    n_kept = F.aggregate("__kept", F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1)
    left = F.when(none, text).otherwise(F.array_join(F.transform("__kept", lambda c: _chunk_text(F.col("__lines"), c)), LINE))
    out = joined.withColumn("__n_lines", F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(LINE))) + 1))
    out = out.withColumn("__lines", F.when(~none, lines)).withColumn("__chunks", F.when(~none, chunks)).withColumn("__kept", F.when(~none, kept))
    out = out.withColumn("__n_removed", F.when(none, 0).otherwise(F.size("__lines") - n_kept)).withColumn("__left", left)
    columns = [F.col("__left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ours]
    return out.select(*columns, *ours)
