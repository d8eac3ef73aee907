"""Token sequences: n-gram surprisal, phrase mining and vector quantisation.

A token table is long: seq, pos (0.. within the sequence) and token.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot

START, BEFORE, AFTER = "<s>", "<s>", "</s>"


def _order() -> Window:
    return Window.partitionBy("seq").orderBy("pos")


def with_context(tokens: DataFrame, order: int = 3) -> DataFrame:
    """Adds ``context``, the array of the order - 1 tokens before, filled with a start mark."""
    before = [F.coalesce(F.lag("token", k).over(_order()).cast("string"), F.lit(START)) for k in range(order - 1, 0, -1)]
    return tokens.withColumn("context", F.array(*before) if before else F.array().cast("array<string>")).withColumn("token", F.col("token").cast("string"))


def fit_grammar(tokens: DataFrame, order: int = 3) -> DataFrame:
    """context, token, n of the sequences learned from."""
    return with_context(tokens, order).groupBy("context", "token").agg(F.count("*").alias("n"))


def token_nll(tokens: DataFrame, grammar: DataFrame, order: int = 3, smoothing: float = 0.1) -> DataFrame:
    """Adds ``nll``, the negative log of a token's smoothed probability in its context, and ``seen``, its n-gram's count."""
    totals = grammar.groupBy("context").agg(F.sum("n").alias("total"))
    vocabulary = grammar.agg(F.greatest(F.countDistinct("token"), F.lit(1)).alias("kinds"))
    rows = with_context(tokens, order).join(grammar.withColumnRenamed("n", "seen"), ["context", "token"], "left").join(totals, "context", "left").join(F.broadcast(vocabulary))
    p = (F.coalesce("seen", F.lit(0)) + smoothing) / F.greatest(F.coalesce("total", F.lit(0)) + smoothing * F.col("kinds"), F.lit(1e-12))
    return rows.select("seq", "pos", "token", F.coalesce("seen", F.lit(0)).alias("seen"), (-F.log(p)).alias("nll"))


def sequence_features(tokens: DataFrame, grammar: DataFrame, order: int = 3, smoothing: float = 0.1, rare: int = 1) -> DataFrame:
    """Surprisal statistics of each sequence.

    Only n-grams of the full order are counted in a grammar, so shorter phrases
    always count as rare and unseen: rare_bigram is 1 for any sequence of two
    tokens where order is 3, as downstream thresholds expect.
    """
    nll = token_nll(tokens, grammar, order, smoothing)
    later = F.when(F.col("pos") > 0, F.col("nll"))
    base = nll.groupBy("seq").agg(
        F.count("*").alias("n_tokens"), F.avg("nll").alias("token_nll_mean"), F.percentile("nll", F.lit(0.9)).alias("token_nll_p90"), F.percentile("nll", F.lit(0.95)).alias("token_nll_p95"),
        F.coalesce(F.avg(later), F.lit(0.0)).alias("transition_nll_mean"), F.coalesce(F.percentile(later, F.lit(0.95)), F.lit(0.0)).alias("transition_nll_p95"),
        # an n-gram of the full order within the sequence has no start mark
        F.avg(F.when(F.col("pos") >= order - 1, (F.col("seen") <= rare).cast("double"))).alias("__full"),
        F.max(F.when((F.col("pos") >= order - 1) & (F.col("seen") == 0), 1).otherwise(0)).alias("__unseen"),
    )
    n = F.col("n_tokens")

    def rare_share(k: int) -> Column:
        return F.coalesce(F.col("__full"), F.lit(0.0)) if k == order else F.when(n >= k, 1.0).otherwise(0.0)

    # phrases other than of the full order are never counted, so the longest of them is unseen
    longest = F.least(n, F.lit(order + 2)).cast("double")
    longest = F.when(longest == order, F.when(F.col("__unseen") == 1, float(order)).otherwise(float(order - 1))).otherwise(longest)
    return base.withColumn("rare_bigram", rare_share(2)).withColumn("rare_trigram", rare_share(3)).withColumn("rare_phrase", rare_share(min(order, 3))).withColumn("longest_unseen", longest).drop("__full", "__unseen")


def ngrams(tokens: DataFrame, least: int, most: int) -> DataFrame:
    """A row per n-gram occurrence of ``least`` to ``most`` tokens: seq, pos, phrase, left and right neighbour. Rows grow with most - least, not with a sequence's length squared."""
    ahead = F.collect_list("token").over(_order().rowsBetween(0, most))
    rows = tokens.withColumn("__ahead", ahead).withColumn("left", F.coalesce(F.lag("token").over(_order()).cast("string"), F.lit(BEFORE)))
    sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n <= F.size("__ahead"))
    each = rows.select("seq", "pos", "left", "__ahead", F.explode(sizes).alias("n"))
    return each.select("seq", "pos", "n", F.slice("__ahead", 1, F.col("n")).alias("phrase"), "left", F.coalesce(F.get("__ahead", F.col("n")).cast("string"), F.lit(AFTER)).alias("right"))


def _entropy(pairs: DataFrame, key: str) -> DataFrame:
    counts = pairs.groupBy("phrase", key).agg(F.count("*").alias("c"))
    total = F.sum("c")
    return counts.groupBy("phrase").agg((F.log(total) - F.sum(F.col("c") * F.log("c")) / total).alias(f"{key}_entropy"))


def mine_phrases(tokens: DataFrame, num_phrases: int = 8192, longest: int = 6, min_count: int = 2) -> DataFrame:
    """The best reusable phrases: phrase, n, count, score, rank.

    Score: count * length * (1.15, or 0.55 for one token repeated) * (1 + entropies of the neighbours on both sides, in nats).
    Ties: longer, then commoner, then the smaller tokens first.
    """
    found = ngrams(tokens, 2, longest)
    counts = found.groupBy("phrase").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    kept = found.join(counts.select("phrase"), "phrase", "left_semi")
    rows = counts.join(_entropy(kept, "left"), "phrase").join(_entropy(kept, "right"), "phrase").withColumn("n", F.size("phrase"))
    weight = F.when(F.size(F.array_distinct("phrase")) > 1, 1.15).otherwise(0.55)
    rows = rows.withColumn("score", F.col("count") * F.col("n") * weight * (1 + F.col("left_entropy") + F.col("right_entropy")))
    # equal scores may differ in their last digits
    order = [F.desc(F.round("score", 9)), F.desc("n"), F.desc("count"), F.asc("phrase")]
    top = rows.orderBy(*order).limit(num_phrases)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("phrase", "n", "count", "score", "rank")


def encode_phrases(tokens: DataFrame, phrases: DataFrame, most: int = 100_000) -> DataFrame:
    """seq, pos, phrase: each sequence cut from left to right into the longest known phrases, single tokens where none fits.

    All phrases go to the executors; more than ``most`` are an error, not a cut.
    """
    known = [tuple(r["phrase"]) for r in phrases.select("phrase").limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"more than {most} phrases")
    sizes, held = sorted({len(p) for p in known}, reverse=True), set(known)
    kind = tokens.schema["token"].dataType.simpleString()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["token"].tolist()
        at, out = 0, []
        while at < len(x):
            n = next((n for n in sizes if tuple(x[at : at + n]) in held), 1)
            out.append((at, x[at : at + n]))
            at += n
        return pd.DataFrame({"seq": pdf["seq"].iloc[0], "pos": [p for p, _ in out], "phrase": [p for _, p in out]})

    return tokens.select("seq", "pos", "token").groupBy("seq").applyInPandas(each, f"seq {tokens.schema['seq'].dataType.simpleString()}, pos int, phrase array<{kind}>")


def phrase_families(tokens: DataFrame, least: int = 2, most: int = 4, min_support: int = 2) -> DataFrame:
    """phrase, support: the number of sequences that hold it, commonest first."""
    return ngrams(tokens, least, most).groupBy("phrase").agg(F.countDistinct("seq").alias("support")).filter(F.col("support") >= min_support)


def phrase_holdout(tokens: DataFrame, phrase: list) -> DataFrame:
    """seq, label: 1 where a sequence holds the phrase; the others are what a model may learn from."""
    hit = ngrams(tokens, len(phrase), len(phrase)).filter(F.col("phrase") == F.array(*[F.lit(x) for x in phrase])).select("seq").distinct().withColumn("label", F.lit(1))
    return tokens.select("seq").distinct().join(hit, "seq", "left").na.fill({"label": 0})


def duplicate_fraction(encoded: DataFrame) -> DataFrame:
    """seq, duplicate_fraction: the share of a sequence's phrases that occur in it before."""
    return encoded.groupBy("seq").agg((1 - F.countDistinct("phrase") / F.count("*")).alias("duplicate_fraction"))


def patches(windows: DataFrame, size: int) -> DataFrame:
    """clip, patch_idx, v: ``size`` consecutive windows' features end to end; the last patch ends with the clip, short clips repeat their last window."""
    rows = windows.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("window_idx", "f"))), lambda s: s["f"]).alias("all"))
    n = F.size("all")
    last = F.greatest(n - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size)), F.array(last)))
    filled = F.when(n >= size, F.col("all")).otherwise(F.concat("all", F.array_repeat(F.element_at("all", -1), size - n)))
    each = rows.select("clip", filled.alias("all"), F.posexplode(starts).alias("patch_idx", "start"))
    return each.select("clip", "patch_idx", F.flatten(F.slice("all", F.col("start") + 1, size)).alias("v"))


def encode_patches(patch_rows: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds ``code``, the nearest of ``codebook(code, centre)``, the lowest of equally near ones. The codebook rides along as one array."""
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "centre"))).alias("book"))
    gap = lambda c: dot(F.zip_with("v", c["centre"], lambda x, y: x - y), F.zip_with("v", c["centre"], lambda x, y: x - y))
    near = F.array_min(F.transform("book", lambda c: F.struct(gap(c).alias("d"), c["code"].alias("code"))))
    return patch_rows.join(F.broadcast(book)).withColumn("code", near["code"]).drop("book")


def code_usage(codes: DataFrame, size: int) -> DataFrame:
    """One row: entropy (nats), perplexity and dead codes of the code column."""
    p = codes.groupBy("code").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    entropy = -F.sum(F.col("p") * F.log(F.col("p") + 1e-12))
    return p.agg(entropy.alias("entropy"), F.exp(entropy).alias("perplexity"), (F.lit(size) - F.count("*")).alias("dead_codes"))
