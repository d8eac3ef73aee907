"""Checks on rankings and inventories, and the gates that decide on a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import stable_random
from .metrics import bootstrap_interval, gini


def ranking_faults(rows: DataFrame, score: str = "score") -> DataFrame:
    """One row: whether ranks run from 1 without gaps, scores never rise, and ids are distinct and not blank."""
    before = F.lag(score).over(Window.orderBy("rank"))
    x = rows.withColumn("__up", F.col(score) > before)
    return x.agg(
        F.count("*").alias("n"), ((F.min("rank") == 1) & (F.max("rank") == F.count("*")) & (F.countDistinct("rank") == F.count("*"))).alias("contiguous"),
        (F.coalesce(F.sum(F.col("__up").cast("long")), F.lit(0)) == 0).alias("non_increasing"), (F.count("*") - F.countDistinct("id")).alias("duplicate_ids"),
        F.sum((F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) == "").cast("long")).alias("blank_ids"),
    )


def model_card(rows: DataFrame, ks: list[int], cluster: str = "cluster") -> DataFrame:
    """For each k: quality, clusters, the largest cluster and the Gini of cluster sizes among the first k."""
    top = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    sizes = top.groupBy("k", cluster).agg(F.count("*").alias("n"))
    spread = gini(sizes, "n", ["k"])
    quality = top.groupBy("k").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"), F.min("quality").alias("min_quality"))
    return quality.join(sizes.groupBy("k").agg(F.count("*").alias("clusters"), F.max("n").alias("largest_cluster")), "k").join(spread, "k")


def overlaps(splits: DataFrame) -> DataFrame:
    """ids that are in more than one split, with their splits."""
    return splits.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")).filter(F.col("splits").contains(","))


def disjoint(splits: DataFrame) -> DataFrame:
    """``splits``, or an error if any id is in two of them."""
    n = overlaps(splits).count()
    if n:
        raise ValueError(f"{n} ids are in more than one split")
    return splits


def coverage_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row on how a manifest and the files there are agree: listed, present, both, and the share of the listed that is present."""
    m, f = manifest.select("id").distinct().withColumn("m", F.lit(1)), files.select("id").distinct().withColumn("f", F.lit(1))
    both = m.join(f, "id", "full")
    return both.agg(F.sum(F.coalesce("m", F.lit(0))).alias("listed"), F.sum(F.coalesce("f", F.lit(0))).alias("present"), F.count(F.when(F.col("m").isNotNull() & F.col("f").isNotNull(), 1)).alias("both")).withColumn("share", F.try_divide("both", "listed"))


def rank_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, from_rank, to_rank, shift of rows in two rankings; null where one lacks the row."""
    return a.select("id", F.col("rank").alias("from_rank")).join(b.select("id", F.col("rank").alias("to_rank")), "id", "full").withColumn("shift", F.col("from_rank") - F.col("to_rank"))


def headroom(facts: DataFrame, by: list[str], policy: str, value: str, oracle: str, baseline: str) -> DataFrame:
    """Per row of ``by``: the oracle's gain over a baseline, and each policy's share of it (null where there is next to none)."""
    pick = lambda name, label: facts.filter(F.col(policy) == name).select(*by, F.col(value).alias(label))
    both = pick(oracle, "__o").join(pick(baseline, "__b"), by).withColumn("headroom", F.col("__o") - F.col("__b"))
    return facts.join(both, by).withColumn("capture", F.when(F.col("headroom") > 1e-12, (F.col(value) - F.col("__b")) / F.col("headroom"))).drop("__o", "__b")


def difficulty_strata(facts: DataFrame, by: list[str], policy: str, value: str, oracle: str, baseline: str) -> DataFrame:
    """Rows of ``by`` by their opportunity (oracle less baseline): none, or low or high against the median of the positive ones."""
    rows = headroom(facts, by, policy, value, oracle, baseline).select(*by, "headroom").distinct()
    middle = rows.filter("headroom > 0").agg(F.percentile("headroom", F.lit(0.5)).alias("__m"))
    return rows.join(F.broadcast(middle)).withColumn("stratum", F.when(F.col("headroom") <= 0, "none").when(F.col("headroom") >= F.col("__m"), "high").otherwise("low")).drop("__m")


def decision_gates(facts: DataFrame, episode: str, policy: str, value: str, primary: str, baseline: str, oracle: str, min_episodes: int = 20, low: float = 0.04, wins: float = 0.70) -> DataFrame:
    """gate, passed, measured: enough episodes, an interval above ``low``, headroom in most episodes, a positive paired difference that wins often enough."""
    own = facts.filter(F.col(policy) == primary)
    n = own.select(F.countDistinct(episode).cast("double").alias("measured"), F.lit("episodes").alias("gate"), F.lit(float(min_episodes)).alias("limit"))
    ci = bootstrap_interval(own, [policy], episode, value).select(F.col("low").alias("measured"), F.lit("interval").alias("gate"), F.lit(low).alias("limit"))
    h = headroom(facts, [episode], policy, value, oracle, baseline).filter(F.col(policy) == primary)
    room = h.agg(F.avg((F.col("headroom") > 0).cast("double")).alias("measured")).select("measured", F.lit("headroom").alias("gate"), F.lit(wins).alias("limit"))
    base = facts.filter(F.col(policy) == baseline).select(episode, F.col(value).alias("__b"))
    paired = own.join(base, episode).agg(F.avg((F.col(value) > F.col("__b")).cast("double")).alias("measured")).select("measured", F.lit("wins").alias("gate"), F.lit(wins).alias("limit"))
    return n.unionByName(ci).unionByName(room).unionByName(paired).select("gate", (F.coalesce("measured", F.lit(0.0)) >= F.col("limit")).alias("passed"), "measured")


def verdict(gates: DataFrame) -> DataFrame:
    """One row: pass if every gate passed, conditional if one failed, else fail."""
    failed = F.sum((~F.col("passed")).cast("int"))
    return gates.agg(F.when(failed == 0, "pass").when(failed == 1, "conditional").otherwise("fail").alias("decision"), failed.alias("failed"))


def pairing_audit(facts: DataFrame, by: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Per row of ``by`` whether all policies start from the same baseline value."""
    return facts.groupBy(*by).agg((F.max(value) - F.min(value)).alias("spread")).withColumn("paired", F.col("spread") <= tolerance)


def source_concentration(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """The largest group's share of each selection."""
    n = rows.groupBy(*by, group).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg((F.max("n") / F.sum("n")).alias("largest_share"), F.count("*").alias("groups"))


def hygiene(selected: DataFrame, pool: DataFrame, targets: DataFrame, valid: Column) -> DataFrame:
    """One row: shares of selected rows that are invalid, outside the pool, or targets, and the number of repeats."""
    p, t = pool.select("id").distinct().withColumn("__p", F.lit(1)), targets.select("id").distinct().withColumn("__t", F.lit(1))
    x = selected.join(p, "id", "left").join(t, "id", "left")
    return x.agg(F.avg((~valid).cast("double")).alias("invalid"), F.avg(F.col("__p").isNull().cast("double")).alias("out_of_pool"), F.avg(F.col("__t").isNotNull().cast("double")).alias("target_leak"), (F.count("*") - F.countDistinct("id")).alias("repeats"))


def gate_thresholds(specs: list[tuple[str, str, float]], support: DataFrame, quality: str = "quality") -> DataFrame:
    """name, threshold (0 to 1) of gate specs (name, mode, value): a ``fixed`` value, or a ``support_quantile`` (0 to 1, or 0 to 100) of the support's quality."""
    out = None
    for name, mode, value in specs:
        if mode == "fixed":
            one = support.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(float(value)).alias("t"))
        elif mode == "support_quantile":
            q = value if value <= 1 else value / 100
            if not 0 <= q <= 1:
                raise ValueError(f"no such quantile: {value}")
            one = support.agg(F.percentile(quality, F.lit(float(q))).alias("t")).select(F.lit(name).alias("name"), "t")
        else:
            raise ValueError(f"no such mode: {mode}")
        out = one if out is None else out.unionByName(one)
    return out.select("name", F.least(F.greatest("t", F.lit(0.0)), F.lit(1.0)).alias("threshold"))


def held_out_folds(rows: DataFrame, folds: int, per_fold: int, fraction: float, seed: str, group: str = "group") -> DataFrame:
    """fold, group, id, role: the largest groups (then by name) in consecutive slices; of each, floor(n * ``fraction``) rows, at least one and not all, are candidates by a hash, the others targets. Groups of one row take no part."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.orderBy(F.desc("__n"), F.col(group).cast("string"))) - 1
    chosen = sizes.withColumn("fold", F.floor(place / per_fold).cast("int")).filter((F.col("fold") < folds) & (F.col("__n") > 1))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(stable_random(F.lit(seed), F.col("id")), "id"))
    take = F.least(F.greatest(F.floor(F.col("__n") * fraction), F.lit(1)), F.col("__n") - 1)
    return rows.select(group, "id").join(chosen, group).withColumn("role", F.when(nth <= take, "candidate").otherwise("target")).select("fold", group, "id", "role")


def soundness_gates(facts: DataFrame, policy: str, uncapped: str, controls: list[str], primary: list[str], independent: list[str], min_wins: int = 3, tolerance: float = 0.002) -> DataFrame:
    """gate, passed of ``facts(fold, policy, view, k, gain, fail_rate)``, and the overall status as the row ``overall``.

    The policy beats every control at every k in at least ``min_wins`` folds by its mean gain over the primary views;
    picks nothing that fails a physical check; loses at most ``tolerance`` to its uncapped form at any k; and
    beats the controls over the independent views too. The last one decides between pass and conditional.
    """

    def mean_gain(views: list[str]) -> DataFrame:
        return facts.filter(F.col("view").isin(views)).groupBy("fold", "policy", "k").agg(F.avg("gain").alias("gain"))

    def beats(views: list[str]) -> DataFrame:
        m = mean_gain(views)
        own = m.filter(F.col("policy") == policy).select("fold", "k", F.col("gain").alias("own"))
        wins = m.filter(F.col("policy").isin(controls)).join(own, ["fold", "k"]).groupBy("policy", "k").agg(F.sum((F.col("own") > F.col("gain") + 1e-12).cast("int")).alias("wins"))
        return wins.agg(F.coalesce(F.min("wins") >= min_wins, F.lit(False)).alias("passed"))

    m = mean_gain(primary)
    own, free = (m.filter(F.col("policy") == p).groupBy("k").agg(F.avg("gain").alias(n)) for p, n in ((policy, "own"), (uncapped, "free")))
    gates = beats(primary).select(F.lit("primary_vs_simple_controls").alias("gate"), "passed")
    gates = gates.unionByName(facts.filter(F.col("policy") == policy).agg(F.coalesce(F.max("fail_rate") <= 0, F.lit(False)).alias("passed")).select(F.lit("physical_validity").alias("gate"), "passed"))
    gates = gates.unionByName(own.join(free, "k").agg(F.coalesce(F.min(F.col("own") - F.col("free")) >= -tolerance, F.lit(False)).alias("passed")).select(F.lit("uncapped_regression").alias("gate"), "passed"))
    gates = gates.unionByName(beats(independent).select(F.lit("independent_temporal_vs_controls").alias("gate"), "passed"))
    last = F.col("gate") == "independent_temporal_vs_controls"
    status = gates.agg(F.min(F.when(~last, F.col("passed"))).alias("safe"), F.min(F.when(last, F.col("passed"))).alias("broad"))
    overall = status.select(F.lit("overall").alias("gate"), F.when(F.col("safe") & F.col("broad"), "pass").when(F.col("safe"), "conditional").otherwise("fail").alias("status"))
    return gates.select("gate", F.when(F.col("passed"), "pass").otherwise("fail").alias("status")).unionByName(overall)


def benchmark_gates(facts: DataFrame, oracle: str, stronger: list[tuple[str, str]], exact: bool, near_zero: float = 0.1, least_gain: float = 0.01) -> DataFrame:
    """gate, status of ``facts(episode, policy, gain, largest_share)``, final gains of each policy in each episode.

    oracle_sanity: the oracle gains as much as any other policy (warn where its denominators aren't ``exact``).
    bad_controls: each (policy, control) of ``stronger`` has the policy ahead. near_zero: the best policy but the
    oracle stays the best over episodes whose oracle gains at least ``near_zero``. source_concentration: no policy
    takes over half from one source on average. incremental_value: each of ``stronger`` leads by over ``least_gain``.
    """
    means = facts.groupBy("policy").agg(F.avg("gain").alias("gain"), F.avg("largest_share").alias("share"))
    others = means.filter(F.col("policy") != oracle)
    sanity = means.agg(F.max(F.when(F.col("policy") == oracle, F.col("gain"))).alias("o"), F.max(F.when(F.col("policy") != oracle, F.col("gain"))).alias("b"))
    sanity = sanity.select(F.lit("oracle_sanity").alias("gate"), F.when(F.col("o").isNull(), "fail").when(F.lit(not exact), "warn").when(F.col("o") + 1e-12 < F.col("b"), "fail").otherwise("pass").alias("status"))

    def leads(gate: str, least: float) -> DataFrame:
        delta = lambda p, c: F.max(F.when(F.col("policy") == p, F.col("gain"))) - F.max(F.when(F.col("policy") == c, F.col("gain")))
        lead = means.agg(F.array(*[delta(p, c) for p, c in stronger]).alias("d"))
        return lead.select(F.lit(gate).alias("gate"), F.when(F.exists("d", lambda x: x.isNull()), "warn").when(F.forall("d", lambda x: x > least), "pass").otherwise("fail").alias("status"))

    kept = facts.join(facts.filter((F.col("policy") == oracle) & (F.col("gain") >= near_zero)).select("episode"), "episode", "left_semi")
    first = lambda f, n: f.filter(F.col("policy") != oracle).groupBy("policy").agg(F.avg("gain").alias("g")).agg(F.max_by("policy", F.struct("g", "policy")).alias(n))
    stable = first(facts, "a").join(first(kept, "b"), F.lit(True)).select(F.lit("near_zero_sensitivity").alias("gate"), F.when(F.col("b").isNull(), "fail").when(F.col("a") == F.col("b"), "pass").otherwise("warn").alias("status"))
    spread = others.agg(F.max("share").alias("s")).select(F.lit("source_concentration").alias("gate"), F.when(F.col("s") <= 0.5, "pass").otherwise("warn").alias("status"))
    return sanity.unionByName(leads("bad_control_sanity", 0.0)).unionByName(stable).unionByName(spread).unionByName(leads("incremental_value", least_gain))
