"""Score blends, promotions, guards and reason codes.

Rows are clips with columns id, quality, novelty, density and, where a function
says so, token statistics; ``by`` names the columns of the batch that scaling
runs over (all rows if none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip01, finite, minmax, scaled, when_any
from ..storage import materialise

#: The reasons' names and thresholds.
LOW_QUALITY = 0.45
COHESIVE, RARE_TEMPORAL, SINGLETON, REDUNDANT, PRIMITIVES = "COHESIVE_NEW_WORKFLOW", "RARE_TEMPORAL_COMPOSITION", "HIGH_NOVELTY_SINGLETON", "REDUNDANT_KNOWN_WORKFLOW", "RARE_MOTION_PRIMITIVES"


def with_scaled(rows: DataFrame, columns: dict[str, str], by: list[str] | None = None, constant: str = "zero") -> DataFrame:
    """``rows`` with columns scaled to 0..1 within the groups of ``by``; over all rows the bounds come from an aggregation, one row that every task gets."""
    if by:
        return rows.withColumns({new: minmax(F.col(old), by, constant) for new, old in columns.items()})
    rows = materialise(rows, "unscaled")
    bounds = rows.agg(*[f(finite(F.col(old))).alias(f"__{k}_{old}") for old in dict.fromkeys(columns.values()) for k, f in (("low", F.min), ("high", F.max))])
    out = rows.join(F.broadcast(bounds), F.lit(True))
    out = out.withColumns({new: scaled(F.col(old), F.col(f"__low_{old}"), F.col(f"__high_{old}"), constant) for new, old in columns.items()})
    return out.drop(*bounds.columns)


def scored(rows: DataFrame, novelty_weight: float = 0.75, by: list[str] | None = None) -> DataFrame:
    """novelty_score and density_score (scaled), ranker_score (their blend) and final_score (that times quality)."""
    out = with_scaled(rows, {"novelty_score": "novelty", "density_score": "density"}, by)
    out = out.withColumn("ranker_score", novelty_weight * F.col("novelty_score") + (1 - novelty_weight) * F.col("density_score"))
    return out.withColumn("final_score", F.col("quality") * F.col("ranker_score"))


def support_score(density: Column, cluster_size: Column) -> Column:
    """0.65 parts density and 0.35 parts log(1 + size) in units of log 11."""
    return clip01(0.65 * density + 0.35 * F.log1p(F.greatest(cluster_size.cast("double"), F.lit(1.0))) / F.log(F.lit(11.0)))


def surprise_score(nll_p95: Column, rare_phrase: Column) -> Column:
    """0.60 parts of 1 - exp(-nll / 4) and 0.40 parts rare phrases."""
    return clip01(0.60 * (1 - F.exp(-F.greatest(nll_p95, F.lit(0.0)) / 4)) + 0.40 * rare_phrase)


def simple_ranking(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The plain ranker over novelty, density, cluster_size, token_nll_p95, rare_phrase and quality.

    0.5 parts novelty (half scaled over the batch, equal values clipped; half
    clipped), 0.3 support, 0.2 surprise; times quality, and 0.75 for singletons.
    """
    novelty = 0.5 * minmax(F.col("novelty"), by, "clip") + 0.5 * clip01(F.col("novelty"))
    out = rows.withColumn("novelty_score", novelty).withColumn("support_score", support_score(F.col("density"), F.col("cluster_size")))
    out = out.withColumn("grammar_score", surprise_score(F.col("token_nll_p95"), F.col("rare_phrase")))
    blend = 0.5 * F.col("novelty_score") + 0.3 * F.col("support_score") + 0.2 * F.col("grammar_score")
    out = out.withColumn("final_score", clip01(F.col("quality") * F.when(F.col("cluster_size") <= 1, 0.75).otherwise(1.0) * blend))
    n, s = F.col("novelty_score"), F.col("support_score")
    reason = when_any(
        (F.col("quality") < LOW_QUALITY, "LOW_QUALITY"),
        ((n >= 0.50) & (s >= 0.45), COHESIVE),
        ((F.col("rare_phrase") >= 0.20) | (F.col("token_nll_p95") >= 3.0), RARE_TEMPORAL),
        (n >= 0.65, SINGLETON),
        ((s >= 0.65) & (n < 0.30), REDUNDANT),
        (F.col("grammar_score") > 0.25, PRIMITIVES),
        default=REDUNDANT,
    )
    return out.withColumn("reason_code", reason)


def reason_code(component: Column | None = None, delta: Column | None = None) -> Column:
    """The reason of a scored row, from novelty_score, density_score, quality and, if given, its grammar component and promotion."""
    n, d = F.col("novelty_score"), F.col("density_score")
    rules = [(F.col("quality") < LOW_QUALITY, "LOW_QUALITY"), ((n >= 0.65) & (d >= 0.45), COHESIVE), (n >= 0.65, SINGLETON)]
    if component is not None and delta is not None:
        rules.append(((component >= 0.75) & (delta >= 0.08) & (d >= 0.35), RARE_TEMPORAL))
    return when_any(*rules, ((n < 0.35) & (d >= 0.65), REDUNDANT), default=PRIMITIVES)


def grammar_variant(variant: str, by: list[str] | None = None) -> Column:
    """A scaled mix of scaled surprisals: token_nll_p95, grammar_phrase_mix or grammar_surprisal_mix (also quality_gated_grammar).

    The mix is scaled in ``grammar_promotion``, since a window can't run over a window.
    """
    nll = minmax(F.col("token_nll_p95"), by)
    if variant == "token_nll_p95":
        return nll
    if variant == "grammar_phrase_mix":
        return 0.70 * nll + 0.30 * minmax(F.col("rare_phrase"), by)
    if variant in ("grammar_surprisal_mix", "quality_gated_grammar"):
        return 0.65 * nll + 0.25 * minmax(F.col("transition_nll_p95"), by) + 0.10 * minmax(F.col("longest_unseen"), by)
    raise ValueError(f"no such grammar variant: {variant}")


def grammar_promotion(rows: DataFrame, variant: str = "grammar_surprisal_mix", weight: float = 0.2, min_quality: float = 0.45, min_density: float = 0.35, by: list[str] | None = None) -> DataFrame:
    """Mixes a gated grammar component into scored rows that have grammar features (has_grammar)."""
    most = 1.0 if variant == "quality_gated_grammar" else 0.35
    if not 0 <= weight <= most:
        raise ValueError(f"weight must be within 0 and {most}")
    out = rows.withColumn("__mix", grammar_variant(variant, by)).withColumn("grammar_score", minmax(F.col("__mix"), by) if variant != "token_nll_p95" else F.col("__mix")).drop("__mix")
    gate = ((F.col("quality") >= min_quality) & (F.col("density_score") >= min_density)).cast("double")
    share = F.lit(1.0) if variant == "quality_gated_grammar" else F.col("density_score")
    out = out.withColumn("grammar_component", F.when(F.col("has_grammar"), F.col("grammar_score") * share * gate).otherwise(0.0))
    blended = (1 - weight) * F.col("ranker_score") + weight * F.col("grammar_component")
    out = out.withColumn("base_score", F.col("final_score")).withColumn("__r", F.when(F.col("has_grammar"), blended).otherwise(F.col("ranker_score")))
    out = out.withColumn("final_score", F.when(F.col("has_grammar"), clip01(F.col("quality") * F.col("__r"))).otherwise(F.col("final_score")))
    out = out.withColumn("promotion", F.when(F.col("has_grammar"), F.col("final_score") - F.col("base_score")).otherwise(0.0))
    out = out.withColumn("ranker_score", F.when(F.col("has_grammar"), clip01(F.col("__r"))).otherwise(F.col("ranker_score"))).drop("__r")
    return out.withColumn("reason_code", reason_code(F.col("grammar_component"), F.col("promotion")))


def stationary_guard(rows: DataFrame, stationary: float = 0.90, max_density: float = 0.35, min_grammar: float = 0.85, factor: float = 0.35) -> DataFrame:
    """Scales down scored rows that are novel alone, mostly still, and backed by neither density nor grammar; ``guarded`` says which."""
    grammar = F.coalesce(F.col("grammar_component"), F.lit(0.0)) if "grammar_component" in rows.columns else F.lit(0.0)
    thin = F.col("density_score") < max_density
    alone = (F.col("novelty_score") >= 0.65) & thin
    if "reason_code" in rows.columns:
        alone = alone | (F.col("reason_code") == SINGLETON)
    out = rows.withColumn("guarded", alone & (F.col("stationary") >= stationary) & thin & (grammar < min_grammar))
    ranker = F.when(F.col("guarded"), clip01(F.col("ranker_score") * factor)).otherwise(F.col("ranker_score"))
    out = out.withColumn("unguarded_score", F.col("final_score")).withColumn("ranker_score", ranker)
    return out.withColumn("final_score", F.when(F.col("guarded"), clip01(F.col("quality") * F.col("ranker_score"))).otherwise(F.col("final_score")))


def spike_penalty(rate: Column, threshold: float, strength: float, minimum: float) -> Column:
    """1 up to the threshold, then falling by ``strength`` for each threshold's worth above, to a minimum."""
    if threshold <= 0:
        return F.lit(1.0)
    return F.when(rate <= threshold, 1.0).otherwise(F.greatest(F.lit(minimum), 1 - strength * (rate - threshold) / threshold))


def blended_distance(left: str, right: str, alpha: float, by: list[str] | None = None) -> Column:
    return alpha * minmax(F.col(left), by) + (1 - alpha) * minmax(F.col(right), by)


def score_recipes(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """id, recipe, value: the blends that calibration compares."""
    n, d, q = minmax(F.col("novelty"), by), minmax(F.col("density"), by), F.col("quality")
    recipes = {"quality": q, "novelty": n, "density": d, "novelty_density": 0.75 * n + 0.25 * d, "quality_novelty": q * n, "quality_novelty_density": q * (0.75 * n + 0.25 * d)}
    return rows.select("id", *[v.alias(k) for k, v in recipes.items()]).unpivot("id", list(recipes), "recipe", "value")


def threshold_grid(rows: DataFrame, novelty: list[float], density: list[float]) -> DataFrame:
    """Reasons of scored rows under each pair of thresholds, counted. Each row carries the small grid; no join is needed."""
    cells = F.array(*[F.struct(F.lit(a).alias("novelty_at"), F.lit(b).alias("density_at")) for a in novelty for b in density])
    each = rows.select("quality", "novelty_score", "density_score", F.explode(cells).alias("g")).select("*", "g.*")
    novel, dense = F.col("novelty_score") >= F.col("novelty_at"), F.col("density_score") >= F.col("density_at")
    reason = when_any((F.col("quality") < LOW_QUALITY, "LOW_QUALITY"), (novel & dense, COHESIVE), (novel, SINGLETON), (dense, REDUNDANT), default=PRIMITIVES)
    return each.withColumn("reason_code", reason).groupBy("novelty_at", "density_at", "reason_code").agg(F.count("*").alias("n"))


#: The parts of blend reasons.
BLEND_REASONS = ["BLEND_KCENTER", "HYGIENE_PASS", "HYGIENE_FALLBACK", "HIGH_OLD_NOVELTY", "SINGLETON_CLUSTER"]
CONSENSUS = "CONSENSUS"


def blend_reason(passed: Column, novelty: Column, singleton: Column) -> Column:
    """Why a blended selection took a row, parts joined by bars; novelty counts as high from 0.75."""
    base, ok, fallback, high, single = BLEND_REASONS
    return F.concat_ws("|", F.lit(base), F.when(F.coalesce(passed, F.lit(False)), ok).otherwise(fallback), F.when(novelty >= 0.75, high), F.when(singleton, single))


def consensus_reason(reason: Column) -> Column:
    """A reason with CONSENSUS as a part, at the end if it isn't there yet; blank parts go."""
    parts = F.filter(F.split(F.coalesce(F.trim(reason), F.lit("")), r"\|"), lambda p: p != "")
    return F.array_join(F.when(F.array_contains(parts, CONSENSUS), parts).otherwise(F.array_append(parts, F.lit(CONSENSUS))), "|")
