"""SQL of the greedy selections: a recursion over steps, whose state is the list of ids chosen in each batch."""

from __future__ import annotations

from .base import SCORED

GATE = "(quality >= 0.3 AND stationary <= 0.9 AND max_abs <= 60)"

#: The candidates of two batches with the columns that selections read, and cosines of each two of a batch.
BATCHES = f"""{SCORED}, gap AS (SELECT a.id, min(1 - list_cosine_similarity(a.v, b.v)) AS gap, min(1 - list_cosine_similarity(a.v[:16], b.v[:16])) AS gap_w FROM clips a, clips b WHERE a.role = 'candidate' AND b.role = 'support' GROUP BY a.id),
cand AS MATERIALIZED (SELECT id % 2 AS batch, id, v, final_score AS score, group_id AS cluster, quality, gap, gap_w, {GATE} AS ok FROM scored JOIN gap USING (id)),
sims AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s, list_cosine_similarity(a.v[:16], b.v[:16]) AS s_w FROM cand a JOIN cand b ON a.batch = b.batch)"""


def recursion(value: str, order: str, where: str = "TRUE", steps: str = "1000000", extra: str = "", batch: str = "batch") -> str:
    """``pick(batch, step, chosen, id, value)``: at each step the first row by ``order`` of ``value`` over the rows left.

    ``value`` may aggregate ``s``, the cosines to those chosen (none at the first step), over a row's columns; ``extra`` adds columns of the step.
    """
    return f"""pick AS (SELECT batch, 0 AS step, []::BIGINT[] AS chosen, NULL::BIGINT AS id, NULL::DOUBLE AS value FROM (SELECT DISTINCT {batch} AS batch FROM cand)
UNION ALL SELECT batch, step + 1, list_append(chosen, id), id, value FROM (
  SELECT *{extra} FROM (SELECT r.batch, r.step, r.chosen, c.id, c.quality, c.cluster, {value} AS value FROM pick r JOIN cand c ON c.{batch} = r.batch LEFT JOIN sims s ON s.a = c.id AND list_contains(r.chosen, s.b)
  WHERE NOT list_contains(r.chosen, c.id) AND r.step < {steps} AND {where} GROUP BY r.batch, r.step, r.chosen, c.id, c.quality, c.cluster, c.score, c.gap, c.gap_w))
  QUALIFY row_number() OVER (PARTITION BY batch ORDER BY {order}) = 1)"""


def _all(ctes: str, rest: str = "") -> str:
    return f"WITH RECURSIVE {ctes} SELECT batch, id, step AS rank, round(value, 6) AS value FROM pick WHERE step > 0{rest}"


#: What is not eligible follows by quality, without a value.
_REST = " UNION ALL SELECT batch, id, (SELECT count(*) FROM cand x WHERE x.batch = cand.batch AND x.ok) + row_number() OVER (PARTITION BY batch ORDER BY quality DESC, id), NULL::DOUBLE FROM cand WHERE NOT ok"

MMR = _all(f"{BATCHES}, {recursion('c.score - 0.25 * coalesce(max(s.s), 0)', 'value DESC, id')}")
K_CENTER = _all(f"{BATCHES}, {recursion('least(c.gap, coalesce(1 - max(s.s), 9))', 'value DESC, quality DESC, id', 'c.ok')}", _REST)

_TAKEN = "(SELECT count(*) FROM cand k WHERE k.cluster = c.cluster AND list_contains(r.chosen, k.id))"
CLUSTER_CAP = _all(
    f"{BATCHES}, clusters AS (SELECT id, cluster FROM cand), "
    + recursion(
        "c.score + 0.25 * (count(*) FILTER (k.cluster = c.cluster) = 0)::INT - 0.25 * greatest(coalesce(max(s.s), 0), 0)",
        "(step >= 30 OR taken < CASE WHEN step < 10 THEN 2 ELSE 5 END) DESC, value DESC, id",
    ).replace("LEFT JOIN sims s ON s.a = c.id AND list_contains(r.chosen, s.b)", "LEFT JOIN sims s ON s.a = c.id AND list_contains(r.chosen, s.b) LEFT JOIN clusters k ON k.id = s.b").replace(
        " AS value FROM pick r JOIN", " AS value, count(*) FILTER (k.cluster = c.cluster) AS taken FROM pick r JOIN"
    )
)

_SCALED = "CASE WHEN max({x}) OVER (PARTITION BY batch) - min({x}) OVER (PARTITION BY batch) <= 1e-12 THEN 0 ELSE ({x} - min({x}) OVER (PARTITION BY batch)) / (max({x}) OVER (PARTITION BY batch) - min({x}) OVER (PARTITION BY batch)) END"
BLENDED = _all(
    f"{BATCHES}, "
    + recursion("least(c.gap, coalesce(1 - max(s.s), 9))", "value DESC, quality DESC, id", "c.ok")
    .replace(" AS value FROM pick r JOIN", " AS g, least(c.gap_w, coalesce(1 - max(s.s_w), 9)) AS h FROM pick r JOIN")
    .replace("SELECT * FROM (SELECT r.batch", f"SELECT *, 0.5 * ({_SCALED.format(x='g')}) + 0.5 * ({_SCALED.format(x='h')}) AS value FROM (SELECT r.batch"),
    _REST,
)

#: The candidates in one batch, the first fifteen of k-center; every five are a round.
ROUNDS = f"WITH RECURSIVE {BATCHES.replace('id % 2 AS batch', '0 AS batch')}, {recursion('least(c.gap, coalesce(1 - max(s.s), 9))', 'value DESC, quality DESC, id', 'c.ok', '15')} SELECT batch, ((step - 1) // 5 + 1)::INT AS round, id FROM pick WHERE step > 0"

#: Targets of each batch, their distance to the support and to each candidate.
TARGETS = f"""{BATCHES}, tg AS MATERIALIZED (SELECT a.id % 2 AS batch, a.id AS t, min(1 - list_cosine_similarity(a.v, b.v)) AS before FROM clips a, clips b WHERE a.role = 'target' AND b.role = 'support' GROUP BY a.id),
near_t AS MATERIALIZED (SELECT c.id, t, before, 1 - list_cosine_similarity(x.v, c.v) AS d FROM tg JOIN clips x ON x.id = t JOIN cand c ON c.batch = tg.batch)"""
_GAIN = "(avg(n.before) - avg(least(n.before, n.d, coalesce(m.d, 9)))) / greatest(avg(n.before), 1e-12)"
ORACLE = _all(
    f"{TARGETS}, "
    + f"""pick AS (SELECT batch, 0 AS step, []::BIGINT[] AS chosen, NULL::BIGINT AS id, NULL::DOUBLE AS value FROM (SELECT DISTINCT batch FROM cand)
UNION ALL SELECT batch, step + 1, list_append(chosen, id), id, value FROM (
  SELECT r.batch, r.step, r.chosen, c.id, c.quality, {_GAIN} AS value FROM pick r JOIN cand c ON c.batch = r.batch JOIN near_t n ON n.id = c.id
  LEFT JOIN (SELECT p.batch, x.t, min(x.d) AS d FROM pick p JOIN near_t x ON list_contains(p.chosen, x.id) GROUP BY p.batch, x.t) m ON m.t = n.t
  WHERE NOT list_contains(r.chosen, c.id) AND r.step < 3 GROUP BY r.batch, r.step, r.chosen, c.id, c.quality)
  QUALIFY row_number() OVER (PARTITION BY batch ORDER BY value DESC, quality DESC, id) = 1)"""
)

#: Balls of radius tau about candidates; what those chosen cover drops out of the demand.
COVER = _all(
    f"""{BATCHES}, tau AS (SELECT quantile_cont(d, 0.9) AS tau FROM (SELECT a.id, min(1 - list_cosine_similarity(a.v, b.v)) AS d FROM clips a, clips b WHERE a.role = 'support' AND b.role = 'support' AND a.id <> b.id GROUP BY a.id)),
open AS MATERIALIZED (SELECT batch, id, CASE WHEN under OR n = 0 THEN quality ELSE 0 END AS demand, under OR n = 0 AS under FROM (SELECT *, count(*) FILTER (under) OVER (PARTITION BY batch) AS n FROM (SELECT *, gap > tau + 1e-12 AS under FROM cand, tau))),
ball AS MATERIALIZED (SELECT a, b, 1 - s AS d, demand FROM sims JOIN open ON open.id = b CROSS JOIN tau WHERE 1 - s <= tau AND under),
pick AS (SELECT batch, 0 AS step, []::BIGINT[] AS chosen, NULL::BIGINT AS id, NULL::DOUBLE AS value FROM (SELECT DISTINCT batch FROM cand)
UNION ALL SELECT batch, step + 1, list_append(chosen, id), id, value FROM (
  SELECT r.batch, r.step, r.chosen, c.id, c.quality, c.gap, coalesce(sum(k.demand), 0) AS value, count(k.b) AS n, -sum(greatest(k.demand, 1e-12) * k.d) / sum(greatest(k.demand, 1e-12)) AS centre
  FROM pick r JOIN cand c ON c.batch = r.batch LEFT JOIN (SELECT p.batch AS pb, ball.* FROM pick p JOIN cand z ON z.batch = p.batch JOIN ball ON ball.a = z.id
    ANTI JOIN (SELECT DISTINCT y.b AS covered FROM pick q JOIN ball y ON list_contains(q.chosen, y.a)) cov ON cov.covered = ball.b) k ON k.a = c.id
  WHERE NOT list_contains(r.chosen, c.id) GROUP BY r.batch, r.step, r.chosen, c.id, c.quality, c.gap)
  QUALIFY row_number() OVER (PARTITION BY batch ORDER BY round(value, 9) DESC, n DESC, round(centre, 9) DESC NULLS LAST, quality DESC, gap DESC, id DESC) = 1)"""
)

ORACLES = {
    "mmr_selection": MMR, "k_center_selection": K_CENTER, "cluster_cap_selection": CLUSTER_CAP, "blended_k_center_selection": BLENDED, "acquisition_rounds": ROUNDS, "oracle_selection": ORACLE, "cover_gap_selection": COVER,
}
