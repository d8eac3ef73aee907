"""Names of the runnable queries and the SQL that states each result."""

from __future__ import annotations

from .queries import evaluation, labels, pipelines, ranking, reports, sequences, sources, states

FLAGSHIP = "novelty_ranking"
_PARTS = (ranking, sequences, evaluation, pipelines, labels, sources, states, reports)

QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
