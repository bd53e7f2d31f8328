"""All queries of the engine by name, and the DuckDB statement of each where SQL can express it."""

from __future__ import annotations

from touchline.plans import analysis, clips, kits, players, service, state, swatches, trajectory

_PARTS = (trajectory, analysis, state, clips, kits, players, service, swatches)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
