"""Every query of the reference's operators, by name."""

from __future__ import annotations

from rasterloom.plans import objects, pipelines, pixels, rasters, sampling, scalars

_PLANS = (objects, pipelines, pixels, rasters, sampling, scalars)
QUERIES = {name: f for plan in _PLANS for name, f in plan.query.queries.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.query.oracles.items()}
FLAGSHIP = "class_balance"
