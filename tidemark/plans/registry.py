"""All queries of the engine's own operators, with the SQL that checks them."""

from . import enriched, feature_plans, market, model_plans, pattern_plans, study_plans

_PARTS = (market, feature_plans, pattern_plans, study_plans, model_plans, enriched)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
