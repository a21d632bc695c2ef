from aerolith.plans import audits, evaluation, features, ingest, models, streams  # noqa: F401
from aerolith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
