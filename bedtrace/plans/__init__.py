"""Named queries that bind the operators to the given tables."""

from bedtrace.plans import q_ensemble, q_features, q_interp, q_layout, q_metrics, q_models, q_pool, q_sequence, q_spatial  # noqa: F401
from bedtrace.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
