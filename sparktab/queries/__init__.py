"""Checked queries over the given tables, one module per operator family."""

from . import q_boosting, q_metrics, q_models, q_neighbors, q_prepare, q_random_trees, q_schema, q_semantic, q_stats  # noqa: F401
from .bases import ORACLES, QUERIES  # noqa: F401
