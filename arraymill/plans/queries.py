"""All registered queries of the engine."""

from . import queries_catalog, queries_fields, queries_losses, queries_metrics, queries_more, queries_rest, queries_rules, queries_runs, queries_tables, queries_volume, queries_windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
