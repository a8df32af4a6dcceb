"""Every registered query; importing this package fills the registry."""

from encore.plans.base import ORACLES, QUERIES, Tables

from encore.plans import sources, scalar, quality, joins, activity, sessions, timeseries, recommend, evaluate, stats, models  # noqa: F401, E402 isort: skip

__all__ = ["ORACLES", "QUERIES", "Tables"]
