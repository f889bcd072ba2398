"""All queries, by name."""

from . import attribution, catalogue, certification, domain, features, forecast, models, peers, periods, refresh, relational, shares  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
