"""Queries by name and their SQL."""

from . import aggregates, ground, joins, rasters, scalars, shapes, trends, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
