"""Registered queries with their DuckDB counterparts."""

from . import analysis, audits, contexts, decisions, details, files, history, learning, scalars, scale, streams, temporal
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "audits", "contexts", "decisions", "details", "files", "history", "learning", "scalars", "scale", "streams", "temporal"]
