"""Registered queries: operators bound to the given tables."""

from . import articles, cases, claims, evidence, landed, learning, lookups, market, modelling, payloads, questions, rollups, scalars, signals, streams  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL  # noqa: F401
