"""Training-data operators: one module per operator, queries in ``queries.py``."""

from tracefold.llm import queries as _queries  # noqa: F401  registers the queries
from tracefold.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
