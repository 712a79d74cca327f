"""Whole pipelines and the registered queries."""

from corpusaudit.plans import queries_graph, queries_structure, queries_text  # noqa: F401
from corpusaudit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
