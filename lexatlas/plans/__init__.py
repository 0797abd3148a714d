"""All registered queries of the corpus engine."""

from lexatlas.plans import application, catalog, laws, lines, quality  # noqa: F401
from lexatlas.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
