"""Queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from kerf.plans import building, costs, details, lines, outlines, projects, quantities, reports, sheets, site, tables, texts
from kerf.plans.base import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

_MODULES = (building, costs, details, lines, outlines, projects, quantities, reports, sheets, site, tables, texts)
FLAGSHIP = QUERIES["cost_of_projects"]
