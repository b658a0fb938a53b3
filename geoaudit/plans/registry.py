"""Queries over the test tables by name, with the SQL that must give the same rows."""

from __future__ import annotations

from geoaudit.plans import clusters, evaluation, grids, reporting

QUERIES = {**evaluation.QUERIES, **grids.QUERIES, **clusters.QUERIES, **reporting.QUERIES}
ORACLE = {**evaluation.ORACLE, **grids.ORACLE, **clusters.ORACLE, **reporting.ORACLE}
