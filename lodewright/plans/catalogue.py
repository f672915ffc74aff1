"""All named queries outside the optional subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodewright.plans import code, fusion, general, graph, history, report, serving, sessions, structure

_PARTS = (general, history, structure, graph, code, fusion, sessions, report, serving)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
