"""Every query of the library proper, with the SQL that must give the same rows."""

from __future__ import annotations

from cityloom.plans import aggregates, layers, more, scalars, spatial, streets

MODULES = [spatial, aggregates, scalars, layers, more, streets]

QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.SQL.items()}
