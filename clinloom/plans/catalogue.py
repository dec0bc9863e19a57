"""The registered queries over the test tables, and the SQL they are compared with."""

from __future__ import annotations

from clinloom.plans import cleaning, cohort, exports, statistics

_MODULES = (cohort, cleaning, statistics, exports)
flagship = cohort.flagship
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
