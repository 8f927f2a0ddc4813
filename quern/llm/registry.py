"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quern.llm import queries as q

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op")}
ORACLE_SQL = {name[4:]: sql for name, sql in vars(q).items() if name.startswith("SQL_")}
