"""The core queries by name, with the SQL that states the same where SQL can."""

from __future__ import annotations

from siftwell.plans import analysis, corpus, files, relational

QUERIES: dict = corpus.QUERIES | analysis.QUERIES | relational.QUERIES | files.QUERIES
SQL: dict[str, str] = corpus.SQL | analysis.SQL | relational.SQL | files.SQL
