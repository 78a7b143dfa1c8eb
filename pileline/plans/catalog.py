"""All queries of the engine itself by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import domain, packed, sequences

QUERIES: dict = {**domain.QUERIES, **sequences.QUERIES, **packed.QUERIES}
SQL: dict = {**domain.SQL, **sequences.SQL, **packed.SQL}
