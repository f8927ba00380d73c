"""Query catalogue: name -> DataFrame builder, and the SQL that must give the same rows."""

from __future__ import annotations

from echofold.queries import changes, exact, markup, semantic, signatures, similar

_MODULES = (exact, similar, semantic, markup, changes, signatures)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
