"""All core queries by name, with their SQL."""

from __future__ import annotations

from lodevec.plans import archiving, arranging, files, searching

_MODULES = [searching, arranging, archiving, files]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
