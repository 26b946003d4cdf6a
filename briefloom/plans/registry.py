"""All queries over the given tables, and the same in SQL."""

from __future__ import annotations

import inspect

from . import queries
from .sql import ORACLE_SQL

QUERIES = {n: f for n, f in vars(queries).items() if inspect.isfunction(f) and f.__module__ == queries.__name__ and not n.startswith("_")}

__all__ = ["ORACLE_SQL", "QUERIES"]
