"""Every query of the library by name, with the SQL it must agree with."""

from __future__ import annotations

from redolent.queries import conversations, corpus, generation, lookups, makers, search, sources  # noqa: F401
from redolent.queries.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
