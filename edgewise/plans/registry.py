"""All registered queries of the graph operators and their SQL."""

from __future__ import annotations

from edgewise.plans.queries import QUERIES
from edgewise.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
