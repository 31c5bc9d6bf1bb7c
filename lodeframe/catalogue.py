"""The named queries of the engine and the SQL that checks each."""

from __future__ import annotations

from lodeframe.plans import lineage_queries, recognition_queries, screen_queries, selection_queries  # noqa: F401
from lodeframe.plans.base import ORACLE, QUERIES  # noqa: F401
