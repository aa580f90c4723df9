"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import analyses, tensor_queries, upkeep

FLAGSHIP = "lm_loss_iteration"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "tensor_queries"]  # tensor_queries registers its queries with those of analyses
QUERIES = {**upkeep.QUERIES, **analyses.QUERIES}
SQL = {**upkeep.SQL, **analyses.SQL}
