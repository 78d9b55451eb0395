"""All registered queries of the analyses with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from . import attention_queries, format_queries, kernel_queries, position_queries, relational_queries, source_queries, statistic_queries
from .bindings import QUERIES, SQL

flagship = QUERIES["flagship_hub_enrichment"]
MODULES = (position_queries, relational_queries, statistic_queries, attention_queries, kernel_queries, source_queries, format_queries)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
