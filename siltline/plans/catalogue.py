"""The registered queries of the storage-forensics operators and their SQL."""

from __future__ import annotations

from siltline.plans import checks, coverage, extraction, formats, listings, relational  # noqa: F401  (they register themselves)
from siltline.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
