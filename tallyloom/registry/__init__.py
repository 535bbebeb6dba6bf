"""Registered queries, each beside the same question in SQL."""

from __future__ import annotations

from tallyloom.registry import (
    catalogue_queries,
    fee_queries,
    request_queries,
    timetable_queries,
)

_SUBJECTS = (fee_queries, timetable_queries, catalogue_queries, request_queries)


def all_queries() -> dict:
    return {name: run for subject in _SUBJECTS for name, run in subject.queries().items()}


def all_oracle_sql() -> dict[str, str]:
    return {name: sql for subject in _SUBJECTS for name, sql in subject.oracle_sql().items()}
