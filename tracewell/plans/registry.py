"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from . import evaluation, problems, reference  # noqa: F401  (evaluation adds to the reference's queries)


def queries() -> dict:
    return {**problems.QUERIES, **reference.QUERIES}


def oracle_sql() -> dict:
    return {**problems.ORACLES, **reference.ORACLES}
