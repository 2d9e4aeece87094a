"""All queries of the core."""

from __future__ import annotations

from . import answers, base, chunks, corpus, crawl, pages, questions, retrieval, state, urls  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
