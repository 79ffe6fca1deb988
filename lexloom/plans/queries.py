"""All named queries of the corpus engine."""

from __future__ import annotations

from lexloom.plans import catalog, geo, phrases, registry, texts, timeline, topics, variants, views, words  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
