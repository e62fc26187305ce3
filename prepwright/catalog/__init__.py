"""All registered queries and their oracle SQL."""

from prepwright.catalog import learning, quality, registry, statistics, tables, text  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
