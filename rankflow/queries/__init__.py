"""Registered queries: each reads the whole tables and has its SQL twin beside it where SQL can say it."""

from rankflow.queries import cleaning, ingesting, ranking

FAMILIES = (cleaning, ingesting, ranking)


def all_queries() -> dict:
    return {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
