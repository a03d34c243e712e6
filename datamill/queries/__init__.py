"""All registered queries with their SQL texts."""

from datamill.queries import dataset, evaluation, jobs, labelling, models, selection, tracking

MODULES = [dataset, evaluation, labelling, selection, tracking, jobs, models]


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
