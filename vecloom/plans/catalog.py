"""The registered queries and their SQL."""

from vecloom.plans import corpus_queries, embedding_queries, library_queries, part_queries

_MODULES = [embedding_queries, corpus_queries, library_queries, part_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
