"""The queries of this package and their SQL."""

from vecloom.llm import jaccard, neighbours, packing, pages, quality, secrets, sentencepieces, substring, tokens_file, toxicity

_MODULES = [jaccard, neighbours, packing, pages, quality, secrets, sentencepieces, substring, tokens_file, toxicity]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
