"""All registered queries of the subpackage and their oracle SQL."""
from __future__ import annotations

from monthloom.llm import (
    queries_classifiers, queries_search, queries_texts, queries_tokens, queries_vectors, queries_web,
)

_MODULES = (queries_classifiers, queries_search, queries_texts, queries_tokens, queries_vectors,
            queries_web)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {**queries_search.ORACLES, **queries_web.ORACLES}
