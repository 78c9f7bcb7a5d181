"""All registered queries of this package and their SQL."""

from __future__ import annotations

from edgewise.llm import bpe, embedding_dedup, html_extract, mixing, ngram_join, pii, spotsigs, suffix_dedup, toxicity, url_filter

MODULES = (mixing, bpe, pii, toxicity, url_filter, spotsigs, ngram_join, embedding_dedup, html_extract, suffix_dedup)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
