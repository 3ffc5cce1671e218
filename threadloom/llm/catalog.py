"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["packing", "context_tree", "fingerprints", "licenses", "suffixes", "urls", "decontaminate", "language", "line_dedup", "jaccard_join", "clustering", "prefix_trie", "chat_format"]


def load():
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"threadloom.llm.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
