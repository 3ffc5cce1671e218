"""Every operator bound to the stored tables, with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib

MODULES = ["context", "messages", "events", "corpus", "pages", "streams", "misc"]


def load():
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"threadloom.catalog.{name}")
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
