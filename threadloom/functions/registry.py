"""Named functions: frame transforms, scalar columns, and functions that return rows."""

from __future__ import annotations

import inspect
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.batches import small_batches
from threadloom.functions.html import read_page


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    function: Callable
    description: str
    signature: str
    returns: str | None = None
    flags: dict = field(default_factory=dict)


class Registry:
    """Functions callable by name, with their signature, description and flags."""

    def __init__(self):
        self._entries: dict[str, Entry] = {}

    def _add(self, name, kind, fn, returns=None, **flags):
        if name in self._entries:
            raise ValueError(f"{name} is registered already")
        self._entries[name] = Entry(
            name, kind, fn, inspect.getdoc(fn) or "", f"{name}{inspect.signature(fn)}", returns, flags
        )
        return fn

    def transform(self, name: str, **flags):
        """Register a function from a DataFrame (and parameters) to a DataFrame."""
        return lambda fn: self._add(name, "transform", fn, **flags)

    def scalar(self, name: str, returns: str, **flags):
        """Register a function of columns; it builds a column expression."""
        return lambda fn: self._add(name, "scalar", fn, returns, **flags)

    def vectorised(self, name: str, returns: str, **flags):
        """Register a function of pandas Series for what column expressions cannot say."""
        def wrap(fn):
            self._add(name, "vectorised", fn, returns, **flags)
            return fn
        return wrap

    def table(self, name: str, schema: str, **flags):
        """Register a class whose ``eval`` takes record batches of a table and yields Arrow tables: a table function.

        It is called with a TABLE argument, which Spark splits among its tasks.
        """
        def wrap(cls):
            self._entries[name] = Entry(
                name, "table", cls, inspect.getdoc(cls) or "", f"{name}{inspect.signature(cls.eval)}", schema,
                {**flags, "udtf": F.arrow_udtf(cls, returnType=schema)},
            )
            return cls
        return wrap

    def __getitem__(self, name: str) -> Entry:
        return self._entries[name]

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, e in self._entries.items() if kind in (None, e.kind))

    def apply(self, df: DataFrame, *steps) -> DataFrame:
        """Chain registered transforms; a step is a name or (name, parameters)."""
        for step in steps:
            name, params = (step, {}) if isinstance(step, str) else step
            entry = self._entries[name]
            if entry.kind != "transform":
                raise TypeError(f"{name} is not a transform")
            df = df.transform(entry.function, **params)
        return df

    def column(self, name: str, *args) -> Column:
        entry = self._entries[name]
        if entry.kind == "vectorised":
            small_batches(SparkSession.getActiveSession())
            return F.pandas_udf(entry.function, entry.returns)(*args)  # made at use: it needs a session
        return entry.function(*args).cast(entry.returns)

    def install(self, spark: SparkSession) -> None:
        """Make vectorised and table functions known to SQL."""
        small_batches(spark)
        for entry in self._entries.values():
            if entry.kind == "vectorised":
                spark.udf.register(entry.name, F.pandas_udf(entry.function, entry.returns))
            elif entry.kind == "table":
                spark.udtf.register(entry.name, entry.flags["udtf"])


registry = Registry()


@registry.scalar("add", "double")
def add(a: Column, b: Column) -> Column:
    """Sum of two numbers."""
    return a + b


@registry.scalar("multiply", "double")
def multiply(a: Column, b: Column) -> Column:
    """Product of two numbers."""
    return a * b


@registry.scalar("tax", "double")
def tax(income: Column, rate: Column) -> Column:
    """Tax on an income at a rate in percent."""
    return income * rate / F.lit(100)


@registry.vectorised("composed", "string")
def composed(text: pd.Series) -> pd.Series:
    """Text in Unicode's composed form (NFC): a letter and its accents are one character where there is one."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@registry.table("html_tables", "page_id bigint, table_no int, row_no int, headers array<string>, cells array<string>")
class HtmlTables:
    """Rows of the tables of pages (page_id, html), read a batch at a time."""

    def eval(self, batch):
        import pyarrow as pa

        rows = [
            (page, number, row_no, table["headers"], row)
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist())
            for number, table in enumerate(read_page(html, ("tables",)).tables) for row_no, row in enumerate(table["rows"])
        ]
        text = pa.list_(pa.string())
        types = [pa.int64(), pa.int32(), pa.int32(), text, text]
        names = ["page_id", "table_no", "row_no", "headers", "cells"]
        yield pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
