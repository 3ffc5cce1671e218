"""Trace export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.spans import export_trace_rows, span_tree


def export_trace_json(spans: DataFrame, path: str, key: str = "trace_id", start: str = "ts", mode: str = "errorifexists") -> None:
    """Write spans as JSON lines, range-partitioned by trace and position, with depth and path of the tree.

    Reading the lines in order gives each trace as a pre-sorted, nested-by-path document, and no trace has
    to fit one task.
    """
    tree = span_tree(spans).select("span_id", "root_id", "depth", "path")
    rows = export_trace_rows(spans, key, start).join(tree, "span_id")
    ordered = rows.repartitionByRange(key, "position").sortWithinPartitions(key, "position")
    ordered.write.mode(mode).json(path)
