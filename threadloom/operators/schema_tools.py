"""Recursive projections over nested columns, built from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of a trace that hold its shape and are kept in every projection.
STRUCTURAL_KEYS = ["observations", "children"]
# Keys that differ between two runs of the same program.
VOLATILE_KEYS = [
    "createdAt", "id", "calculated_input_cost", "calculated_output_cost", "calculated_total_cost", "cost_details", "latency",
    "parent_observation_id", "trace_id", "updatedAt", "unit", "totalTokens", "completionTokens", "projectId",
    "usagePricingTierId", "usagePricingTierName",
]


def _rebuild(column: Column, data_type: T.DataType, keep) -> Column | None:
    """``column`` with only the fields ``keep`` accepts; None when nothing is left of a struct."""
    if isinstance(data_type, T.StructType):
        fields = []
        for f in data_type.fields:
            if keep(f.name):
                inner = _rebuild(column[f.name], f.dataType, keep)
                if inner is not None:
                    fields.append(inner.alias(f.name))
        if not fields:
            return None
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, (T.StructType, T.ArrayType)):
        if _is_empty(data_type.elementType, keep):
            return None
        return F.transform(column, lambda x: _rebuild(x, data_type.elementType, keep))
    return column


def _is_empty(data_type: T.DataType, keep) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _is_empty(data_type.elementType, keep)
    if isinstance(data_type, T.StructType):
        return all(not keep(f.name) or _is_empty(f.dataType, keep) for f in data_type.fields)
    return False


def _project(df: DataFrame, keep) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        if keep(f.name) and not _is_empty(f.dataType, keep):
            columns.append(_rebuild(F.col(f.name), f.dataType, keep).alias(f.name))
    return df.select(*columns)


def keep_fields(df: DataFrame, keys: list[str], structural: list[str] | None = None) -> DataFrame:
    """Only the named fields at every level; structural fields are always kept."""
    wanted = set(keys) | set(STRUCTURAL_KEYS if structural is None else structural)
    return _project(df, wanted.__contains__)


def drop_volatile(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Without ids, costs and times at every level, so that two runs can be compared."""
    unwanted = set(VOLATILE_KEYS if keys is None else keys)
    return _project(df, lambda name: name not in unwanted)
