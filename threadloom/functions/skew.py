"""Joins on keys where a few values hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, merge: bool = True) -> DataFrame:
    """Equi-join that spreads each key of ``left`` over ``salts`` tasks.

    ``right`` is repeated once per salt, so it should be the smaller side.  Both sides are merged: Spark estimates
    ``right`` by its files, before any row is repeated, so as a broadcast it would grow with the input unseen.
    ``merge`` is false for a right side that does not; Spark chooses then.  Valid for joins that keep left rows
    (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    plain = [f.name for f in left.schema.fields if not _has_map(f.dataType)]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge") if merge else copies, [*on, "_salt"], how).drop("_salt")


def _has_map(data_type) -> bool:
    return "map<" in data_type.simpleString() or "variant" in data_type.simpleString()
