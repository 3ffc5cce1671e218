"""Cutting the lineage of iterative jobs on storage that all executors share."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a folder next to its warehouse; any other session is refused, because
    executors could not see a folder of the driver's machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(os.path.dirname(_warehouse(spark)), "spark-warehouse", "checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return (configured or context.getCheckpointDir()).rstrip("/")


def _warehouse(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Tables written by the operators that are running, innermost last.
_open: list[list[str]] = []


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written, and whose own tables are deleted then; its first argument is a DataFrame."""
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        paths: list[str] = []
        depth = len(_open)
        _open.append(paths)
        try:
            result = operator(df, *args, **kwargs)
            del _open[depth:]
            return stored(result, operator.__name__)
        finally:  # also after a failure nothing of the operator's own stays
            del _open[depth:]
            for path in paths:
                delete(df.sparkSession, path)

    return run


#: Spark deletes a statement's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that keeps columns compressed.

    The shuffle files behind it are of no more use and are deleted at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/threadloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _open:
        _open[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written and that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is not None:
            delete(table.sparkSession, path)
