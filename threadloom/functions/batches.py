"""Sizes of the batches that Python functions get."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of whole texts or pages in an Arrow batch; Spark's own 10,000 are hundreds of megabytes in every Python process.
ROWS_PER_BATCH = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """A task's Python holds at most ``ROWS_PER_BATCH`` rows, however many its partition has; a smaller setting is kept."""
    now = int(spark.conf.get(BATCH, "0"))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(BATCH, str(ROWS_PER_BATCH))
