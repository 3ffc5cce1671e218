"""Text corpora: files, lines, source unions, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import split_lines


def scan_corpus(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, with_text: bool = True) -> DataFrame:
    """Files under a folder: path, path relative to the root, size and modification time, one row per file.

    Listing alone reads no file content.
    """
    reader = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.load(root)
    path = F.col("_metadata.file_path")
    base = root.rstrip("/")
    columns = [
        path.alias("path"),
        F.regexp_replace(F.substring_index(path, base, -1), "^/", "").alias("relative_path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ]
    return files.select(*columns, *([F.col("value").alias("text")] if with_text else []))


def sorted_listing(files: DataFrame, *by: str) -> DataFrame:
    return files.orderBy(*(by or ("path",)))


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_trailing: bool = True) -> DataFrame:
    """One row per line, numbered from 1, with the number of lines of the text."""
    lines = split_lines(F.col(text), keep_trailing)
    cut = docs.select(key, lines.alias("_lines"))
    return cut.select(
        key, F.size("_lines").cast("bigint").alias("n_lines"), F.posexplode("_lines").alias("_pos", "line")
    ).select(key, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line", "n_lines")


def union_sources(*listings: DataFrame, key: str = "path") -> DataFrame:
    """Union of file listings, each file once."""
    first, *rest = listings
    for other in rest:
        first = first.unionByName(other)
    return first.dropDuplicates([key])


def missing_sources(wanted: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def with_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.col(text), 256))


def skip_unchanged(inputs: DataFrame, manifest: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Inputs whose content hash is not in the manifest: new or changed entities."""
    return with_hash(inputs, text).join(manifest.select(key, "content_hash").distinct(), [key, "content_hash"], "left_anti")
