"""Entity records as files: JSON in month and entity folders, safe writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.pages import entity_code
from threadloom.functions.text import month_label

_STRINGS = T.ArrayType(T.StringType())

BILL_SCHEMA = T.StructType([
    T.StructField("base_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("tabs", T.MapType(T.StringType(), T.StructType([
        T.StructField("success", T.BooleanType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()), T.StructField("error", T.StringType()),
    ]))),
])

VOTE_SCHEMA = T.StructType([
    T.StructField("vote_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("members", T.MapType(T.StringType(), _STRINGS)),
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("headers", _STRINGS), T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]))),
])

ANALYSIS_SCHEMA = T.StructType([
    T.StructField("bill_title", T.StringType()), T.StructField("date_of_vote", T.StringType()),
    T.StructField("brief_summary", T.StringType()), T.StructField("pros", _STRINGS), T.StructField("cons", _STRINGS),
])


#: Files up to this size are read as one row each, and their form is found; a larger file is one record in each line.
WHOLE_FILE_BYTES = 64 << 20
_BROKEN = "_broken"


def _files(spark: SparkSession, root: str, pattern: str, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=whole).withColumn("path", F.col("_metadata.file_path"))


def framed_records(text: Column) -> Column:
    """The JSON texts of the records of one file, by its form: an array, one object over many lines, or one object a line.

    An array that cannot be read is one (broken) record; blank lines are none.
    """
    plain = F.btrim(text, F.lit(" \t\r\n\ufeff"))
    lines = F.filter(F.split(plain, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t")) != "")
    valid = lambda x: F.try_parse_json(x).isNotNull()
    # inside one indented object no further line starts with a brace
    many = F.exists(F.slice(lines, 2, F.size(lines)), lambda x: x.startswith("{"))
    first = F.element_at(lines, 1)
    one = plain.startswith("{") & ~valid(first) & (valid(plain) | ~many)
    return (
        F.when(plain == "", F.array().cast("array<string>"))
        .when(plain.startswith("["), F.coalesce(F.from_json(plain, "array<string>"), F.array(plain)))
        .when(one, F.array(plain)).otherwise(lines)
    )


def read_records(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*.json", whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """JSON records of all files below ``root``, with month and entity recovered from the folders.

    A file may hold one record in each line, an array of records or one record over many lines; the form is found for
    each file, so one folder may mix them.  Files beyond ``whole_file_bytes`` are read line by line, in many tasks.
    What is no record becomes a row with ``error`` and null fields; in a good row ``error`` is null.

    Folders may be plain (``Jan2025/HR498``) or named (``month=Jan2025/entity=HR498``); a missing level is null.
    """
    # sizes are known from the listing, so each file is read in one of the two ways only
    small = _files(spark, root, pattern, True).filter(F.col("_metadata.file_size") <= whole_file_bytes)
    small = small.select("path", F.explode(framed_records(F.col("value"))).alias("json"))
    large = _files(spark, root, pattern, False).filter(F.col("_metadata.file_size") > whole_file_bytes)
    rows = small.unionAll(large.filter(F.btrim("value", F.lit(" \t\r")) != "").select("path", F.col("value").alias("json")))
    checked = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    rows = rows.withColumn("r", F.from_json("json", checked, {"columnNameOfCorruptRecord": _BROKEN}))
    broken = F.col(f"r.{_BROKEN}").isNotNull() | F.col("r").isNull() | ~F.coalesce(F.ltrim("json").startswith("{"), F.lit(False))
    error = F.when(broken, F.concat(F.lit("not a record: "), F.substring("json", 1, 80)))
    month = F.regexp_extract("path", r"/(?:month=)?((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{4})/", 1)
    entity = F.regexp_extract("path", r"/(?:entity=)?((?:HR|S|HJRes|SJRes|HConRes|SConRes|HRes|SRes)\d+)/", 1)
    return rows.select(
        *[F.when(~broken, F.col(f"r.{f}")).alias(f) for f in schema.fieldNames()], F.when(month != "", month).alias("month"),
        F.when(entity != "", entity).alias("entity"), "path", error.alias("error"),
    )


def with_folders(records: DataFrame, url: str, date: str) -> DataFrame:
    """Add the month label of an MM/DD/YYYY date and the entity code of an address; both may be null."""
    day = F.to_date(F.try_to_timestamp(F.col(date), F.lit("MM/dd/yyyy")))
    return records.withColumns({"month": month_label(day), "entity": entity_code(F.col(url))})


def write_partitioned(
    df: DataFrame, root: str, by=("month", "entity"), fmt: str = "parquet", mode: str = "append",
    max_records: int = 5_000_000, pieces: int = 1,
) -> None:
    """One folder per month and entity; null keys go to the default folder.

    Rows are shuffled by the folder keys and a salt, so a folder is written by ``pieces`` tasks and a very
    large one by as many as it needs, without small files elsewhere.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if "map<" not in dict(df.dtypes)[c]]), F.lit(max(1, pieces)))
    spread = df.repartition(*[F.col(c) for c in by], salt)
    spread.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(*by).format(fmt).save(root)


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Fails when the target exists."""
    df.write.mode("errorifexists").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def timestamped_copy(df: DataFrame, path: str, at: dt.datetime, fmt: str = "parquet") -> str:
    """Write next to ``path`` under the time of the run; returns the new path."""
    target = f"{path}_{at:%Y%m%d_%H%M%S}"
    write_new(df, target, fmt)
    return target
