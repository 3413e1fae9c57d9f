"""JSON Lines of chunk records: read with a fixed schema, bad lines counted, written as UTF-8; audit sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLAGS = ("code", "equation", "example", "definition", "algorithm", "table", "figure")
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "book_id", "book_title", "breadcrumb", "search_text", "chapter", "chapter_title", "section", "section_title", "subsection", "subsection_title")]
    + [T.StructField(c, T.IntegerType()) for c in ("page_start", "page_end", "word_count", "char_count")]
    + [T.StructField(f"contains_{c}", T.BooleanType()) for c in _FLAGS]
    + [T.StructField("text", T.StringType())]
)
BAD = "_corrupt_record"


def read(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """The records; lines that aren't JSON have null columns and stand in ``_corrupt_record``, blank lines are skipped."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """file, bad: how many lines of each file aren't JSON.

    Lines are read as text, so that Spark may not prune the parse away.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where("trim(value) != ''")
    return lines.groupBy("file").agg(F.count_if(F.expr("try_parse_json(value) is null")).alias("bad"))


def write(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept as fields and no character is escaped that need not be."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_split(kept: DataFrame, dropped: DataFrame, path: str) -> None:
    """The kept and the dropped records next to each other."""
    write(kept, f"{path}/kept")
    write(dropped, f"{path}/rejected")


def stale(spark: SparkSession, raw: str, clean: str) -> DataFrame:
    """name, stale: files whose cleaned form is missing or older."""
    stat = lambda p: spark.read.format("binaryFile").load(p).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("at"))
    a, b = stat(raw), stat(clean).withColumnRenamed("at", "cleaned")
    return a.join(b, "name", "left").select("name", (F.col("cleaned").isNull() | (F.col("cleaned") < F.col("at"))).alias("stale"))
