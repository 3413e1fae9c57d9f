"""Paged text: one file a book with a marker line before each page; lines and pages as rows; blank pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = r"(?i)={3,}\s*PAGE\s+(\d+)\s*={3,}"
BLANK_CHARS = 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the file's name up to ``_raw``), text: a row for each file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_raw)?\.txt$", 1).alias("book_id"), F.col("value").alias("text"))


def pages(books: DataFrame) -> DataFrame:
    """book_id, page, text: the parts behind the markers; a text without any is one page, numbered 1."""
    numbers = F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))
    parts = F.split("text", MARKER)
    # Both are made once a text; within a function of an element the text would be split again for every page.
    cut = books.select("book_id", F.posexplode(F.arrays_zip(parts.alias("t"), F.array_prepend(numbers, F.lit(None)).alias("n"))).alias("at", "p"), (~F.col("text").rlike(MARKER)).alias("whole"))
    return cut.where("whole or at > 0").select("book_id", F.when(F.col("whole"), 1).otherwise(F.col("p.n").cast("int")).alias("page"), F.col("p.t").alias("text"))


def lines(pages_: DataFrame) -> DataFrame:
    """book_id, page, line_no, line, in the order of the three; trailing line ends make no line."""
    body = F.regexp_replace("text", r"^\r?\n|\s+$", "")
    return pages_.select("book_id", "page", F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))


def blank_pages(pages_: DataFrame) -> DataFrame:
    """book_id, pages, blank: how many pages have next to no text, as scanned ones do."""
    n = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return pages_.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(n < BLANK_CHARS).alias("blank"))


def marked(pages_: DataFrame) -> DataFrame:
    """book_id, text: pages written back behind their markers, in order."""
    each = F.struct("page", F.concat(F.lit("\n\n===== PAGE "), F.col("page").cast("string"), F.lit(" =====\n\n"), "text").alias("x"))
    return pages_.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda r: r["x"]), "").alias("text"))
