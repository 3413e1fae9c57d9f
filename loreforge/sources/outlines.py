"""Chapter titles from bookmark outlines and from title files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.functions import text

NUMBERED = r"^(?:Chapter\s+)?(\d{1,2})[\s.:\-–—]+(.+)$"


def chapters(outline: DataFrame) -> DataFrame:
    """book_id, chapter, title, page from bookmarks (book_id, level, place, title, page): the shallowest of each number, the first of equals.

    Titles of fewer than three characters, and numbers, are none.
    """
    t = text.strip(F.regexp_extract("title", NUMBERED, 2))
    found = outline.select("book_id", "level", "place", F.regexp_extract("title", NUMBERED, 1).alias("chapter"), t.alias("t"), "page")
    found = found.where((F.col("chapter") != "") & (F.length("t") >= 3) & ~F.col("t").rlike(r"^[\d.\s]+$"))
    best = found.groupBy("book_id", "chapter").agg(F.min_by(F.struct("t", "page"), F.struct("level", "place")).alias("b"))
    return best.select("book_id", "chapter", F.col("b.t").alias("title"), F.col("b.page").alias("page"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """book_id, chapter, title from a JSON file of books' maps from chapter to title."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return whole.select(F.explode("m").alias("book_id", "t")).select("book_id", F.explode("t").alias("chapter", "title"))
