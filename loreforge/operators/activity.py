"""Dashboards: activity by day and weekday, streaks, totals, focus lists, resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions import scores

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def day(ts: str | Column) -> Column:
    """The day of a timestamp or of an ISO text."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.substring(c.cast("string"), 1, 10))


def daily(logs: list[tuple[DataFrame, str]], by: list[str] | None = None) -> DataFrame:
    """by, day, n over several logs, each counted on its own before they meet."""
    by = by or []
    parts = [df.groupBy(*by, day(ts).alias("day")).agg(F.count("*").alias("n")) for df, ts in logs]
    return reduce(DataFrame.unionByName, parts).where("day is not null").groupBy(*by, "day").agg(F.sum("n").alias("n"))


def active_days(logs: list[tuple[DataFrame, str]], by: list[str]) -> DataFrame:
    """The distinct days with any activity."""
    return reduce(DataFrame.unionByName, [df.select(*by, day(ts).alias("day")) for df, ts in logs]).where("day is not null").distinct()


def by_weekday(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, weekday (0 is Monday), name, n: all seven, zero where nothing happened."""
    by = by or []
    spark = days.sparkSession
    week = spark.createDataFrame(list(enumerate(WEEKDAYS)), "weekday int, name string")
    every = days.select(*by).distinct().join(F.broadcast(week), F.lit(True)) if by else week
    n = days.groupBy(*by, F.weekday("day").alias("weekday")).agg(F.sum("n").alias("n"))
    return every.join(n, [*by, "weekday"], "left").fillna(0, ["n"])


def runs(days: DataFrame, by: list[str]) -> DataFrame:
    """by, first, last, length of every run of consecutive days."""
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*by).orderBy("day")))
    return days.withColumn("_run", island).groupBy(*by, "_run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("length")).drop("_run")


def streaks(days: DataFrame, by: list[str], asof: Column) -> DataFrame:
    """by, streak: the run that ends today or yesterday, else 0."""
    now = runs(days.where(F.col("day") <= asof), by).where(F.col("last") >= F.date_sub(asof, 1)).select(*by, F.col("length").alias("streak"))
    return days.select(*by).distinct().join(now, by, "left").fillna(0, ["streak"])


def gaps(covered: DataFrame, by: list[str], at: str, more_than: int) -> DataFrame:
    """by, after, before: neighbours in a set of numbers or days that lie further apart than that."""
    nxt = F.lead(at).over(Window.partitionBy(*by).orderBy(at))
    out = covered.select(*by, at).distinct().withColumn("before", nxt)
    far = F.datediff("before", at) if covered.schema[at].dataType.simpleString() == "date" else F.col("before") - F.col(at)
    return out.where(far > more_than).select(*by, F.col(at).alias("after"), "before")


def totals(parts: list[DataFrame]) -> DataFrame:
    """asked, correct and accuracy over several sources, each with asked and correct in one row."""
    both = reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"))
    return both.withColumn("accuracy", scores.percentage(F.col("correct"), F.col("asked")))


def fill_up(first: DataFrame, rest: DataFrame, n: int, key: list[str], order: list[Column]) -> DataFrame:
    """``first`` in its order and, if it has fewer than n rows, rows of ``rest`` whose key it doesn't have.  ``order`` sorts rows of both kinds."""
    more = rest.join(first.select(*key), key, "left_anti")
    top = first.orderBy(*order).limit(n).withColumn("filled", F.lit(False))
    return top.unionByName(more.orderBy(*order).limit(n).withColumn("filled", F.lit(True))).orderBy("filled", *order).limit(n)


def focus(mastery: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """Topics with name, score, status and colour; ``titles``: by, title (at most one)."""
    # Tenths to the nearest even, in floating point as DuckDB's round_even does; bround goes by the decimal digits.
    score = F.rint(F.coalesce(F.col("theta"), F.lit(scores.START)) * 100 * 10) / 10
    out = mastery.join(titles, by, "left").withColumn("score", score)
    name = F.coalesce(F.col("title"), F.concat(F.lit("Chapter "), F.col(by[-1]).cast("string")))
    return out.withColumns({"name": name, "status": scores.focus_status(F.col("score")), "colour": scores.focus_colour(F.col("score"))}).drop("title")


def first_titles(chunks: DataFrame, by: list[str], *, title: str = "chapter_title", id: str = "id") -> DataFrame:
    """by, title: the title of each group's first row, so that a join doesn't fan out."""
    return chunks.groupBy(*by).agg(F.min_by(title, id).alias("title"))


def chapters(chunks: DataFrame, book: str = "book_id") -> DataFrame:
    """book, chapter, title, chunks, place: chapters in order of first appearance."""
    out = chunks.where("chapter is not null and chapter != ''").groupBy(book, "chapter").agg(F.min_by("chapter_title", "id").alias("title"), F.count("*").alias("chunks"), F.min("id").alias("place"))
    return out


def books(chunks: DataFrame, images: DataFrame | None = None, book: str = "book_id") -> DataFrame:
    """book, passages, chapters, first and last page (1 and 1000 where they are missing or 0), diagrams."""
    page = lambda c, default: F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))
    out = chunks.groupBy(book).agg(
        F.count("*").alias("passages"), F.countDistinct("chapter").alias("chapters"), page(F.min("page_start"), 1).alias("first_page"), page(F.max("page_end"), 1000).alias("last_page")
    )
    if images is None:
        return out
    return out.join(images.groupBy(book).agg(F.count("*").alias("diagrams")), book, "left").fillna(0, ["diagrams"])


def subject_progress(mastery: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """by, progress: whole percent of the mean ability, or of the mean mastery where no ability is known, else 0."""
    a = mastery.groupBy(by).agg(F.bround(F.avg("theta") * 100, 1).alias("a"))
    b = fallback.groupBy(by).agg(F.bround(F.avg("mastery") * 100, 1).alias("b"))
    return a.join(b, by, "full").select(by, F.coalesce("a", "b", F.lit(0.0)).cast("int").alias("progress"))
