"""Quality of a chunk table: missing fields, duplicates, lengths, noise, verdicts; noise reasons; row-count reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions import text

REQUIRED = ("chunk_id", "book_id", "text")
#: Least words of a chunk, most tokens, shares above which a table needs work.
SHORT_WORDS, MOST_TOKENS, MANY_LONG, MANY_SHORT, MANY_NOISY = 30, 256, 0.10, 0.10, 0.02
LEAST, MOST, HARD = 250, 1200, 1800
#: Patterns of front matter, tables of contents and indexes.
FRONT_MATTER = r"(?i)\bcopyright\b|all rights reserved|click here for terms of use|published by|library of congress cataloging"
CONTENTS_HEADING = r"(?im)^\s*(?:contents|table of contents|brief contents)\s*$"
DOTTED_ENTRY = r"\.{4,}\s*\d+"
CONTENTS_WORD = r"(?i)\bcontents\b"
NUMBER = r"\b\d+\b"
INDEX_HEADING = r"(?im)^\s*(?:index|subject index|general index)\s*$"
INDEX_ENTRY = r"\b[A-Za-z]+(?:\s+[A-Za-z]+)?\s*,\s*\d+(?:\s*[-–,]\s*\d+)*"
LONE_WORD = r"(?m)^[A-Z][A-Za-z'’\-]+\s*$"
SHORT_NUMBER = r"\b\d{1,4}\b"


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """A count of null or empty values for each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_surplus(df: DataFrame, column: str) -> DataFrame:
    """surplus: how many rows repeat another's value."""
    return df.where(F.col(column) != "").groupBy(F.xxhash64(column), F.md5(column)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def is_noisy(body: Column, code: Column) -> Column:
    return ((text.alpha_ratio(body) < 0.5) & ~code) | text.has_long_repeat(body) | F.contains(body, F.lit("�"))


def looks_like_code(body: Column) -> Column:
    return body.rlike(r"[;{}]|#include|==|->")


def profile(df: DataFrame, *, body: str = "text", by: list[str] | None = None) -> DataFrame:
    """Counts, lengths and shares of a text table; the median is the upper one."""
    c = F.coalesce(F.col(body), F.lit(""))
    n_words, tokens = text.word_count(c), text.token_estimate(c)
    rows = df.select(*(by or []), n_words.alias("w"), tokens.alias("t"), is_noisy(c, looks_like_code(c)).alias("noisy"), (text.strip(c) == "").alias("empty"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(F.col("empty")).alias("empty"), F.count_if(~F.col("empty") & (F.col("w") < SHORT_WORDS)).alias("short"), F.count_if(~F.col("empty") & (F.col("t") > MOST_TOKENS)).alias("long"),
        F.count_if(~F.col("empty") & F.col("noisy")).alias("noisy"), F.min(F.when(~F.col("empty"), F.col("t"))).alias("least_tokens"), F.max(F.when(~F.col("empty"), F.col("t"))).alias("most_tokens"),
        F.bround(F.avg(F.when(~F.col("empty"), F.col("w"))), 1).alias("mean_words"),
    )


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The middle value, the upper of two, from counts of distinct values."""
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumns({"upto": upto, "total": total}).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(value).alias("median"))


def verdict(report: DataFrame) -> DataFrame:
    """Adds problems (texts) and ready, from a profile with a column ``structural`` of structural errors."""
    n = F.greatest(F.col("n"), F.lit(1))
    found = F.array_compact(F.array(
        F.when(F.col("structural") > 0, "structural errors"), F.when(F.col("long") / n > MANY_LONG, "many chunks are too long to be embedded whole"),
        F.when(F.col("short") / n > MANY_SHORT, "many tiny chunks"), F.when(F.col("noisy") / n > MANY_NOISY, "noisy text"),
    ))
    return report.withColumn("problems", found).withColumn("ready", F.size("problems") == 0)


def page_errors(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (start < 1) | (end < start)


def is_incomplete(body: Column, code: Column, equation: Column) -> Column:
    """Prose that ends without a mark that ends sentences."""
    return (text.strip(body) != "") & ~code & ~equation & ~text.strip(body).rlike(r"[.!?\"')\]}]$")


def chunk_report(df: DataFrame) -> DataFrame:
    """The whole-table check of built chunks, in one pass; ``hard_failures`` must be 0 before they are written."""
    w = F.col("word_count")
    counts = {
        "short": w < LEAST, "large": w > MOST, "hard_large": w > HARD, "incomplete": is_incomplete(F.col("text"), F.col("contains_code"), F.col("contains_equation")),
        "missing": F.col("chunk_id").isNull() | (F.col("chunk_id") == "") | F.col("book_id").isNull() | (F.col("book_id") == "") | (text.strip(F.coalesce("text", F.lit(""))) == ""),
        "bad_pages": F.col("page_start") > F.col("page_end"), "word_mismatch": w != text.word_count(F.col("text")),
    }
    # By id first, so that repeated ids are seen in the same pass.
    each = df.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count(w).alias("sized"), F.sum(w).alias("words"), F.min(w).alias("least"), F.max(w).alias("most"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.bround(F.try_divide(F.sum("words").cast("double"), F.sum("sized")), 1).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"), *[total(k) for k in counts],
        F.count_if(F.col("n") > 1).alias("duplicates"),
    )
    return out.withColumn("hard_failures", F.col("missing") + F.col("duplicates") + F.col("bad_pages") + F.col("word_mismatch") + F.col("hard_large") + F.when(F.col("total") == 0, 1).otherwise(0))


def assert_sound(df: DataFrame) -> DataFrame:
    """The chunks themselves, or an error that names the failed checks."""
    r = chunk_report(df).first()
    if r.hard_failures:
        raise ValueError("unsound chunks: " + ", ".join(f"{c} {r[c]}" for c in ("total", "missing", "duplicates", "bad_pages", "word_mismatch", "hard_large")))
    return df


# ---- noise -------------------------------------------------------------------


def is_front_matter(c: Column) -> Column:
    return c.rlike(FRONT_MATTER)


def is_contents(c: Column) -> Column:
    """A table of contents by its heading, its dotted lines, or the word and many numbers."""
    heading = c.rlike(CONTENTS_HEADING)
    dotted = F.regexp_count(c, F.lit(DOTTED_ENTRY)) >= 3
    named = c.rlike(CONTENTS_WORD) & (F.regexp_count(c, F.lit(NUMBER)) >= 8)
    return heading | dotted | named


def is_index(c: Column) -> Column:
    """A back-of-book index by its heading, its entries, lone capitalised words, or the density of numbers."""
    n = F.greatest(text.word_count(c), F.lit(1))
    entries = F.regexp_count(c, F.lit(INDEX_ENTRY))
    lone = F.regexp_count(c, F.lit(LONE_WORD))
    dense = (F.regexp_count(c, F.lit(SHORT_NUMBER)) / n > 0.25) & (n > 100)
    return c.rlike(INDEX_HEADING) | (lone >= 8) | (entries >= 5) | dense


def noise_reasons(c: Column, in_zone: Column) -> Column:
    """Why a chunk near the book's front is no content; empty elsewhere."""
    some = F.array_compact(F.array(F.when(is_front_matter(c), "frontmatter"), F.when(is_contents(c), "toc_like"), F.when(is_index(c), "index_like")))
    return F.when(in_zone, some).otherwise(F.array().cast("array<string>"))


def split_noise(df: DataFrame, first_page: int, *, zone: int = 4) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with drop_reasons); only chunks that begin in the first pages are judged."""
    marked = df.withColumn("drop_reasons", noise_reasons(F.coalesce(F.col("text"), F.lit("")), F.col("page_start") <= first_page + zone))
    return marked.where(F.size("drop_reasons") == 0).drop("drop_reasons"), marked.where(F.size("drop_reasons") > 0)


def reconcile(stages: dict[str, DataFrame], by: str = "book_id") -> DataFrame:
    """by and the number of rows in each stage, 0 where a stage has none."""
    counts = [df.groupBy(by).agg(F.count("*").alias(name)) for name, df in stages.items()]
    return reduce(lambda a, b: a.join(b, by, "full"), counts).fillna(0)


def repeated_lines(lines: DataFrame, *, doc: str, line: str, least: int = 3) -> DataFrame:
    """shape, docs: lines whose form without numbers is in at least that many documents."""
    shape = text.digit_shape(F.col(line))
    return lines.select(doc, shape.alias("shape")).where("shape != ''").distinct().groupBy("shape").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
