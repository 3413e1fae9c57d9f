"""The register of queries, and the tables in the roles that the operators know."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; ``sql`` is what DuckDB must return."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_roles(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Roles: the table that stands in, and the columns, in expressions that Spark and DuckDB read alike.
ROLES = {
    "chunks": ("part", ["p_partkey AS id", "concat('CH', cast(p_partkey AS string)) AS chunk_id", "p_brand AS book_id", "cast(p_size AS string) AS chapter", "p_type AS chapter_title", "p_partkey % 500 + 1 AS page_start", "p_partkey % 500 + 1 + p_partkey % 4 AS page_end", "p_name AS text"]),
    "questions": ("part", ["p_partkey AS question_id", "concat('CH', cast(p_partkey AS string)) AS chunk_id", "p_brand AS book_id", "cast(p_size AS string) AS chapter", "cast(p_partkey * 37 % 100 AS double) / 100 AS difficulty", "substring('ABCD', cast(p_partkey % 4 + 1 AS int), 1) AS answer", "p_partkey % 11 <> 0 AS verified", "CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE 'mcq' END AS qtype", "CASE WHEN p_size <= 17 THEN 'T1' WHEN p_size <= 33 THEN 'T2' WHEN p_size <= 45 THEN 'T3' END AS slot"]),
    "answers": ("events", ["event_id AS seq", "user_id AS student_id", "user_id * 1000 + event_id % 3 AS session_id", "event_id % 2000 AS question_id", "cast(event_id % 4 AS int) AS topic", "CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE 0 END AS correct", "cast(event_id * 53 % 100 AS double) / 100 AS difficulty", "cast(value * 100 AS int) AS time_ms", "cast(ts AS date) AS day"]),
    "prereqs": ("part", ["p_brand AS book_id", "cast(p_size AS string) AS chapter", "cast(cast(floor(p_size / 2) AS int) AS string) AS prereq_chapter"]),
    "cards": ("part", ["p_partkey AS card_id", "p_brand AS book_id", "p_name AS front"]),
    "reviews": ("events", ["event_id AS seq", "user_id AS student_id", "event_id % 40 AS card_id", "event_type <> 'error' AS known", "cast(ts AS date) AS day"]),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = ROLES[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def with_roles(sql: str) -> str:
    """Puts the roles that a query names, as ``{role}``, in front of it."""
    used = [n for n in ROLES if "{" + n + "}" in sql]
    for n in used:
        sql = sql.replace("{" + n + "}", f"r_{n}")
    if not used:
        return sql
    views = ", ".join(f"r_{n} AS (SELECT {', '.join(ROLES[n][1])} FROM {ROLES[n][0]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE'):].strip()}"
    return f"WITH {views}, {body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {views} {body}"
