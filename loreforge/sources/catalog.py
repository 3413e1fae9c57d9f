"""The tables of the application: schemas, constraints, registration, introspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column lists, as DDL.
TABLES = {
    "chunks": "id long, chunk_id string, book_id string, book_title string, breadcrumb string, chapter string, chapter_title string, section string, section_title string, subsection string, subsection_title string, page_start int, page_end int, word_count int, contains_code boolean, contains_equation boolean, contains_figure boolean, contains_table boolean, image_paths array<string>, text string, embedding array<float>",
    "students": "id long, username string, name string, institution string, semester string, preferred_model string, created_at timestamp",
    "topic_mastery": "student_id long, topic_id string, topic_name string, mastery_score double, attempts_count int, last_evaluated timestamp",
    "quiz_attempts": "id long, student_id long, question_id string, topic_id string, question_text string, selected_answer string, correct_answer string, is_correct boolean, attempted_at timestamp",
    "pyq_questions": "question_id string, topic_id string, question_text string, marks int, year int, difficulty string, correct_answer string, explanation string",
    "extracted_images": "image_id string, book_id string, page_number int, caption string, image_type string, file_path string, width int, height int, created_at timestamp",
    "question_bank": "id long, topic_id string, chunk_id string, qtype string, question string, options array<string>, answer string, explanation string, difficulty double, marks int, source string, verified boolean, created_at timestamp",
    "flashcards": "id long, topic_id string, chunk_id string, front string, back string",
    "student_cards": "student_id string, card_id long, ease double, interval_days int, reps int, due_date date",
    "mock_exams": "id long, student_id string, blueprint string, started_at timestamp, duration_min int, submitted_at timestamp, score double, book_id string, exam_type string, total_questions int, time_spent_sec int",
    "mock_exam_items": "exam_id long, question_id long, position int, answer_given string, marks_awarded double",
    "adaptive_mastery": "student_id string, book_id string, chapter string, theta double, attempts int, correct int, updated_at timestamp",
    "adaptive_sessions": "id long, student_id string, book_id string, chapter string, max_questions int, theta double, started_at timestamp, finished_at timestamp, current_question_id long",
    "adaptive_answers": "seq long, session_id long, question_id long, position int, answer_given string, correct int, theta_before double, theta_after double, time_ms int, mastery_before double",
    "syllabus_exam_map": "book_id string, chapter string, exam_slot string, position int, updated_at timestamp",
    "chapter_prereqs": "book_id string, chapter string, prereq_chapter string",
}
KEYS = {
    "chunks": ["chunk_id"], "students": ["username"], "topic_mastery": ["student_id", "topic_id"], "pyq_questions": ["question_id"], "extracted_images": ["image_id"], "question_bank": ["id"], "flashcards": ["id"], "student_cards": ["student_id", "card_id"],
    "mock_exams": ["id"], "adaptive_mastery": ["student_id", "book_id", "chapter"], "adaptive_sessions": ["id"], "adaptive_answers": ["session_id", "question_id"], "syllabus_exam_map": ["book_id", "chapter"],
}
CHECKS = {"topic_mastery": "mastery_score between 0 and 1", "syllabus_exam_map": "exam_slot in ('T1', 'T2', 'T3')"}
PARENTS = {"topic_mastery": ("student_id", "students", "id"), "quiz_attempts": ("student_id", "students", "id"), "mock_exam_items": ("exam_id", "mock_exams", "id"), "adaptive_answers": ("session_id", "adaptive_sessions", "id")}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table, with columns that older files lack as null."""
    return conform(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), spark, name)


def conform(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    want = empty(spark, name).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, n: how often keys, checks and parents are violated; rules that hold have 0."""
    out = []
    for name, df in tables.items():
        if name in KEYS:
            out.append(df.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit(name).alias("table"), F.lit("unique").alias("rule"), "n"))
        if name in CHECKS:
            out.append(df.agg(F.count_if(~F.expr(CHECKS[name])).alias("n")).select(F.lit(name).alias("table"), F.lit("check").alias("rule"), "n"))
        if name in PARENTS and PARENTS[name][1] in tables:
            own, parent, key = PARENTS[name]
            lost = df.where(F.col(own).isNotNull()).join(tables[parent].select(F.col(key).alias(own)), own, "left_anti")
            out.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("parent").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, out)


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """table, columns, rows."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), F.lit(", ".join(df.columns)).alias("columns"), "rows") for n, df in tables.items()])


def checked_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """The table; a vector of another length is an error when it is read."""
    return df.withColumn(vector, F.when(F.assert_true(F.size(vector) == dim, F.lit(f"a vector must have {dim} components")).isNull(), F.col(vector)))


def jdbc_options(env: dict[str, str]) -> dict[str, str]:
    """Connection options of a relational database from named settings (HOST, PORT, NAME, USER, PASSWORD)."""
    return {"url": f"jdbc:postgresql://{env['HOST']}:{env.get('PORT', '5432')}/{env['NAME']}", "user": env["USER"], "password": env["PASSWORD"], "driver": "org.postgresql.Driver"}


def export(df: DataFrame, table: str, options: dict[str, str], partitions: int = 8) -> None:
    """Appends the table over JDBC; upserts are resolved before, by ``operators.upserts``."""
    df.coalesce(partitions).write.format("jdbc").options(**options, dbtable=table, batchsize="1000").mode("append").save()
