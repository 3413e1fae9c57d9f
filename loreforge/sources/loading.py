"""Loading cleaned chunks: images by page, search texts, vectors from a model; exporting tables with their conflict rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreforge.functions import text
from loreforge.operators import upserts
from loreforge.sources import images

#: The books' names and subjects.
BOOKS = {
    "DS": ("Handbook of Data Structures and Applications", "Advanced Data Structures"),
    "C": ("Let Us C", "C Programming & Systems"),
    "CPP": ("C++: The Complete Reference", "Object-Oriented Software Design (C++)"),
    "CLRS": ("Introduction to Algorithms (CLRS)", "Design & Analysis of Algorithms"),
}
#: What an export does with rows whose key is there: the columns that change, or none of them.
CONFLICTS = {
    "students": (["username"], ["name"]),
    "topic_mastery": (["student_id", "topic_id"], ["mastery_score"]),
    "chunks": (["chunk_id"], ["breadcrumb", "text", "image_paths", "embedding"]),
    "extracted_images": (["image_id"], []),
    "quiz_attempts": (["id"], []),
}


def books(spark: SparkSession) -> DataFrame:
    """book_id, book_title, subject: a row for each book."""
    return spark.createDataFrame([(k, *v) for k, v in BOOKS.items()], "book_id string, book_title string, subject string")


def embed(df: DataFrame, column: str, model: Callable[[], Callable[[list[str]], np.ndarray]], *, out: str = "embedding", batch: int = 32) -> DataFrame:
    """Adds unit vectors.  ``model`` is called once for each task and gives a function from texts to a matrix; a null text has no vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            rows: list[list[float] | None] = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for low in range(0, len(known), batch):
                some = known[low : low + batch]
                m = np.asarray(encode([texts.iloc[i] for i in some]), dtype=np.float32)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for i, v in zip(some, m, strict=True):
                    rows[i] = v.tolist()
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(column)))


def load(chunks: DataFrame, pictures: DataFrame, model, *, most: int | None = None) -> DataFrame:
    """Chunks with images, breadcrumb and search text (those given win) and vectors; the last of several with one id; at most ``most`` of each book."""
    latest = upserts.latest(chunks.withColumn("_at", F.monotonically_increasing_id()), ["chunk_id"], "_at").drop("_at")
    if most is not None:
        at = F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_id"))
        latest = latest.withColumn("_n", at).where(F.col("_n") <= most).drop("_n")
    pictured = images.attach(latest.drop("contains_figure"), pictures).withColumnRenamed("images", "image_paths")
    crumb = F.coalesce(text.blank_to_null(F.col("breadcrumb")), F.col("book_title"), F.col("book_id"))
    full = pictured.withColumn("breadcrumb", crumb)
    whole = F.concat(F.lit("["), F.col("breadcrumb"), F.lit("]\n\n"), F.coalesce("text", F.lit("")))
    given = text.blank_to_null(F.col("search_text")) if "search_text" in full.columns else F.lit(None).cast("string")
    return embed(full.withColumn("search_text", F.coalesce(given, whole)), "search_text", model)


def exported(target: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The next state of an exported table under its conflict rule."""
    keys, columns = CONFLICTS[name]
    if not columns:
        return upserts.ignore(target, new, keys)
    return upserts.merge(target, new, keys, {c: None for c in columns if c in new.columns})
