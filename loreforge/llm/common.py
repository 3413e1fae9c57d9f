"""Helpers shared by the training-data operators: table reads, Arrow plumbing, and tables in the shared folder (see ``loreforge.storage``)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.storage import drop_scratch, scratch_mark, scratch_path, shared_dir, written

__all__ = ["arrow_map", "bounded_batches", "drop_scratch", "fresh", "scratch_mark", "scratch_path", "shared_dir", "slices", "table", "text_or_empty", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names based on ``wanted`` that no column of ``columns`` has (compared without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over one batch at a time; ``rows`` yields any number of batches for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, so that what a worker makes of them at once stays bounded."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bounded_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """Long texts make the usual 10,000 rows of an Arrow batch too many; a smaller setting of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
