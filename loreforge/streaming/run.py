"""Runs a stream over what is there and gives the newest row of each key."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.operators import upserts
from loreforge.storage import shared_dir


def source(spark: SparkSession, folder: str, table: str, files_at_once: int = 1) -> DataFrame:
    """A table of a folder as a stream, with the schema that it has now."""
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    try:
        single = spark.read.format("binaryFile").option("pathGlobFilter", f"{table}.parquet").load(folder).select("path").limit(1).count() == 1
    except AnalysisException:  # no file of that name, but a folder of part files
        single = False
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.parquet(path)


def newest(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The last update of each key after all input is read.

    Each micro-batch's updates are written below the shared folder with the batch's
    number; a batch that is done again after a failure writes the same folder again.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/loreforge/stream-{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/updates/{n:06d}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/updates")
    return upserts.latest(rows, keys, "_batch").drop("_batch")
