"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: This process's folder below the shared one, and the tables in it that are still there.
_OWN = f"run-{uuid.uuid4().hex}"
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine, a folder of our own
    is made and set for the session; on a cluster each executor would see another.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loreforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this process's folder, which goes when Spark's JVM ends."""
    own = f"{shared_dir(spark)}/loreforge/{_OWN}"
    if not any(t.startswith(own) for t in _TABLES):
        files, at = _file_system(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
    _TABLES.append(f"{own}/{label}-{uuid.uuid4().hex}")
    return _TABLES[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """For ``drop_scratch``: what is written so far."""
    return len(_TABLES)


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since a mark, but for the last ``keep``; no result that still reads them may be in use."""
    end = len(_TABLES) - keep
    for path in _TABLES[since:end]:
        files, at = _file_system(spark, path)
        files.delete(at, True)
    del _TABLES[since:end]
