"""The document pipeline: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreforge.llm import bpe_tree, decontam, near_copies, private_data, toxicity
from loreforge.llm.common import drop_scratch, scratch_mark, table, written

STAGES = [
    ("toxicity", toxicity.without_toxic),
    ("simhash_near_dedup", near_copies.without_near_copies),
    ("benchmark_decontamination", decontam.without_contaminated),
    ("private_data", private_data.without_private_data),
    ("byte_level_bpe", bpe_tree.encoded),
]
#: SQL expresses neither the trained models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again; what a stage wrote on its way is deleted behind it."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, since=mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
