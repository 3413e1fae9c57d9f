"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order.  The r-th of a source's n
rows gets the fractional rank (r + u) / n, with u in [0, 1) drawn from the source's
name, so that sources of few rows spread over the whole range instead of meeting in
its middle.  Sorted by fractional rank, every stretch of rows holds each source in
its share; cut into stretches, the shards match the mixture to within a few rows for
each source, and their row counts are at most one apart.

Neither a source nor the whole is ever ranked by one task: rows are ranked within
cells of their source's random order, and again within cells of the fractional
rank, and a prefix sum over the small tables of cell counts completes the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.llm.common import table, written

SHARDS, SEED = 8, "loreforge"
#: Rows of a cell, about; the cells' counts are summed up by one task, so beyond MANY_CELLS of them they hold more, up to WIDE_CELL_ROWS.
CELL_ROWS, MANY_CELLS, WIDE_CELL_ROWS = 2_000, 1 << 16, 500_000
_BITS = 52


def _random(*parts: Column) -> Column:
    """52 seeded random bits of the parts, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 13), 16, 10).cast("bigint")


def _offsets(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """How many rows come before each cell."""
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def interleave(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, shards: int = SHARDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row.

    ``size`` is the text's UTF-8 bytes plus 1, 1 for a null text.  Rows with a null
    source are a source of their own.  Rows that agree in key and text are
    interchangeable; rows with equal keys and other texts are told apart by the
    text's checksum.  A null key is as good as any other.  An empty table gives no
    rows; of fewer rows than shards, each is in a shard of its own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    order = _random(F.lit("row"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    total = df.count()
    cells = max(1, min(total // cell_rows, max(MANY_CELLS, total // WIDE_CELL_ROWS)))
    cell_of = F.expr(f"cast(floor(o / {float(1 << _BITS)!r}D * {cells}) as bigint)")

    rows = df.select(F.col(key).alias("key"), name.alias("src"), order.alias("o"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc")).withColumn("c", cell_of)
    counts = df.select(name.alias("src"), order.alias("o")).withColumn("c", cell_of).groupBy("src", "c").agg(F.count("*").alias("n"))
    cuts = _offsets(counts, ["src"], "c").withColumn("total", F.sum("n").over(Window.partitionBy("src"))).select("src", "c", "before", "total")
    local = F.row_number().over(Window.partitionBy("src", "c").orderBy("o", "key", "crc", "size")) - 1
    ranked = rows.withColumn("r", local).join(cuts, ["src", "c"]).withColumn("r", F.col("r") + F.col("before")).drop("before", "c")

    start = _random(F.lit("source"), F.col("src"))
    spread = ranked.withColumn("p", (F.col("r") + start / F.lit(float(1 << _BITS))) / F.col("total"))
    spread = spread.withColumn("cell", F.least(F.floor(F.col("p") * cells), F.lit(cells - 1)))
    spread = written(spread, "spread")
    tally = _offsets(spread.groupBy("cell").agg(F.count("*").alias("n")), [], "cell").select("cell", "before")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("p", "o", "src", "key", "crc", "size")) - 1
    placed = spread.withColumn("place", place).join(tally, "cell").withColumn("place", F.col("place") + F.col("before"))
    shard = F.expr(f"(place * {shards}) div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}").alias("slot"))


def op7_stratified_shards(spark, sf_dir):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is ``rows``."""
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, coalesce(text, '') AS body,
         CAST('0x' || substr(md5('{SEED}:row:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS o
  FROM documents
), crcs AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM rows
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY o, doc_id, crc) - 1
             + CAST('0x' || substr(md5('{SEED}:source:' || src), 1, 13) AS BIGINT) / CAST({1 << _BITS} AS DOUBLE)) / count(*) OVER (PARTITION BY src) AS p
  FROM crcs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY p, o, src, doc_id, crc) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law,
       CAST((place * {SHARDS}) // total AS INTEGER) AS shard,
       CAST(place - (((place * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
