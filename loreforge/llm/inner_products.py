"""Exact top-k inner products: vectors by descending length, pruned by Cauchy-Schwarz bounds on rotated partial sums.

All vectors are rotated into the axes of their Gram matrix (the right singular
vectors of the whole table), which gathers most of a product in the first
coordinates.  Candidates are written once to the shared folder, sorted by descending
length into blocks.  Each task takes a block of queries through the candidate blocks
in that order: once a query's k-th best score exceeds its length times the next
block's greatest, it is done; before that, a candidate is only multiplied out if the
sum over the first coordinates plus the product of both remainders' lengths reaches
the k-th best.  What is multiplied out is multiplied exactly, in integers.

A query block meets all candidate blocks, so the work is the product of both tables'
sizes less what is pruned, in blocks of bounded memory; no pair of rows is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import scratch_path, table

TOP, EVERY, SCALE = 20, 20, 64
BLOCK, QUERY_BLOCK, HEAD = 4096, 512, 24
#: Part of pairs within the bound above which a block is multiplied out as a whole.
DENSE = 0.05


def whole_numbers(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id, v (array<double> of floor(scale * x)) of the rows whose vector and key are neither null nor have null or non-finite components."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), x.alias("x")).where("id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: the right singular vectors of the whole table, by descending singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), dim)
                total += m.T @ m
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "g"])

    rows = vectors.select("v").mapInArrow(gram, "at bigint, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()  # dim * dim of them
    g = np.zeros(dim * dim)
    for r in rows:
        g[r["at"]] = r.g
    g = g.reshape(dim, dim)
    _, axes = np.linalg.eigh((g + g.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def write_candidates(vectors: DataFrame, dim: int, axes: np.ndarray, folder: str) -> list[str]:
    """Blocks of candidates by descending length, one Arrow file for each task; the files' paths in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        schema = pa.schema([("ids", pa.binary()), ("whole", pa.binary()), ("head", pa.binary()), ("rest", pa.binary()), ("length", pa.float64())])
        out = sink = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            nonlocal out, sink
            ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            if out is None:
                where, at = fs.FileSystem.from_uri(path)
                where.create_dir(at.rpartition("/")[0], recursive=True)
                sink = where.open_output_stream(at)
                out = pa.ipc.new_file(sink, schema)
            for low in range(0, len(ids), BLOCK):
                i, w = ids[low : low + BLOCK], v[low : low + BLOCK]
                turned = w @ axes
                rest = np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
                length = float(np.sqrt((w**2).sum(axis=1)).max())
                out.write_batch(pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((i.tobytes(), pa.binary()), (w.tobytes(), pa.binary()), (turned[:, :HEAD].tobytes(), pa.binary()), (rest.tobytes(), pa.binary()), (length, pa.float64()))], schema=schema))

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim).copy()))
                n += batch.num_rows
                if n >= BLOCK:
                    flush()
                    n = 0
        if held:
            flush()
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path]})

    ordered = vectors.withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    ordered = ordered.repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id").select("id", "v")
    found = ordered.mapInArrow(run, "part bigint, path string").collect()  # one for each task
    return [r.path for r in sorted(found, key=lambda r: r.part)]


class Best:
    """The k best (score, id) of each of several queries; smaller ids first among equal scores."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The k-th best score of each query so far; minus infinity while there are fewer."""
        return self.score[:, -1]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id) in any order."""
        better = (score > self.score[q, -1]) | ((score == self.score[q, -1]) & (ids < self.id[q, -1]))
        q, score, ids = q[better], score[better], ids[better]
        if not len(q):
            return
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        few = rank < self.k
        q, score, ids, rank = q[few], score[few], ids[few], rank[few]
        rows = np.unique(q)
        at = np.searchsorted(rows, q)
        s = np.full((len(rows), 2 * self.k), -np.inf)
        i = np.full((len(rows), 2 * self.k), np.iinfo(np.int64).max)
        s[:, : self.k], i[:, : self.k] = self.score[rows], self.id[rows]
        s[at, self.k + rank], i[at, self.k + rank] = score, ids
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def search_block(ids: np.ndarray, v: np.ndarray, axes: np.ndarray, blocks: Iterator[dict], k: int) -> Best:
    """Candidate blocks come by descending length; a query's own row (same id, same vector place) is left out by id."""
    best = Best(len(ids), k)
    turned = v @ axes
    head, rest = turned[:, :HEAD], np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
    length = np.sqrt((v**2).sum(axis=1))
    for block in blocks:
        slack = 1e-9 * (1 + length * block["length"])  # of the bounds' rounding
        open_ = np.flatnonzero(length * block["length"] + slack >= best.least())
        if not len(open_):
            break  # longer candidates are all behind
        cid, cv = block["ids"], block["whole"]
        bound = head[open_] @ block["head"].T + np.outer(rest[open_], block["rest"])
        bound += slack[open_, None]
        may = bound >= best.least()[open_, None]
        if may.mean() > DENSE:
            score = v[open_] @ cv.T
            q, c = np.nonzero(may & (score >= best.least()[open_, None]))
            score = score[q, c]
        else:
            q, c = np.nonzero(may)
            score = np.einsum("ij,ij->i", v[open_[q]], cv[c])
        other = ids[open_[q]] != cid[c]
        best.add(open_[q[other]], score[other], cid[c[other]])
    return best


def top_products(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, k: int = TOP, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by ``every``, the ``k`` rows of other keys with the highest integer inner products.

    Fewer where there are fewer.  Ties go to the smaller key; rows that share a key
    and differ are each a query and each a candidate, but none to its own key.
    Vectors that are null or hold null or non-finite components, empty vectors and
    null keys take no part.  Vectors of different lengths have no inner product; each
    length is a search of its own.  Scores are exact: a table with a vector whose
    product with itself reaches 2**53 is refused with ValueError (floor(64 * x) stays
    below that for |x| up to a million at 64 dimensions).
    """
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark = df.sparkSession
    vectors = whole_numbers(df, key, vector, scale)
    own = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.max(own).alias("most")).where("d > 0").orderBy("d").collect()  # one for each length
    if any(r.most >= 2.0**53 for r in sizes):
        raise ValueError("vectors so long that their products are not exact in 53 bits; use a smaller scale")
    out = spark.createDataFrame([], schema)
    for r in sizes:
        out = out.unionAll(_top_products(vectors.where(F.size("v") == r.d), r.d, k, every, schema))
    return out


def _top_products(vectors: DataFrame, dim: int, k: int, every: int, schema: str) -> DataFrame:
    """``top_products`` among whole vectors (id, v) of one length."""
    spark = vectors.sparkSession
    axes = rotation(vectors, dim)
    paths = write_candidates(vectors, dim, axes, scratch_path(spark, "vectors"))
    queries = vectors.where(F.pmod("id", F.lit(every)) == 0)
    n = queries.count()
    queries = queries.repartition(max(1, math.ceil(n / QUERY_BLOCK)))

    def blocks() -> Iterator[dict]:
        from pyarrow import fs

        for path in paths:
            where, at = fs.FileSystem.from_uri(path)
            with where.open_input_file(at) as source:
                reader = pa.ipc.open_file(source)
                for b in range(reader.num_record_batches):
                    r = reader.get_batch(b)
                    get = lambda c, t: np.frombuffer(r.column(c)[0].as_buffer(), t)  # noqa: E731, B023
                    yield {"ids": get(0, np.int64), "whole": get(1, np.float64).reshape(-1, dim), "head": get(2, np.float64).reshape(-1, min(HEAD, dim)), "rest": get(3, np.float64), "length": r.column(4)[0].as_py()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                ids, v = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                best = search_block(ids, v, axes, blocks(), k)
                q, rank = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rank + 1, pa.int32()), pa.array(best.id[q, rank]), pa.array(best.score[q, rank].astype(np.int64))], names=["query_id", "rank", "vec_id", "score"])

    return queries.select("id", "v").mapInArrow(run, schema)


def op4_norm_sorted_products(spark, sf_dir):
    """query_id, rank, vec_id, score of every query."""
    return top_products(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id != c.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
