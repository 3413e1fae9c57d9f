"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the
distance differ by at most one bit in one of them.  Each segment is indexed once
for every bit of it that is left out; two fingerprints within the distance then
share a variant, which an equality join finds and a count of bits verifies.

Texts of equal fingerprints are one row of that index.  A bucket of more than
``HOT`` fingerprints is not paired: at a distance of 2 its members are joined
through their one-flip neighbours instead (two fingerprints differ by at most two
bits exactly if a third is within one bit of both, and only 65 lie within one bit
of any), so no group is expanded into its pairs and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, slices, table, text_or_empty, written
from loreforge.llm.components import roots

HOT = 64
SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: str, words: int, seeds: tuple[int, ...] = (SEED,)) -> list[np.ndarray]:
    """XXH64 of the word shingles, repeats included, for each seed.

    A-Z are lower-cased and words are what stands between ASCII white space; a text
    of fewer words has one shingle, all of them; a text without words has none.
    """
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return [np.zeros(0, np.uint64) for _ in seeds]
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    spans = list(zip(starts[:n].tolist(), (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist(), strict=True))
    return [np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, n) for seed in seeds]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; 0 for no hashes."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), _CHUNK):
        part = hashes[low : low + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, keep: list[str], text: str = "text", *, words: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """The ``keep`` columns and one 64-bit lane f0, f1, ... for each seed.  A null text is an empty one: all lanes are zero."""
    n = len(keep)
    src = bounded_batches(df).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], text_or_empty(text).alias("body"))
    schema = ", ".join([f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)] + [f"f{i} bigint" for i in range(len(seeds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lanes = [[majority(h) for h in shingle_hashes(body, words, seeds)] for body in part.column("body").to_pylist()]
                made = [pa.array([x[i] for x in lanes], pa.int64()) for i in range(len(seeds))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[f"k{i}" for i in range(n)] + [f"f{i}" for i in range(len(seeds))])

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[f"f{i}" for i in range(len(seeds))])


@dataclass(frozen=True)
class Cut:
    """Segments (lane, first bit, bits) of fingerprints of ``lanes`` 64-bit lanes; no segment crosses lanes."""

    lanes: int
    max_bits: int
    segments: tuple[tuple[int, int, int], ...]

    @classmethod
    def for_distance(cls, max_bits: int) -> Cut:
        """The fewest segments of one lane of which one must differ by at most one bit."""
        n = max_bits // 2 + 1
        edges = [64 * i // n for i in range(n + 1)]
        return cls(1, max_bits, tuple((0, a, b - a) for a, b in zip(edges, edges[1:], strict=False)))

    def variants(self) -> list[tuple[int, int, int]]:
        """(lane, first bit, mask that leaves one bit of the segment out) of each variant."""
        return [(lane, first, ((1 << bits) - 1) & ~(1 << out)) for lane, first, bits in self.segments for out in range(bits)]


def _variant_rows(distinct: DataFrame, cut: Cut) -> DataFrame:
    """v (which variant), key (its value) and the lanes, a row for each variant of each fingerprint."""
    made = cut.variants()
    literal = lambda i, kind: "array(" + ",".join(f"{x[i]}{kind}" for x in made) + ")"
    lanes = [f"f{i}" for i in range(cut.lanes)]
    value = "f0" if cut.lanes == 1 else f"element_at(array({','.join(lanes)}), element_at({literal(0, '')}, v + 1) + 1)"
    rows = distinct.select(*lanes, F.explode(F.expr(f"sequence(0, {len(made) - 1})")).alias("v"))
    return rows.select("v", F.expr(f"shiftrightunsigned({value}, element_at({literal(1, '')}, v + 1)) & element_at({literal(2, 'L')}, v + 1)").alias("key"), *lanes)


def _pairs(rows: np.ndarray, first: np.ndarray, cut: Cut) -> np.ndarray:
    """Verified pairs of rows of one bucket; first: where each row's bucket starts.  A pair that shares several variants is returned for the first of them only."""
    found = []
    lanes, v = rows[:, 2:], rows[:, 0]
    for step in range(1, len(rows)):
        same = first[step:] == first[:-step]
        if not same.any():
            break
        i = np.flatnonzero(same)
        diff = lanes[i] ^ lanes[i + step]
        near = np.bitwise_count(diff.view(np.uint64)).sum(axis=1) <= cut.max_bits
        i, diff = i[near], diff[near].view(np.uint64)
        if not len(i):
            continue
        least = np.full(len(i), -1, np.int64)
        at = 0
        for lane, start, bits in cut.segments:
            d = (diff[:, lane] >> np.uint64(start)) & np.uint64((1 << bits) - 1)
            ones = np.bitwise_count(d)
            bit = np.where(ones == 1, np.bitwise_count(d - (ones > 0).astype(np.uint64)), 0)
            least = np.where((least < 0) & (ones <= 1), at + bit, least)
            at += bits
        once = least == v[i]
        found.append(np.concatenate([lanes[i[once]], lanes[i[once] + step]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2 * lanes.shape[1]), np.int64)


def links(distinct: DataFrame, cut: Cut) -> DataFrame:
    """Links between distinct fingerprints as a..., b... lanes (a0, b0, ...); b null: a is in a bucket of over HOT members."""
    lanes = [f"f{i}" for i in range(cut.lanes)]
    # Each row becomes many: dealt to all tasks first, however few hold the fingerprints.
    tasks = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _variant_rows(distinct.repartition(tasks, *lanes), cut)
    rows = rows.repartition("v", "key").sortWithinPartitions("v", "key", *lanes)
    names = [f"a{i}" for i in range(cut.lanes)] + [f"b{i}" for i in range(cut.lanes)]

    def made(pairs: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = cut.lanes
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(2 * n)], names=names)
        if len(hot):
            hot = np.unique(hot, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(hot[:, i]) for i in range(n)] + [pa.nulls(len(hot), pa.int64())] * n, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, cut.lanes + 2), np.int64)
        hot_bucket = None  # of the batches before, still going on
        for batch in batches:
            new = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if hot_bucket is not None:
                same = (new[:, 0] == hot_bucket[0]) & (new[:, 1] == hot_bucket[1])
                yield from made(np.zeros((0, 2 * cut.lanes), np.int64), new[same][:, 2:])
                new = new[~same]
                if not len(new):
                    continue
                hot_bucket = None
            at = np.concatenate([held, new])
            change = np.flatnonzero((at[1:, :2] != at[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(at)]]))
            first = np.repeat(starts, sizes)
            hot = np.repeat(sizes > HOT, sizes)
            last = len(at) - sizes[-1]
            if sizes[-1] > HOT:
                hot_bucket, held, done = tuple(at[-1, :2].tolist()), at[:0], len(at)
            else:
                held, done = at[last:], last
            cold = ~hot[:done] & (np.repeat(sizes, sizes)[:done] > 1)
            yield from made(_pairs(at[:done][cold], first[:done][cold], cut), at[:done][hot[:done]][:, 2:])
        if len(held):
            yield from made(_pairs(held, np.zeros(len(held), np.int64), cut), held[:0, 2:])

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _one_flip_links(hot: DataFrame) -> DataFrame:
    """All links within two bits among one-lane fingerprints f0, as stars: those within one bit of a common third are linked to the least of them."""
    from pyspark.sql import Window

    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    near = hot.select("f0", F.explode(flips).alias("flip")).select("f0", F.col("f0").bitwiseXOR(F.col("flip")).alias("centre"))
    star = near.withColumn("least", F.min("f0").over(Window.partitionBy("centre")))
    return star.where("f0 != least").select(F.col("f0").alias("a"), F.col("least").alias("b")).distinct()


def components(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, max_bits: int = 2) -> DataFrame:
    """Near-duplicate classes of a table's rows: key, f0 (fingerprint, signed), component (smallest key of the class).

    Fingerprints within ``max_bits`` (2, or 1 or 0) are linked; a class is what
    links reach.  Null and empty texts have fingerprint zero and are linked like
    others.  Repeated rows each get their row.  Null keys get a class too but don't
    name it unless all of its keys are null.  No rows: no rows.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("crowded buckets are resolved exactly for distances up to 2")
    rows = written(fingerprints(df, [key], text, words=words).withColumnRenamed(key, "key"), "fingerprints")
    distinct = rows.groupBy("f0").agg(F.min("key").alias("least_key"))
    found = written(links(distinct.select("f0"), Cut.for_distance(max_bits)), "links")
    edges = found.where("b0 is not null").select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    hot = found.where("b0 is null").select(F.col("a0").alias("f0")).distinct()
    edges = edges.unionAll(_one_flip_links(hot).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    root = roots(edges)
    classes = distinct.join(root, distinct.f0 == root.node, "left").select("f0", "least_key", F.coalesce("root", "f0").alias("root"))
    named = classes.groupBy("root").agg(F.min("least_key").alias("component"))
    return rows.join(classes.join(named, "root").select("f0", "component"), "f0").select(F.col("key").alias(key), "f0", "component")


def op6_simhash_variants(spark, sf_dir):
    """doc_id, fingerprint, component_id of every document: three-word shingles, links at two bits or fewer."""
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
