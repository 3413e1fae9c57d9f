"""Near-duplicate documents at a Jaccard similarity, by SimHash with deletion-variant signatures.

At a similarity of 0.8 fingerprints differ in about a seventh of their bits, so one
of 64 bits has no segment that is surely near.  Six fingerprints of 64 bits are
taken instead and cut into segments of 21 or 22 bits, each indexed once for every
bit of it that is left out.  Two texts of similarity s share a variant with a
probability of 0.94 at s = 0.8, 0.99 at 0.85 and 1.00 at 0.9 (a segment of b bits of
which each flips with p = acos(2s / (1 + s)) / pi has at most one flip with
probability (1 - p)**b + b * p * (1 - p)**(b - 1)).  Two further fingerprints, in none
of the segments, travel with the variants and sort out chance meetings where they
happen.  What is left is verified on the texts' shingles.

A text is named by a hash of its set of shingles.  Texts of equal sets are one row of
the index, so copies aren't expanded; equal fingerprints are verified like others.  The
near pairs of a bucket would grow with the square of its rows, so each row is linked to
the least row that chains of near pairs reach, which joins what all pairs join; a bucket
is read whole, whatever Arrow batches it comes in.  What these links reach is a group, and
within a group every text is verified on shingle sets.  Groups of up to ``CHUNK`` rows are compared at once.  Of larger ones

1. a text leaves that shares too few of its shingles with any other of its group;
2. a leader, the one with the largest share of shingles that others have too, is sent to
   all rows of its group; rows that are linked to it are settled, the rest elect the next
   leader, for ``ROUNDS`` rounds;
3. settled rows meet the other leaders of their group too, and what may link the rows of
   two leaders that no row has joined is compared in pairs of blocks;
4. what no leader has settled is compared with all that is left of its group, in pairs of
   blocks that go to different tasks.

No true link is missed by that.  Copies edited here and there end in the first two steps and
in the meeting with other leaders, whose rows grow with the group; only texts that share most
shingles with others and are linked to no leader, or lie between leaders that aren't joined,
cost more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, fresh, slices, text_or_empty, written
from loreforge.llm.components import roots
from loreforge.llm.simhash import majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
LANES, SEGMENTS = 6, ((0, 21), (21, 21), (42, 22))
#: Of the 128 bits of the two further fingerprints those by which a candidate pair may differ: the mean at the least similarity and over two deviations.
NAME_BITS = 29
HOT = 16
#: Rows and bytes of sets of a block of a group, about.
CHUNK, CHUNK_BYTES = 100, 32_000_000
#: Leaders that a large group elects one after the other.
ROUNDS = 4
#: Bytes of leaders' sets that are broadcast; beyond, rows and leaders meet by a salted join.
LEADER_BYTES, SALTS = 16_000_000, 32
#: Shingles that are counted at once for two blocks, and in a task before they are sent.
TOKENS, HELD = 4096, 1 << 22
#: Rows below which a table of keys is broadcast.
FEW_KEYS = 500_000
_VARIANTS = [(lane, first, ((1 << bits) - 1) & ~(1 << out)) for lane in range(LANES) for first, bits in SEGMENTS for out in range(bits)]


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of another fingerprint, from those of the shingles (the finaliser of splitmix64)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _set_name(hashes: np.ndarray) -> int:
    """The name of a text: a hash of its sorted distinct shingle hashes, as a signed 64-bit integer."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_lanes(text: str, words: int = WORDS) -> list[int]:
    """The name of a text, the two fingerprints that travel with it, then those that are indexed."""
    hashes = np.unique(shingle_hashes(text, words)[0])  # links are defined on sets
    return [_set_name(hashes), majority(hashes), majority(_mixed(hashes, LANES)), *(majority(_mixed(hashes, i)) for i in range(LANES))]


def _lanes(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, th (the text's hash), f (name), g, h and l0, l1, ... of every row."""
    src = bounded_batches(df).select(F.col(key).alias("key"), text_or_empty(text).alias("body")).withColumn("th", F.xxhash64("body"))
    names = ["f", "g", "h", *[f"l{i}" for i in range(LANES)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [text_lanes(body, words) for body in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("th"), *[pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]], names=["key", "th", *names])

    return src.select("key", "th", "body").mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, th bigint, " + ", ".join(f"{n} bigint" for n in names))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many bits rows of two fingerprints differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.uint8)


def forest(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (ends a, b, as indices) that join what pairs within ``bits`` would join: of each row to the first one that chains of such pairs reach."""
    left, a, b = np.arange(len(names)), [], []
    while len(left):
        start, left = left[0], left[1:]
        todo = [start]
        while todo and len(left):
            near = apart(names[left], names[todo.pop()]) <= bits
            if near.any():
                hit = left[near].tolist()
                a += [start] * len(hit)
                b += hit
                todo += hit
                left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n rows the least one that links a, b reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _near_in_buckets(slot: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of each of many small buckets of rows (a name and fingerprints); equal slots are next to each other."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(HOT, len(slot))):
        same = np.flatnonzero(slot[step:] == slot[:-step])
        if not len(same):
            break
        near = same[apart(names[same, 1:], names[same + step, 1:]) <= NAME_BITS]
        a.append(near)
        b.append(near + step)
    least = least_reached(len(slot), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(least != np.arange(len(slot)))
    return names[least[linked]], names[linked]


def candidate_links(lanes: DataFrame) -> DataFrame:
    """a, b: names of texts that share a variant and are near by g and h; ``lanes`` has one row for each name."""
    literal = lambda i, kind: "array(" + ",".join(f"{x[i]}{kind}" for x in _VARIANTS) + ")"
    every = F.explode(F.expr(f"sequence(0, {len(_VARIANTS) - 1})"))
    rows = lanes.select("f", "g", "h", F.array(*[f"l{i}" for i in range(LANES)]).alias("l"), every.alias("v"))
    value = f"shiftrightunsigned(l[{literal(0, '')}[v]], {literal(1, '')}[v]) & {literal(2, 'L')}[v]"
    rows = rows.select(F.expr(f"cast(v * {1 << 22}L + ({value}) - {1 << 31}L as int)").alias("slot"), "f", "g", "h")
    rows = rows.repartition("slot").sortWithinPartitions("slot", "f")

    def links(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            pairs = np.unique(np.column_stack([a[:, 0], b[:, 0]]).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def resolved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets."""
        if not sum(b.num_rows for b in held):
            return
        slot = np.concatenate([b.column(0).to_numpy() for b in held])
        names = np.concatenate([np.column_stack([b.column(i).to_numpy() for i in (1, 2, 3)]).view(np.uint64) for b in held])
        starts = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(slot)))
        few = np.repeat(sizes <= HOT, sizes)
        yield from links(*_near_in_buckets(slot[few], names[few]))
        for i in np.flatnonzero(sizes > HOT):
            bucket = names[starts[i] : starts[i] + sizes[i]]
            a, b = forest(bucket[:, 1:], NAME_BITS)
            yield from links(bucket[a], bucket[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the bucket that goes on
        for batch in batches:
            slot = batch.column(0).to_numpy()
            if not len(slot):
                continue
            if slot[0] != last or slot[-1] != last:
                cut = int(np.searchsorted(slot, slot[-1]))
                yield from resolved([*held, batch.slice(0, cut)])
                held, last, batch = [], slot[-1], batch.slice(cut)
            held.append(batch)
        yield from resolved(held)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _shingle_sets(df: DataFrame, key: str, text: str, words: int, keys: DataFrame) -> DataFrame:
    """f, hs (sorted distinct shingle hashes as bytes) of the texts whose key is in ``keys``, once for each f."""
    src = df.select(F.col(key).alias("key"), text_or_empty(text).alias("body"))
    src = bounded_batches(_with(src, keys, "key", "left_semi").select("body"), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                hashes = [np.unique(shingle_hashes(body, words)[0]) for body in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_set_name(h) for h in hashes], pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary())], names=["f", "hs"])

    return src.mapInArrow(run, "f bigint, hs binary").groupBy("f").agg(F.min("hs").alias("hs"))


def _with(df: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join with a table of keys that is broadcast only if it has few rows; it must be cheap to count."""
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), on, how)


def in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x has in common with each set of y; the sets have no repeats."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        at = np.searchsorted(shared, values)
        hit = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == values)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return at[hit], row[hit]

    out = np.zeros((len(x), len(y)), np.float32)  # counts are exact
    if not len(shared):
        return out
    sides = [(placed(sets), len(sets)) for sets in (x, y)]
    for low in range(0, len(shared), TOKENS):
        has = []
        for (at, row), n in sides:
            a, b = np.searchsorted(at, [low, low + TOKENS])
            has.append(np.zeros((n, min(TOKENS, len(shared) - low)), np.float32))
            has[-1][row[a:b], at[a:b] - low] = 1
        out += has[0] @ has[1].T
    return out


def true_links(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (ends, as indices into x followed by y) that join what all pairs of a set of x and one of y with this Jaccard similarity join."""
    common = in_common(x, y).astype(np.float64)
    m = len(x)
    true = np.zeros((m + len(y),) * 2, bool)
    true[:m, m:] = common >= similarity * (np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y]) - common)
    true |= true.T
    left, a, b = np.arange(len(true)), [], []
    while len(left):  # a spanning forest: each row with the row that reached it
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = left[true[at, left]]
            a += [at] * len(hit)
            b += hit.tolist()
            todo += hit.tolist()
            left = left[~true[at, left]]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join what all pairs of a group (f, root) with at least this Jaccard similarity of their shingle sets join."""
    rows = written(groups.join(sets, "f").select("root", "f", F.expr("octet_length(hs) div 8").alias("size"), "hs"), "members")
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") * 8 / CHUNK_BYTES)).cast("int")
    large = written(rows.groupBy("root").agg(parts.alias("parts")).where("parts > 1").select("root"), "large")
    small = _compared(_with(rows, large, "root", "left_anti").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "f", "hs"), similarity)
    if large.isEmpty():
        return small
    live = written(_sharing(_with(rows, large, "root", "left_semi"), similarity), "sharing")
    links, settled, heads = small, [], []
    for _ in range(ROUNDS):
        heads.append(_leaders(live))
        met = written(_by_leader(live, heads[-1], similarity), "led")
        links = links.unionAll(met.where("near and f != leader").select(F.col("f").alias("a"), F.col("leader").alias("b")))
        settled.append(met.where("near").drop("near"))
        live = met.where("not near").drop("leader", "near")
        if live.isEmpty():
            break
    if len(heads) > 1:
        links = links.unionAll(_between_leaders(reduce(DataFrame.unionAll, settled), reduce(DataFrame.unionAll, heads), similarity))
    if live.isEmpty():
        return links
    every = reduce(DataFrame.unionAll, [done.drop("leader") for done in settled], live)
    return links.unionAll(_compared(_in_blocks(live, every), similarity))


def _sharing(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows that may be linked to another of their group, with public: how many of their shingles another has too.

    Two sets of sizes m and n have a similarity s only if they share s / (1 + s) * (m + n), and s * m, of their elements.
    """

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        root, f, h = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((h, root))
        root, f, h = root[order], f[order], h[order]
        first = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (h[1:] != h[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(root[first]), pa.array(h[first]), pa.array(np.diff(np.r_[first, len(root)])), pa.array(f[first])], names=["root", "h", "n", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # shingles are counted here before they are sent
        for batch in batches:
            for part in slices(batch, 64):
                sets = [np.frombuffer(h, np.int64) for h in part.column("hs").to_pylist()]
                sizes = [len(x) for x in sets]
                if sum(sizes):
                    held.append((np.repeat(part.column("root").to_numpy(), sizes), np.repeat(part.column("f").to_numpy(), sizes), np.concatenate(sets)))
                    size += sum(sizes)
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    each = bounded_batches(rows.select("root", "f", "hs"), 256).mapInArrow(run, "root bigint, h bigint, n bigint, f bigint")
    alone = each.groupBy("root", "h").agg(F.sum("n").alias("n"), F.min("f").alias("f")).where("n = 1")
    private = written(alone.groupBy("root", "f").agg(F.count("*").alias("private")), "private")
    least = rows.groupBy("root").agg(F.min("size").alias("least"))
    known = _with(_with(rows, private, ["root", "f"], "left"), written(least, "least"), "root", "inner")
    known = known.withColumn("public", F.col("size") - F.coalesce("private", F.lit(0)))
    need = similarity / (1 + similarity) * (F.col("size") + F.greatest(F.col("least"), F.col("size") * similarity))
    return known.where(F.col("public") >= need - 1e-6).select("root", "f", "size", "public", "hs")


def _leaders(rows: DataFrame) -> DataFrame:
    """root, leader and lead (its shingle set) of every group."""
    first = rows.groupBy("root").agg(F.max_by("f", F.struct(F.try_divide("public", "size"), F.col("f"))).alias("f"))
    leaders = _with(rows, written(first, "first"), ["root", "f"], "left_semi").select("root", F.col("f").alias("leader"), F.col("hs").alias("lead"))
    return written(leaders, "leaders")


def _met(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Every row with each leader of its group."""
    if (leaders.agg(F.sum(F.octet_length("lead"))).first()[0] or 0) <= LEADER_BYTES:
        return rows.join(F.broadcast(leaders), "root")
    salted = leaders.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(f), {SALTS}) as int)")).join(salted, ["root", "salt"]).drop("salt")


def _overlaps(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Of each row's hs and lead the sizes of intersection and union."""
    for hs, lead in zip(batch.column("hs").to_pylist(), batch.column("lead").to_pylist(), strict=True):
        x, y = np.frombuffer(hs, np.uint64), np.frombuffer(lead, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        yield common, len(x) + len(y) - common


def _by_leader(rows: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """The rows with their group's leader and whether they are linked to it (a leader is to itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [common >= similarity * union for common, union in _overlaps(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "f", "size", "public", "hs", "leader")), pa.array(near, pa.bool_())], names=["root", "f", "size", "public", "hs", "leader", "near"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("root", "f", "size", "public", "hs"))
    met = _met(rows, leaders).select("root", "f", "size", "public", "hs", "leader", "lead")
    return bounded_batches(met, 256).mapInArrow(run, f"{kinds}, leader bigint, near boolean")


def _between_leaders(settled: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join what all links between rows that different leaders of a group have settled join.

    Jaccard distances keep the triangle inequality, so a row that is linked to one of
    another leader is within twice a link's distance of that leader.  If such a row is
    even linked to that leader, both leaders' rows are joined; else the rows within
    that distance on both sides are compared.
    """
    many = written(leaders.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "many")
    rows, leaders = (_with(df, many, "root", "left_semi") for df in (settled.withColumnRenamed("leader", "own"), leaders))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = list(_overlaps(batch))
            near = pa.array([common >= similarity * union for common, union in seen], pa.bool_())
            close = pa.array([common >= (2 * similarity - 1) * union - 1e-6 for common, union in seen], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "f", "own", "leader")), near], names=["root", "f", "own", "leader", "near"]).filter(close)

    met = _met(rows, written(leaders, "several")).where("own != leader").select("root", "f", "own", "leader", "hs", "lead")
    met = bounded_batches(met, 256).mapInArrow(meet, "root bigint, f bigint, own bigint, leader bigint, near boolean")
    close = written(met.withColumns({"p": F.least("own", "leader"), "q": F.greatest("own", "leader")}), "close")
    links = close.where("near").select(F.col("f").alias("a"), F.col("leader").alias("b"))
    pairs = close.groupBy("root", "p", "q").agg(F.max("near").alias("near"), F.expr("max(own = p) and max(own = q)").alias("both"))
    pairs = pairs.groupBy("root").agg(F.collect_list(F.struct("p", "q", "near", "both")).alias("pairs"))  # of ROUNDS leaders at most

    def not_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                label = {x[end]: x[end] for x in found for end in "pq"}
                for x in found:
                    if x["near"]:
                        old, new = label[x["p"]], label[x["q"]]
                        label = {leader: new if at == old else at for leader, at in label.items()}
                out += [(root, x["p"], x["q"]) for x in found if x["both"] and label[x["p"]] != label[x["q"]]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["root", "p", "q"])

    apart = written(pairs.mapInArrow(not_joined, "root bigint, p bigint, q bigint"), "apart")
    if apart.isEmpty():
        return links
    sides = written(_with(close.where("not near"), apart, ["root", "p", "q"], "inner").select("root", "f", "own", "p", "q"), "sides")
    sides = _with(rows.select("root", "f", "size", "hs"), sides, ["root", "f"], "inner").withColumn("root", F.xxhash64("root", "p", "q"))
    sides = written(sides.select("root", "f", "size", "hs", (F.col("own") == F.col("p")).alias("first")), "facing")
    return links.unionAll(_compared(_in_blocks(sides.where("first"), sides.where("not first")), similarity))


def _in_blocks(some: DataFrame, every: DataFrame) -> DataFrame:
    """root, i, j, side, f, hs: all pairs of a block i of some rows (side 0) and a block j of every row (side 1) of a group."""
    blocks = lambda df, name: df.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") * 8 / CHUNK_BYTES)).cast("int").alias(name))
    counts = written(blocks(some, "m").join(blocks(every, "n"), "root"), "blocks")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(f), {n}) as int)")
    all_of = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    x = _with(some, counts, "root", "inner").select("root", own("m").alias("i"), all_of("n").alias("j"), F.lit(0).alias("side"), "f", "hs")
    y = _with(every, counts, "root", "inner").select("root", all_of("m").alias("i"), own("n").alias("j"), F.lit(1).alias("side"), "f", "hs")
    return x.unionAll(y)


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join what the true links among the rows of each (root, i, j) join, between side 0 and side 1 if there is one."""
    rows = bounded_batches(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, a, b = None, [], [], []

        def compare() -> None:
            x, y = ([m for m in members if m[0] == side] for side in (0, 1))
            y = y or x
            if len(members) > 1 and x:
                names = [m[1] for m in [*x, *y]]
                for p, q in zip(*true_links([m[2] for m in x], [m[2] for m in y], similarity), strict=True):
                    a.append(names[p])
                    b.append(names[q])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, side, f, hs in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if key != now:
                    compare()
                    now, members = key, []
                members.append((side, f, np.frombuffer(hs, np.uint64)))
            yield out()
            a, b = [], []
        compare()
        yield out()

    return rows.mapInArrow(run, "a bigint, b bigint").where("a != b")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """key, th (the text's hash) and of its class: least (key), root and n (rows) of every row.

    A class is what links reach; links are pairs of texts with a Jaccard similarity of
    at least ``similarity`` on shingles of ``words`` words, and texts whose sets of
    shingles are equal (by a 64-bit hash).  Null and empty texts and others without words are one
    class.  Repeated rows are in one class.  Null keys name a class only if it has no
    other, and texts that have none but null keys are linked by equal sets only.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("the index is made for similarities from 0.5 to 1")
    rows = written(_lanes(df, key, text, words), "lanes")
    names = written(rows.groupBy("f").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.min("g").alias("g"), F.min("h").alias("h"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(LANES)]), "names")
    pairs = written(candidate_links(names), "candidates")
    reach = roots(pairs)
    groups = written(reach.select(F.col("node").alias("f"), "root").unionAll(reach.select(F.col("root").alias("f"), "root").distinct()), "groups")
    keys = written(groups.join(names, "f").where("least is not null").select(F.col("least").alias("key")).distinct(), "near")
    sets = written(_shingle_sets(df, key, text, words, keys), "sets")
    root = roots(verified(groups, sets, similarity))
    joined = names.join(root, names.f == root.node, "left").select("f", "least", "n", F.coalesce("root", "f").alias("root"))
    joined = written(joined, "roots")  # else the sums below would be taken behind the join's exchange, by root, without partial sums
    each = joined.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    of_name = joined.select("f", "root").join(each, "root")
    return rows.select("key", "th", "f").join(of_name, "f").select("key", "th", "least", "root", "n")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The table with one row of each class: of its least key, with the least text hash where several have it."""
    found = written(classes(df, key, text, words=words, similarity=similarity), "classes")
    many = found.where("n > 1")
    best = many.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("z"), F.col("key").alias("k"), "th")).alias("m"))
    state = _with(many, written(best, "best"), "root", "inner").withColumn("kept", (F.col("key").eqNullSafe(F.col("m.k"))) & (F.col("th") == F.col("m.th")))
    # By key and hash: whether such rows stay, and whether there are several of them.
    say = state.groupBy(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("kk"), F.col("key").isNull().alias("kn"), "th").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    say = written(say.where("not kept or copies > 1"), "leave")
    kk, kn, th, kept, copies = fresh(df.columns, "kk", "kn", "th", "kept", "copies")
    marked = df.withColumns({kk: F.coalesce(F.col(key).cast("string"), F.lit("")), kn: F.col(key).isNull(), th: F.xxhash64(text_or_empty(text))})
    marked = _with(marked, say.toDF(kk, kn, th, kept, copies), [kk, kn, th], "left")
    sure = marked.where(F.col(kept).isNull())
    one = marked.where(F.col(kept)).dropDuplicates([kk, kn, th])
    return sure.unionByName(one).select(*df.columns)


def without_near_copies(spark, docs, sf_dir):
    """One document of each class of near copies: five-word shingles, similarity 0.8."""
    return one_of_each(docs)


def share_found(s: float) -> float:
    """The probability that a pair of similarity s shares a variant."""
    p = math.acos(2 * s / (1 + s)) / math.pi
    miss = 1.0
    for _, bits in SEGMENTS * LANES:
        miss *= 1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)
    return 1 - miss
