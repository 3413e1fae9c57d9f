import random

import numpy as np
import xxhash

from loreforge.llm import simhash as S
from loreforge.llm.components import roots


def fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, fps, max_bits=2):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= max_bits):
            up[root(i)] = root(int(j))
    least = {}
    for i, k in enumerate(keys):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(keys))]


def test_query_against_brute_force(spark, documents, folder):
    more = ["one two three four five six seven", *[" ".join(random.Random(i // 3).choices("a b c d".split(), k=30)) + (" x" if i % 3 else "") for i in range(90)]]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string")
    df = documents.unionByName(extra, allowMissingColumns=True)
    got = {r.doc_id: r for r in S.op6_simhash_variants(spark, folder(documents=df)).collect()}
    rows = df.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    for r, fp, c in zip(rows, fps, classes([r.doc_id for r in rows], fps), strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{fp:016x}", c)


def test_crowded_buckets_lose_no_link(spark):
    """Hundreds of fingerprints around two centres, so that buckets pass HOT; links must be those of all pairs."""
    rng = random.Random(5)
    fps = set()
    for _ in range(400):
        x = rng.choice([0x0123456789ABCDEF, 0x0123456789ABCDEF ^ (0xF0F << 40)])
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "f0 bigint").repartition(3)
    found = S.links(distinct, S.Cut.for_distance(2)).collect()
    assert any(r.b0 is None for r in found)
    hot = spark.createDataFrame([(x,) for x in sorted({r.a0 for r in found if r.b0 is None})], "f0 bigint")
    edges = [(r.a0, r.b0) for r in found if r.b0 is not None] + [tuple(r) for r in S._one_flip_links(hot).collect()]
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert [got.get(x, x) for x in signed] == classes(signed, fps)


def test_every_link_once(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(30)]
    fps = sorted({x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in base for _ in range(4)})
    found = S.links(spark.createDataFrame([(x,) for x in fps], "f0 bigint"), S.Cut.for_distance(2)).collect()
    pairs = sorted(tuple(sorted((r.a0, r.b0))) for r in found)
    assert pairs == sorted((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2)


def test_roots_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (501, 500)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_no_documents(no_documents):
    assert S.components(no_documents).collect() == []
