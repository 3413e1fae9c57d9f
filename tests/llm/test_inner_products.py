import math
import random

import numpy as np
import pytest

from loreforge.llm import inner_products as P


def brute_force(rows, k=20, every=20):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in rows if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_query_against_brute_force(spark, folder):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (0.7**j) * (3 if i % 50 == 0 else 1) for j in range(40)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(500, None), (520, [None] * 40), (540, [float("nan")] * 40), (560, [float("inf")] * 40), (None, [1.0] * 40), (-20, [0.0] * 40)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, id string, label int").repartition(3)
    got = sorted(tuple(r) for r in P.op4_norm_sorted_products(spark, folder(embeddings=df)).collect())
    assert got == brute_force(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (20, [-1.0, 0.0]), (3, [1.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in P.top_products(df).collect()) == brute_force([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (20, [-1.0, 0.0])])
    assert P.top_products(df.limit(0)).collect() == []


def test_blocks_are_left_out_by_length():
    """Every block after the first is too short to matter, so it isn't looked at."""
    rng = np.random.default_rng(1)
    v = np.floor(64 * rng.normal(size=(300, 30)))
    axes = np.linalg.svd(v, full_matrices=False)[2].T
    seen = []

    def blocks():
        for n, scale in enumerate((100, 1, 1)):
            w = np.floor(v * scale)
            turned = w @ axes
            seen.append(n)
            yield {"ids": np.arange(300) + 1000 * n, "whole": w, "head": turned[:, : P.HEAD], "rest": np.sqrt((turned[:, P.HEAD :] ** 2).sum(axis=1)), "length": float(np.sqrt((w**2).sum(axis=1)).max())}

    best = P.search_block(np.array([-1]), v[:1], axes, blocks(), 20)
    assert seen == [0, 1] and best.id.max() < 1000


def test_each_length_is_a_search_of_its_own(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 3, 7, 30]))]) for i in range(200)] + [(200, []), (201, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = [r for n in (3, 7, 30) for r in brute_force([x for x in rows if len(x[1]) == n])]
    assert sorted(tuple(r) for r in P.top_products(df).collect()) == sorted(want) and len(want) > 100


def test_inexact_scores_are_refused(spark):
    df = spark.createDataFrame([(0, [1e7] * 64), (1, [1.0] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="53 bits"):
        P.top_products(df)
    assert P.top_products(df, scale=1).count() == 1
