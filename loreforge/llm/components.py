"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import written

MAX_ROUNDS = 60


def roots(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (the same orderable type).  Returns node, root for each node of an edge, where root is
    the smallest node that can be reached and root < node (roots themselves are not listed).

    Alternating large-star and small-star rounds: each links the neighbours of a
    node to the smallest of them, so the edges never grow in number and end as one
    star for each component, after a number of rounds that grows with the logarithm
    of its diameter.  Each half of a round is written to the shared folder.  Hubs are met by
    pre-aggregated minima and a join that AQE can split, not by gathering a node's
    neighbours.  Loops and repeated edges don't matter.
    """
    state = written(_down(edges), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = written(_small_star(written(_large_star(state), "stars")), "edges")  # each half is read more than once
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no stars after {MAX_ROUNDS} rounds")


def _down(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller end."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
