"""Prerequisite graphs: neighbours, levels, and the order in which to learn.

A book's graph has as many nodes as chapters, so the order is computed by one task
for each book, books in parallel; levels are computed set by set for all books.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.storage import written

RANKS = {"weak": 0, "pending": 1, "completed": 2}


def neighbours(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, chapter, prereqs, unlocks: sorted lists, empty where there are none."""
    up = edges.groupBy(*by, "chapter").agg(F.array_sort(F.collect_set("prereq_chapter")).alias("prereqs"))
    down = edges.groupBy(*by, F.col("prereq_chapter").alias("chapter")).agg(F.array_sort(F.collect_set("chapter")).alias("unlocks"))
    none = F.array().cast("array<string>")
    return up.join(down, [*by, "chapter"], "full").withColumns({"prereqs": F.coalesce("prereqs", none), "unlocks": F.coalesce("unlocks", none)})


def in_degrees(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """How many prerequisites each node has, those that are no nodes included."""
    n = edges.groupBy(*by, "chapter").agg(F.count("*").alias("in_degree"))
    return nodes.join(n, [*by, "chapter"], "left").fillna(0, ["in_degree"])


def levels(nodes: DataFrame, edges: DataFrame, by: str, most: int = 64) -> DataFrame:
    """by, chapter, level: 0 without prerequisites, else one more than the deepest of them; nodes on or behind a cycle have none.

    Set-wise relaxation: one join for each level until nothing changes.
    """
    state = in_degrees(nodes, edges, [by]).select(by, "chapter", F.when(F.col("in_degree") == 0, 0).alias("level"), "in_degree")
    for depth in range(1, most + 1):
        known = state.where("level is not null").select(by, F.col("chapter").alias("prereq_chapter"), "level")
        met = edges.join(known, [by, "prereq_chapter"]).groupBy(by, "chapter").agg(F.count("*").alias("met"), F.max("level").alias("deepest"))
        new = state.join(met, [by, "chapter"], "left").select(by, "chapter", F.coalesce("level", F.when(F.col("met") == F.col("in_degree"), F.col("deepest") + 1)).alias("level"), "in_degree")
        new = written(new, "levels")
        if new.where(F.col("level") == depth).isEmpty():
            return new.select(by, "chapter", "level")
        state = new
    return state.select(by, "chapter", "level")


def learning_order(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """by, step, chapter, reached: prerequisites first; among those that are ready weak topics, then pending, then completed ones, by slot and number.

    ``nodes``: by, chapter, status, slot and place (an order of all nodes).  A node that
    a cycle or a missing prerequisite holds back comes last, in place order, and isn't
    reached.
    """
    packed = nodes.groupBy(by).agg(F.collect_list(F.struct("place", "chapter", "status", "slot")).alias("nodes"))
    linked = edges.groupBy(by).agg(F.collect_list(F.struct("prereq_chapter", "chapter")).alias("edges"))

    def order(batches):
        for batch in batches:
            out = []
            for key, nodes_, edges_ in zip(batch[by], batch["nodes"], batch["edges"], strict=True):
                rows = sorted((n["place"], n["chapter"], n["status"], n["slot"]) for n in nodes_)
                rank = {c: (RANKS.get(s, 1), {"T1": 0, "T2": 1}.get(slot, 2), int("".join(ch for ch in c if ch.isdigit()) or 0), p) for p, c, s, slot in rows}
                waiting, after = dict.fromkeys(rank, 0), {}
                for e in [] if edges_ is None else edges_:
                    if e["chapter"] in waiting:
                        waiting[e["chapter"]] += 1
                        after.setdefault(e["prereq_chapter"], []).append(e["chapter"])
                ready = [(rank[c], c) for c, n in waiting.items() if not n]
                heapq.heapify(ready)
                done: list[str] = []
                while ready:
                    c = heapq.heappop(ready)[1]
                    done.append(c)
                    for x in after.get(c, []):
                        waiting[x] -= 1
                        if not waiting[x]:
                            heapq.heappush(ready, (rank[x], x))
                reached = set(done)
                done += [c for _, c, _, _ in rows if c not in reached]
                out += [(key, i + 1, c, c in reached) for i, c in enumerate(done)]
            yield pd.DataFrame(out, columns=[by, "step", "chapter", "reached"])

    kind = nodes.schema[by].dataType.simpleString()
    return packed.join(linked, by, "left").mapInPandas(order, f"{by} {kind}, step int, chapter string, reached boolean")


def recommendations(ordered: DataFrame, nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Adds advice: what to re-study, what is blocked by which prerequisites, what is ready."""
    status = nodes.select(by, F.col("chapter").alias("prereq_chapter"), F.col("status").alias("before"))
    open_ = edges.join(status, [by, "prereq_chapter"], "left").groupBy(by, "chapter").agg(
        F.count("*").alias("needs"), F.array_sort(F.collect_set(F.when(F.coalesce(F.col("before"), F.lit("")) != "completed", F.col("prereq_chapter")))).alias("unmet")
    )
    full = ordered.join(nodes.select(by, "chapter", "status"), [by, "chapter"]).join(open_, [by, "chapter"], "left")
    advice = (
        F.when(~F.col("reached"), "independent").when(F.col("status") == "weak", "re-study").when(F.col("status") == "completed", "mastered")
        .when(F.col("needs").isNull(), "begin").when(F.size("unmet") > 0, F.concat(F.lit("blocked by "), F.array_join("unmet", ", "))).otherwise("ready")
    )
    return full.withColumn("advice", advice).select(by, "step", "chapter", "status", "advice")


def readiness(nodes: DataFrame, by: str) -> DataFrame:
    """Topics by status and the completed share in percent."""
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "weak", "pending")]
    out = nodes.groupBy(by).agg(F.count("*").alias("total"), *n)
    return out.withColumn("readiness", F.bround(F.col("completed") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 1))
