"""Exams: stratified draws, grading, diagnosis.  Draws are by hash, so that a seed gives the same exam anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions import scores, text

SLOTS = ("T1", "T2", "T3")


def draw_order(id: str | Column, seed: str) -> Column:
    """A random-looking order that any engine with md5 repeats."""
    c = F.col(id) if isinstance(id, str) else id
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def draw(df: DataFrame, n: int, *, id: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """n rows without replacement, of the whole table or of each group."""
    if not by:
        return df.orderBy(draw_order(id, seed), id).limit(n)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(draw_order(id, seed), id))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def draw_fresh_first(df: DataFrame, used: DataFrame, n: int, *, id: str, seed: str) -> DataFrame:
    """n rows, those without a match in ``used`` first."""
    marked = df.join(used.select(id).where(F.col(id).isNotNull()).distinct().withColumn("_used", F.lit(1)), id, "left")
    return marked.orderBy(F.col("_used").isNotNull(), draw_order(id, seed), id).limit(n).withColumn("fresh", F.col("_used").isNull()).drop("_used")


def quotas(n: int, exam: str) -> dict[str, int]:
    """Questions from each slot: 30 % of the first two and the rest, at least one each; all from the slot of a midterm."""
    if exam in ("T1", "T2"):
        return {exam: n}
    third = max(1, round(n * 0.3))
    return {"T1": third, "T2": third, "T3": max(1, n - 2 * third)}


def stratified(pool: DataFrame, n: int, *, exam: str = "T3", id: str = "question_id", slot: str = "slot", seed: str = "exam") -> DataFrame:
    """The questions of an exam with their position.

    Each slot gives up to its quota; what is missing is filled up from the rest.  A
    midterm whose slot is empty draws from everything.
    """
    want = quotas(n, exam)
    order = draw_order(id, seed)
    in_slot = F.row_number().over(Window.partitionBy(slot).orderBy(order, id))
    quota = F.coalesce(*[F.when(F.col(slot) == s, F.lit(q)) for s, q in want.items()], F.lit(0))
    # At most n of a slot can be chosen, in either way.
    top = pool.withColumn("_in", in_slot).where(F.col("_in") <= n).withColumn("_first", F.col("_in") <= quota)
    if exam in ("T1", "T2"):
        some = F.max((F.col(slot) == exam).cast("int")).over(Window.partitionBy(F.lit(1)))
        top = top.withColumn("_some", some).where((F.coalesce(F.col("_some"), F.lit(0)) == 0) | (F.col(slot) == exam))
    chosen = top.orderBy(F.desc("_first"), order, id).limit(n)
    return chosen.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(draw_order(id, seed + "/order"), id))).drop("_in", "_first", "_some")


def given_answer(answers: Column, id: Column, position: Column) -> Column:
    """The first letter given, under the question's id or else its position; null if blank."""
    by = lambda k: F.nullif(F.try_element_at(answers, k.cast("string")), F.lit(""))
    return F.upper(F.substring(text.blank_to_null(text.strip(F.coalesce(by(id), by(position)))), 1, 1))


def graded(items: DataFrame, *, given: str = "given", answer: str = "answer") -> DataFrame:
    """Adds correct and marks; unanswered items are wrong."""
    right = F.coalesce(F.upper(F.substring(F.col(given), 1, 1)) == F.upper(F.substring(F.col(answer), 1, 1)), F.lit(False))
    return items.withColumn("is_correct", right).withColumn("marks", right.cast("double"))


def results(items: DataFrame, by: list[str]) -> DataFrame:
    """score, total, percentage and grade by exam."""
    out = items.groupBy(*by).agg(F.sum("marks").alias("score"), F.count("*").alias("total"))
    out = out.withColumn("percentage", scores.percentage(F.col("score"), F.col("total")))
    return out.withColumn("grade", scores.grade(F.col("percentage")))


def tier_accuracy(items: DataFrame, by: list[str], *, slot: str = "slot") -> DataFrame:
    """by, slot, asked, correct, accuracy: a row for every slot, asked or not."""
    tiers = F.explode(F.array(*[F.lit(s) for s in SLOTS])).alias("slot")
    every = items.select(*by).distinct().select(*by, tiers)
    seen = items.groupBy(*by, F.coalesce(F.col(slot), F.lit("T1")).alias("slot")).agg(F.count("*").alias("asked"), F.count_if(F.col("is_correct")).alias("correct"))
    out = every.join(seen, [*by, "slot"], "left").fillna(0, ["asked", "correct"])
    return out.withColumn("accuracy", scores.percentage(F.col("correct"), F.col("asked")))


def missed_prerequisites(items: DataFrame, prereqs: DataFrame, by: list[str], *, most: int = 6) -> DataFrame:
    """The prerequisites of wrongly answered chapters by how often they were missed."""
    missed = items.where(~F.col("is_correct")).join(prereqs, "chapter")
    n = missed.groupBy(*by, "prereq_chapter").agg(F.count("*").alias("missed"), F.min("position").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("missed"), "first", "prereq_chapter"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).drop("first")


def public(questions: DataFrame, *, reveal: Column | None = None, hidden: tuple[str, ...] = ("answer", "explanation")) -> DataFrame:
    """Questions without their answers, or with them where ``reveal`` holds."""
    if reveal is None:
        return questions.drop(*hidden)
    return questions.withColumns({c: F.when(reveal, F.col(c)) for c in hidden if c in questions.columns})


def level_counts(questions: DataFrame, by: list[str], *, difficulty: str = "difficulty") -> DataFrame:
    """easy, medium and hard questions of each group, zero where there are none."""
    level = scores.question_level(F.col(difficulty))
    return questions.groupBy(*by).agg(*[F.count_if(level == x).alias(x) for x in scores.DIFFICULTY])


# ---- the syllabus ------------------------------------------------------------


def partition_thirds(chapters: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Slots T1, T2, T3 by thirds of the order, cut at half-even rounded places, and the position within the slot."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by))
    first = F.greatest(F.lit(1), F.bround(n / F.lit(3.0), 0))
    second = F.greatest(first + 1, F.bround(n * 2 / F.lit(3.0), 0))
    out = chapters.withColumns({"_at": at, "_n": n}).withColumn("slot", F.when(at <= first, "T1").when(at <= second, "T2").otherwise("T3"))
    position = (F.row_number().over(Window.partitionBy(*by, "slot").orderBy("_at")) - 1).cast("bigint")
    return out.withColumn("position", position).drop("_at", "_n")


def slot_view(chapters: DataFrame, view: str) -> DataFrame:
    """Chapters of an exam's scope: the last exam is about everything, ``T1+T2`` about both."""
    slots = {"T1": ["T1"], "T2": ["T2"], "T1+T2": ["T1", "T2"]}.get(view.upper())
    if slots is None and view.upper() not in ("T3", "ALL"):
        raise ValueError(f"no such view: {view}")
    return chapters if slots is None else chapters.where(F.col("slot").isin(slots))
