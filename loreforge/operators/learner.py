"""Learners' state as folds over their answer logs.

The log is the truth: abilities, schedules and mastery are recomputed from it, so a
question can be retired by leaving its answers out.  Abilities are folded over a sorted
stream of answers, of which one is held at a time, so a learner's log may be of any
length; reviews and mastery are folded in the JVM over one card's or topic's log.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreforge.functions import scores

#: Fixed values of spaced repetition and of the mastery averages.
EASE, LEAST_EASE, MOST_EASE = 2.5, 1.3, 3.0
KEEP, GAIN, FIRST_RIGHT, FIRST_WRONG, SHIFT = 0.7, 0.3, 0.8, 0.4, 0.15


def log_of(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keys and log: each key's rows as structs in order."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in values if c not in order]))).alias("log"))


def step(theta: float, difficulty: float, correct: int, attempts: int) -> float:
    """``functions.scores.step`` on plain numbers."""
    k = max(scores.LEAST_STEP, scores.FIRST_STEP / math.sqrt(attempts + 1))
    return min(scores.HIGHEST, max(scores.LOWEST, theta + k * (correct - 1 / (1 + math.exp(-scores.SLOPE * (theta - difficulty))))))


def ability(df: DataFrame, keys: list[str], order: list[str], *, correct: str = "correct", difficulty: str = "difficulty", start: Column | None = None) -> DataFrame:
    """keys, theta, attempts, correct: the ability after all answers."""
    each = _steps(df, keys, order, correct, difficulty, start)
    out = each.groupBy(*keys).agg(F.max_by("_after", "_position").alias("_theta"), F.count("*").alias("_attempts"), F.sum("_correct").cast("bigint").alias("_right"))
    return out.select(*keys, F.col("_theta").alias("theta"), F.col("_attempts").alias("attempts"), F.col("_right").alias("correct"))


def trail(df: DataFrame, keys: list[str], order: list[str], *, correct: str = "correct", difficulty: str = "difficulty", start: Column | None = None) -> DataFrame:
    """keys, order columns, position, theta_before, theta_after of every answer."""
    each = _steps(df, keys, order, correct, difficulty, start)
    return each.select(*keys, *order, F.col("_position").alias("position"), F.col("_before").alias("theta_before"), F.col("_after").alias("theta_after"))


def _steps(df: DataFrame, keys: list[str], order: list[str], correct: str, difficulty: str, start: Column | None) -> DataFrame:
    """keys, order, _correct, _position, _before, _after of every answer that has a result and a difficulty; ``start`` is made of keys."""
    begin = (start if start is not None else F.lit(scores.START)).cast("double")
    src = df.select(*keys, *order, F.col(correct).cast("int").alias("_correct"), F.col(difficulty).cast("double").alias("_difficulty"), begin.alias("_begin"))
    src = src.where("_correct is not null and _difficulty is not null")
    ordered = src.repartition(*keys).sortWithinPartitions(*keys, *order, "_correct", "_difficulty")
    n = len(keys)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: n + len(order)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, theta, position = None, 0.0, 0
        for batch in batches:
            places, before, after = [], [], []
            columns = [batch.column(i).to_pylist() for i in (*range(n), *range(batch.num_columns - 3, batch.num_columns))]
            for *key, right, hard, first in zip(*columns, strict=True):
                if key != now:
                    now, theta, position = key, first, 0
                before.append(theta)
                theta = step(theta, hard, right, position)
                position += 1
                after.append(theta)
                places.append(position)
            made = [pa.array(places, pa.int64()), pa.array(before, pa.float64()), pa.array(after, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*batch.schema.names[:-2], "_position", "_before", "_after"])

    return ordered.mapInArrow(run, ", ".join([*kinds, "_correct int, _position bigint, _before double, _after double"]))


def retire(df: DataFrame, retired: DataFrame, on: list[str]) -> DataFrame:
    """The log without the answers to retired questions."""
    return df.join(retired.select(*on).distinct(), on, "left_anti")


def retire_and_replay(df: DataFrame, retired: DataFrame, on: list[str], keys: list[str], order: list[str], **columns) -> DataFrame:
    """Abilities after retiring; a key whose answers are all retired has none."""
    return ability(retire(df, retired, on), keys, order, **columns)


def session_start(mastery: DataFrame, by: list[str]) -> DataFrame:
    """The mean ability over a learner's topics, where sessions start; half where there are none."""
    return mastery.groupBy(*by).agg(F.coalesce(F.avg("theta"), F.lit(scores.START)).alias("theta"))


def next_item(learners: DataFrame, questions: DataFrame, seen: DataFrame, *, by: str, question: str = "question_id") -> DataFrame:
    """by, question, difficulty, target, seen, gap: what to ask each learner next.

    Questions never seen come first, then those nearest in difficulty to the learner's
    target (lower difficulties, then smaller ids among equals).  ``learners``: by,
    theta, scope (a book); ``questions``: question, scope, difficulty; ``seen``: by,
    question.  Learners meet difficulties, not questions: within the best one only the
    first unseen place is looked for, among one more places than were seen.
    """
    level = ["scope", "difficulty"]
    placed = questions.select(question, *level).withColumn("place", F.row_number().over(Window.partitionBy(*level).orderBy(question)))
    sizes = placed.groupBy(*level).agg(F.count("*").alias("n"))
    was = seen.select(by, question).distinct().join(placed, question)
    taken = was.groupBy(by, *level).agg(F.count("*").alias("taken"))
    options = learners.withColumn("target", scores.target(F.col("theta"))).join(sizes, "scope").join(taken, [by, *level], "left").fillna(0, ["taken"])
    gap = F.abs(F.col("difficulty") - F.col("target"))
    options = options.withColumns({"seen": F.col("taken") >= F.col("n"), "gap": gap})
    best = F.row_number().over(Window.partitionBy(by).orderBy("seen", F.round("gap", 9), "difficulty"))
    options = options.withColumn("best", best).where("best = 1")
    places = options.select(by, *level, "target", "seen", "gap", F.explode(F.expr("sequence(1, if(seen, 1, cast(taken + 1 as int)))")).alias("place"))
    free = places.join(placed, [*level, "place"]).join(was.select(by, question, F.lit(True).alias("old")), [by, question], "left").where("seen or old is null")
    return free.groupBy(by, "difficulty", "target", "seen", "gap").agg(F.min(question).alias(question)).select(by, question, "difficulty", "target", "seen", "gap")


def review_schedule(df: DataFrame, keys: list[str], order: list[str], *, known: str = "known", day: str = "day") -> DataFrame:
    """keys, ease, interval_days, reps, due_date after all reviews.  A card's interval uses its ease before the review."""
    first = F.struct(F.lit(EASE).alias("ease"), F.lit(0).cast("bigint").alias("days"), F.lit(0).cast("bigint").alias("reps"), F.lit(None).cast("date").alias("on"))

    def one(acc, x):
        reps = F.when(x[known], acc["reps"] + 1).otherwise(0).cast("bigint")
        grown = F.greatest(F.lit(1), F.bround(acc["days"] * acc["ease"], 0)).cast("bigint")
        days = F.when(~x[known] | (reps == 1), F.lit(1)).when(reps == 2, F.lit(3)).otherwise(grown).cast("bigint")
        ease = F.when(x[known], F.least(F.lit(MOST_EASE), acc["ease"] + 0.1)).otherwise(F.greatest(F.lit(LEAST_EASE), acc["ease"] - 0.2))
        return F.struct(ease.alias("ease"), days.alias("days"), reps.alias("reps"), x[day].alias("on"))

    end = log_of(df, keys, order, [known, day]).withColumn("e", F.aggregate("log", first, one))
    return end.select(*keys, F.bround("e.ease", 2).alias("ease"), F.col("e.days").alias("interval_days"), F.col("e.reps").alias("reps"), F.date_add("e.on", F.col("e.days").cast("int")).alias("due_date"))


def due_cards(cards: DataFrame, state: DataFrame, asof: Column, *, card: str = "card_id", limit: int | None = None) -> DataFrame:
    """Cards that were never reviewed or are due, earliest first.  ``state`` is one learner's."""
    out = cards.join(state, card, "left").where(F.col("due_date").isNull() | (F.to_date("due_date") <= asof))
    out = out.withColumns({"ease": F.coalesce("ease", F.lit(EASE)), "interval_days": F.coalesce("interval_days", F.lit(0)), "reps": F.coalesce("reps", F.lit(0))})
    out = out.orderBy(F.coalesce(F.to_date("due_date"), F.lit("1970-01-01").cast("date")), card)
    return out if limit is None else out.limit(limit)


def card_stats(cards: DataFrame, state: DataFrame, asof: Column, *, card: str = "card_id") -> DataFrame:
    """total, reviewed, due and new of one learner's cards, in one pass."""
    joined = cards.join(state.withColumn("was", F.lit(1)), card, "left")
    due = F.col("due_date").isNull() | (F.to_date("due_date") <= asof)
    return joined.agg(F.count("*").alias("total"), F.count("was").alias("reviewed"), F.count_if(due).alias("due")).withColumn("new", F.col("total") - F.col("reviewed"))


def mastery_average(df: DataFrame, keys: list[str], order: list[str], *, correct: str = "correct") -> DataFrame:
    """keys, mastery, attempts: an exponential average, rounded half-even to hundredths after each answer (in whole hundredths, so exactly)."""

    def one(acc, right):
        tenths = acc * int(KEEP * 10) + right.cast("bigint") * int(GAIN * 1000)
        whole, rest = F.floor(tenths / 10), tenths % 10
        new = whole + F.when((rest > 5) | ((rest == 5) & (whole % 2 == 1)), 1).otherwise(0)
        first = F.when(right.cast("int") == 1, int(FIRST_RIGHT * 100)).otherwise(int(FIRST_WRONG * 100))
        return F.when(acc.isNull(), first).otherwise(new).cast("bigint")

    out = log_of(df, keys, order, [correct]).withColumn("m", F.aggregate("log", F.lit(None).cast("bigint"), lambda acc, x: one(acc, x[correct])))
    return out.select(*keys, (F.col("m") / 100).alias("mastery"), F.size("log").cast("bigint").alias("attempts"))


def mastery_steps(df: DataFrame, keys: list[str], order: list[str], *, correct: str = "correct") -> DataFrame:
    """keys, mastery, attempts: fixed steps up and down from a half, within 0 and 1."""
    step = lambda acc, x: scores.clamp(acc + F.when(x[correct].cast("int") == 1, SHIFT).otherwise(-SHIFT), 0.0, 1.0)
    return log_of(df, keys, order, [correct]).select(*keys, F.aggregate("log", F.lit(scores.START), step).alias("mastery"), F.size("log").cast("bigint").alias("attempts"))


def weak_topics(mastery: DataFrame, *, score: str = "mastery", below: float = 0.6, by: list[str]) -> DataFrame:
    return mastery.where(F.col(score) < below).orderBy(F.asc(score), *by)


def chapter_summary(answers: DataFrame, by: list[str], *, correct: str = "correct") -> DataFrame:
    """asked, correct, accuracy and weak (under 0.6) by group."""
    out = answers.groupBy(*by).agg(F.count("*").alias("asked"), F.sum(F.col(correct).cast("bigint")).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("asked")).withColumn("weak", F.col("accuracy") < 0.6)


def deficits(counts: DataFrame, quota: int, *, levels: tuple[str, ...] = tuple(scores.DIFFICULTY)) -> DataFrame:
    """How many questions each level lacks of a quota; ``counts`` has a column for each level."""
    return counts.select(*[c for c in counts.columns if c not in levels], *[F.greatest(F.lit(quota) - F.col(x), F.lit(0)).alias(x) for x in levels])


def needs_generation(picks: DataFrame, gap: float = 0.2) -> DataFrame:
    """Whether a pick is too far from the target or was seen before, so that new questions are called for."""
    return picks.withColumn("generate", (F.col("gap") > gap) | F.col("seen"))
