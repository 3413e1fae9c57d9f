"""Numbers: rounding, ladders, and the ability model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ability model: where learners start, the curve's slope, step sizes and bounds.
START, SLOPE, LEAST_STEP, FIRST_STEP, LOWEST, HIGHEST = 0.5, 6.0, 0.06, 0.30, 0.02, 0.98
TARGET_OFFSET, TARGET_LOW, TARGET_HIGH = -0.05, 0.1, 0.95
DIFFICULTY = {"easy": 0.3, "medium": 0.5, "hard": 0.8}
MARKS = {"mcq": 1, "short": 2, "long": 5}


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, with b at least 1."""
    return a / F.greatest(b, F.lit(1))


def percentage(a: Column, b: Column, digits: int = 1) -> Column:
    return half_even(ratio(a.cast("double"), b) * 100, digits)


def chance(theta: Column, difficulty: Column) -> Column:
    """That a learner answers a question right."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-SLOPE) * (theta - difficulty)))


def step(theta: Column, difficulty: Column, correct: Column, attempts: Column) -> Column:
    """The ability after an answer; steps shrink as evidence grows."""
    k = F.greatest(F.lit(LEAST_STEP), F.lit(FIRST_STEP) / F.sqrt(attempts.cast("double") + F.lit(1.0)))
    return F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), theta + k * (correct.cast("double") - chance(theta, difficulty))))


def target(theta: Column) -> Column:
    return clamp(theta + F.lit(TARGET_OFFSET), TARGET_LOW, TARGET_HIGH)


def learner_level(theta: Column) -> Column:
    return F.when(theta < 0.35, "beginner").when(theta < 0.6, "intermediate").otherwise("advanced")


def question_level(difficulty: Column) -> Column:
    return F.when(difficulty < 0.4, "easy").when(difficulty < 0.65, "medium").otherwise("hard")


def grade(percent: Column) -> Column:
    return F.when(percent >= 90, "A+").when(percent >= 80, "A").when(percent >= 70, "B").when(percent >= 60, "C").when(percent >= 50, "D").otherwise("F")


def focus_status(score: Column) -> Column:
    return F.when(score < 40, "Weak Foundation").when(score < 60, "Needs Practice").otherwise("Proficient")


def focus_colour(score: Column) -> Column:
    return F.when(score < 40, "rose").when(score < 60, "amber").otherwise("emerald")


def topic_status(theta: Column, attempts: Column, correct: Column) -> Column:
    """completed, weak or pending."""
    tried, good = F.coalesce(attempts, F.lit(0)), F.coalesce(theta, F.lit(START)) >= 0.55
    weak = ~good | (ratio(F.coalesce(correct, F.lit(0)), tried) < 0.5)
    return F.when((tried >= 2) & good, "completed").when((tried >= 1) & weak, "weak").when(tried >= 1, "completed").otherwise("pending")


def cosine_similarity(a: Column, b: Column) -> Column:
    """The inner product of two unit vectors, in [0, 1]; null if a component is (bounds alone would make that 1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x, lambda s: F.when(s.isNotNull(), clamp(s, 0.0, 1.0)))
