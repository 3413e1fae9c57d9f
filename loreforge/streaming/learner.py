"""A learner's ability as keyed state: the same fold as ``operators.learner.ability``, one answer at a time.

A retraction (an answer's sequence number with ``retracted`` true) rebuilds its key
from the answers that remain.  The state holds the newest ``horizon`` answers of a key and
what all older ones come to, so it is bounded; a retraction or answer that is older than
that is counted as late, and the batch operator over the whole log gives its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loreforge.functions import scores
from loreforge.operators.learner import step

OUT = "theta double, attempts long, correct long, late long"
STATE = "theta double, attempts long, right long, upto long, late long, seqs array<long>, correct array<int>, difficulty array<double>, gone array<long>"
HORIZON = 10_000


def replay(log: list[tuple[int, int, float]], theta: float = scores.START, attempts: int = 0, right: int = 0) -> tuple[float, int, int]:
    """theta, attempts and correct after answers (seq, correct, difficulty) in order of seq, from those before."""
    for n, (_, correct, difficulty) in enumerate(sorted(log), attempts):
        theta = step(theta, difficulty, correct, n)
    return theta, attempts + len(log), right + sum(c for _, c, _ in log)


def abilities(answers: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """key, theta, attempts, correct, late after each micro-batch in which the key has answers.

    ``answers``: a stream with key, seq, correct, difficulty and retracted.  Answers and
    retractions may come in any order and more than once; a seq counts once.  late: how
    many answers and retractions were older than the ``horizon`` newest answers and had no effect.
    """
    kind = answers.schema[key].dataType.simpleString()

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, upto, late = (scores.START, 0, 0), None, 0
        log: dict[int, tuple[int, float]] = {}
        gone: set[int] = set()
        if state.exists:
            *base, upto, late, seqs, correct, difficulty, old = state.get
            log, gone = {s: (c, d) for s, c, d in zip(seqs, correct, difficulty, strict=True)}, set(old)
        for frame in frames:
            for seq, correct, difficulty, retracted in frame[["seq", "correct", "difficulty", "retracted"]].itertuples(index=False):
                if upto is not None and seq <= upto:
                    late += 1
                elif retracted:
                    gone.add(int(seq))
                else:
                    log[int(seq)] = (int(correct), float(difficulty))
        for seq in gone:
            log.pop(seq, None)
        if len(log) > horizon:
            old = sorted(log)[: len(log) - horizon]
            base, upto = replay([(s, *log.pop(s)) for s in old], *base), old[-1]
            gone = {s for s in gone if s > upto}
        state.update((*base, upto, late, [*log], [c for c, _ in log.values()], [d for _, d in log.values()], [*gone]))
        theta, n, right = replay([(s, c, d) for s, (c, d) in log.items()], *base)
        yield pd.DataFrame({key: [k[0]], "theta": [theta], "attempts": [n], "correct": [right], "late": [late]})

    return answers.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {OUT}", STATE, "update", GroupStateTimeout.NoTimeout)


def as_answers(events: DataFrame) -> DataFrame:
    """Driver events in the role of answers; ``error`` events retract the answer before them."""
    return events.select(
        F.col("user_id").alias("student_id"), F.when(F.col("event_type") == "error", F.col("event_id") - 1).otherwise(F.col("event_id")).alias("seq"), F.col("event_type").isin("click", "purchase", "view").cast("int").alias("correct"),
        (F.col("event_id") * 53 % 100 / 100).alias("difficulty"), (F.col("event_type") == "error").alias("retracted"),
    )
