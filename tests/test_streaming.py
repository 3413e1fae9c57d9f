import random

import pytest
from pyspark.sql import functions as F

from loreforge.operators import learner as batch
from loreforge.streaming import activity, learner, run


@pytest.fixture
def folder(spark, tmp_path):
    """Events in several files, out of order and with a repeated row, so that the stream takes several micro-batches."""
    rng = random.Random(2)
    rows = [(i, f"2024-01-{1 + i // 20:02d} {i % 20:02d}:30:00", i % 3, rng.choice(["click", "view", "signup", "error"])) for i in range(100)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:1], "event_id bigint, ts string, user_id int, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_days(spark, folder):
    got = run.newest(activity.daily(run.source(spark, folder, "events"), late="60 days"), ["day"], "t")
    assert sorted(r.n for r in got.collect()) == [20, 20, 20, 20, 21]


def test_sessions_and_duplicates(spark, folder):
    s = activity.sessions(run.source(spark, folder, "events"), "user_id", "4 hours", late="60 days")
    assert s.columns == ["user_id", "start", "end", "n"] and s.isStreaming
    once = run.newest(activity.daily(run.source(spark, folder, "events").select("ts", "event_id"), late="60 days"), ["day"], "t")
    assert once.agg(F.sum("n")).first()[0] == 101
    unique = activity.deduplicated(run.source(spark, folder, "events"), "event_id", late="60 days")
    assert unique.isStreaming


def test_stream_equals_batch_after_retractions(spark, folder):
    got = run.newest(learner.abilities(learner.as_answers(run.source(spark, folder, "events")), "student_id"), ["student_id"], "t")
    events = spark.read.parquet(f"{folder}/events.parquet").dropDuplicates(["event_id"])
    a = learner.as_answers(events)
    log = a.where("not retracted").join(a.where("retracted").select("student_id", "seq"), ["student_id", "seq"], "left_anti")
    want = batch.ability(log, ["student_id"], ["seq"])
    for g, w in zip(sorted(got.where("attempts > 0").collect()), sorted(want.collect()), strict=True):
        assert (g.student_id, g.attempts, g.correct) == (w.student_id, w.attempts, w.correct) and g.theta == pytest.approx(w.theta)


def test_state_is_bounded(spark, folder):
    """With a horizon of five answers the same abilities, but for what comes too late, which is counted."""
    source = lambda: learner.as_answers(run.source(spark, folder, "events")).withColumn("retracted", F.lit(False))
    whole = {r.student_id: r for r in run.newest(learner.abilities(source(), "student_id"), ["student_id"], "t").collect()}
    short = {r.student_id: r for r in run.newest(learner.abilities(source(), "student_id", horizon=5), ["student_id"], "t").collect()}
    assert all(r.late == 0 for r in whole.values())
    for k, r in short.items():
        assert r.attempts <= whole[k].attempts <= r.attempts + r.late
    assert sum(r.late for r in short.values()) > 0


def test_steps_agree(spark):
    rng = random.Random(4)
    log = [(i, rng.randint(0, 1), rng.random()) for i in range(60)]
    df = spark.createDataFrame([(1, *x) for x in log], "k int, seq int, correct int, difficulty double")
    r = batch.ability(df, ["k"], ["seq"]).first()
    theta, n, right = learner.replay(log)
    assert (r.attempts, r.correct) == (n, right) and r.theta == pytest.approx(theta)
