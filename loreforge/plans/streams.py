"""Streams over the event log, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.plans.registry import query
from loreforge.streaming import activity, learner, run


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_activity(spark, sf_dir):
    """Tumbling days by kind of event."""
    return run.newest(activity.daily(run.source(spark, sf_dir, "events"), ["event_type"]), ["event_type", "day"], "daily")


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events)
SELECT s AS start, s + INTERVAL 12 HOUR AS "end", count(*) AS n FROM w GROUP BY s""")
def stream_sliding_activity(spark, sf_dir):
    """Windows of 12 hours every 6."""
    out = run.newest(activity.sliding(run.source(spark, sf_dir, "events"), "12 hours", "6 hours"), ["start", "end"], "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH RECURSIVE a AS (SELECT event_id AS seq, user_id AS student_id, CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE 0 END AS correct, event_id * 53 % 100 / 100 AS difficulty FROM events WHERE event_type <> 'error'),
g AS (SELECT event_id - 1 AS seq, user_id AS student_id FROM events WHERE event_type = 'error'),
o AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY seq) AS i FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.seq = a.seq AND g.student_id = a.student_id)),
f AS (SELECT student_id, i, correct AS good, CAST(greatest(0.02, least(0.98, 0.5 + 0.30 * (correct - 1 / (1 + exp(-6 * (0.5 - difficulty)))))) AS DOUBLE) AS theta FROM o WHERE i = 1
UNION ALL SELECT o.student_id, o.i, f.good + o.correct, greatest(0.02, least(0.98, f.theta + greatest(0.06, 0.30 / sqrt(f.i + 1)) * (o.correct - 1 / (1 + exp(-6 * (f.theta - o.difficulty)))))) FROM f JOIN o ON o.student_id = f.student_id AND o.i = f.i + 1)
SELECT student_id, round_even(max_by(theta, i), 6) AS theta, max(i) AS attempts, CAST(max_by(good, i) AS BIGINT) AS correct FROM f GROUP BY student_id""")
def stream_abilities(spark, sf_dir):
    """Abilities as keyed state, with retractions."""
    out = run.newest(learner.abilities(learner.as_answers(run.source(spark, sf_dir, "events")), "student_id"), ["student_id"], "abilities")
    return out.where("attempts > 0").select("student_id", F.bround("theta", 6).alias("theta"), "attempts", "correct")
