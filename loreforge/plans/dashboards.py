"""Dashboards over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.operators import activity, learner
from loreforge.plans.registry import query, role, table

ASOF = "2024-01-20"
_LOGS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click'), m AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')"


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return [(e.where("event_type = 'click'"), "ts"), (e.where("event_type = 'purchase'"), "ts")]


@query(f"WITH {_LOGS} SELECT day, CAST(count(*) AS BIGINT) AS n FROM (SELECT day FROM d UNION ALL SELECT day FROM m) GROUP BY day")
def daily_activity(spark, sf_dir):
    """Activity by day over two logs."""
    return activity.daily(_logs(spark, sf_dir))


@query(f"WITH {_LOGS}, a AS (SELECT isodow(day) - 1 AS w, count(*) AS n FROM (SELECT day FROM d UNION ALL SELECT day FROM m) GROUP BY 1) SELECT CAST(i AS INTEGER) AS weekday, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][i + 1] AS name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(7) t(i) LEFT JOIN a ON w = i")
def weekday_activity(spark, sf_dir):
    """Activity by weekday, all seven."""
    return activity.by_weekday(activity.daily(_logs(spark, sf_dir)))


@query(f"""WITH {_LOGS}, a AS (SELECT DISTINCT * FROM (SELECT * FROM d UNION ALL SELECT * FROM m)), b AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM a WHERE day <= DATE '{ASOF}'),
r AS (SELECT user_id, max(day) AS last, count(*) AS n FROM b GROUP BY user_id, g) SELECT u.user_id, coalesce(n, 0) AS streak FROM (SELECT DISTINCT user_id FROM a) u LEFT JOIN r ON r.user_id = u.user_id AND last >= DATE '{ASOF}' - 1""")
def streak(spark, sf_dir):
    """Consecutive days up to today or yesterday."""
    return activity.streaks(activity.active_days(_logs(spark, sf_dir), ["user_id"]), ["user_id"], F.lit(ASOF).cast("date"))


@query(f"""WITH {_LOGS}, a AS (SELECT DISTINCT * FROM (SELECT * FROM d UNION ALL SELECT * FROM m)), b AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM a)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM b GROUP BY user_id, g""")
def activity_runs(spark, sf_dir):
    """Every run of consecutive days."""
    return activity.runs(activity.active_days(_logs(spark, sf_dir), ["user_id"]), ["user_id"])


@query("""SELECT CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(correct) AS BIGINT) AS correct, round_even(sum(correct) / greatest(sum(asked), 1) * 100, 1) AS accuracy FROM (SELECT count(*) AS asked, sum(correct) AS correct FROM {answers}
UNION ALL SELECT count(*) FILTER (l_quantity <= 45), count(*) FILTER (l_returnflag = 'A' AND l_quantity <= 45) FROM lineitem UNION ALL SELECT count(*), count(*) FILTER (quality = 1) FROM labels)""")
def overview_totals(spark, sf_dir):
    """Questions asked and answered right over three sources."""
    a = role(spark, sf_dir, "answers").agg(F.count("*").alias("asked"), F.sum("correct").alias("correct"))
    m = table(spark, sf_dir, "lineitem").where("l_quantity <= 45").agg(F.count("*").alias("asked"), F.count_if(F.col("l_returnflag") == "A").alias("correct"))
    q = table(spark, sf_dir, "labels").agg(F.count("*").alias("asked"), F.count_if(F.col("quality") == 1).alias("correct"))
    return activity.totals([a, m, q])


def _mastery(spark, sf_dir):
    q = role(spark, sf_dir, "questions").select("question_id", "book_id", "chapter")
    a = role(spark, sf_dir, "answers").join(q, "question_id")
    return a.groupBy("book_id", "chapter").agg(F.avg("correct").alias("theta"), F.count("*").alias("attempts"))


_MASTERY = "m AS (SELECT q.book_id, q.chapter, avg(a.correct) AS theta, count(*) AS attempts FROM {answers} a JOIN {questions} q USING (question_id) GROUP BY ALL)"
_TITLES = "t AS (SELECT book_id, chapter, min_by(chapter_title, id) AS title FROM {chunks} GROUP BY ALL)"


@query(f"""WITH {_MASTERY}, {_TITLES}, s AS (SELECT m.*, round_even(theta * 100, 1) AS score, title FROM m LEFT JOIN t USING (book_id, chapter))
SELECT book_id, chapter, attempts, score, coalesce(title, 'Chapter ' || chapter) AS name, CASE WHEN score < 40 THEN 'Weak Foundation' WHEN score < 60 THEN 'Needs Practice' ELSE 'Proficient' END AS status, CASE WHEN score < 40 THEN 'rose' WHEN score < 60 THEN 'amber' ELSE 'emerald' END AS colour FROM s""")
def focus_areas(spark, sf_dir):
    """Practised topics with their status."""
    t = activity.first_titles(role(spark, sf_dir, "chunks"), ["book_id", "chapter"])
    return activity.focus(_mastery(spark, sf_dir), t, ["book_id", "chapter"]).select("book_id", "chapter", "attempts", "score", "name", "status", "colour")


@query(f"""WITH {_MASTERY}, w AS (SELECT book_id, chapter, theta, attempts FROM m WHERE theta < 0.5), p AS (SELECT DISTINCT book_id, prereq_chapter AS chapter, NULL::DOUBLE AS theta, 0 AS attempts FROM {{prereqs}}),
u AS (SELECT *, false AS filled FROM w UNION ALL SELECT *, true FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.book_id = p.book_id AND w.chapter = p.chapter))
SELECT book_id, chapter, round_even(theta, 6) AS theta, attempts, filled FROM u ORDER BY filled, theta NULLS FIRST, attempts DESC, CAST(chapter AS INT), book_id LIMIT 12""")
def focus_fill(spark, sf_dir):
    """Weak topics, filled up with prerequisites that weren't practised."""
    weak = _mastery(spark, sf_dir).where("theta < 0.5").select("book_id", "chapter", "theta", "attempts")
    rest = role(spark, sf_dir, "prereqs").select("book_id", F.col("prereq_chapter").alias("chapter")).distinct().withColumns({"theta": F.lit(None).cast("double"), "attempts": F.lit(0).cast("bigint")})
    out = activity.fill_up(weak, rest, 12, ["book_id", "chapter"], [F.asc("theta"), F.desc("attempts"), F.col("chapter").cast("int"), F.col("book_id")])
    return out.withColumn("theta", F.bround("theta", 6))


@query("""SELECT c.book_id, count(*) AS passages, count(DISTINCT chapter) AS chapters, coalesce(nullif(min(page_start), 0), 1) AS first_page, coalesce(nullif(max(page_end), 0), 1000) AS last_page, coalesce(any_value(d), 0) AS diagrams
FROM {chunks} c LEFT JOIN (SELECT 'Brand#' || (l_suppkey % 25 + 1) AS book_id, count(*) AS d FROM lineitem GROUP BY 1) i ON i.book_id = c.book_id GROUP BY c.book_id""")
def study_resources(spark, sf_dir):
    """Every book's passages, chapters, pages and diagrams in one pass over each table."""
    i = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("book_id"))
    return activity.books(role(spark, sf_dir, "chunks"), i)


@query(f"""WITH {_MASTERY}, b AS (SELECT book_id, avg(difficulty) AS mastery FROM {{questions}} WHERE slot = 'T2' GROUP BY book_id), a AS (SELECT book_id, round_even(avg(theta) * 100, 1) AS a FROM m GROUP BY book_id)
SELECT coalesce(a.book_id, b.book_id) AS book_id, CAST(trunc(coalesce(a, round_even(mastery * 100, 1), 0)) AS INTEGER) AS progress FROM a FULL JOIN b ON a.book_id = b.book_id""")
def subject_progress(spark, sf_dir):
    """Progress in percent, from abilities or else from topic mastery."""
    m = _mastery(spark, sf_dir)
    b = role(spark, sf_dir, "questions").where("slot = 'T2'").select("book_id", F.col("difficulty").alias("mastery"))
    return activity.subject_progress(m, b, "book_id")


@query("SELECT student_id, topic, count(*) AS asked, CAST(sum(correct) AS BIGINT) AS correct, round_even(sum(correct) / count(*), 6) AS accuracy, sum(correct) / count(*) < 0.6 AS weak FROM {answers} GROUP BY ALL")
def session_summary(spark, sf_dir):
    """Asked, correct and accuracy by learner and topic."""
    return learner.chapter_summary(role(spark, sf_dir, "answers"), ["student_id", "topic"]).withColumn("accuracy", F.bround("accuracy", 6))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_activity(spark, sf_dir):
    """Tumbling windows of an hour by user and kind of event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
