"""Learners' state over the answer log in ``events``: folds against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.operators import exam, graph, learner
from loreforge.plans.registry import query, role, table

_STEP = "greatest(0.02, least(0.98, {t} + greatest(0.06, 0.30 / sqrt({n} + 1)) * ({c} - 1 / (1 + exp(-6 * ({t} - {d}))))))"


def _fold_sql(keys: str, where: str = "true") -> str:
    """Recursive SQL for f: keys, i, seq, before, theta, right."""
    on = " AND ".join(f"o.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    first, later = _STEP.format(t="0.5", n="0", c="correct", d="difficulty"), _STEP.format(t="f.theta", n="f.i", c="o.correct", d="o.difficulty")
    return f"""WITH RECURSIVE o AS (SELECT {keys}, seq, correct, difficulty, row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS i FROM {{answers}} WHERE {where}),
f AS (SELECT {keys}, i, seq, CAST(0.5 AS DOUBLE) AS before, CAST({first} AS DOUBLE) AS theta, correct AS good FROM o WHERE i = 1
UNION ALL SELECT {cols}, o.i, o.seq, f.theta, {later}, f.good + o.correct FROM f JOIN o ON {on} AND o.i = f.i + 1)"""


_END = "SELECT student_id, topic, round_even(max_by(theta, i), 6) AS theta, max(i) AS attempts, CAST(max_by(good, i) AS BIGINT) AS correct FROM f GROUP BY ALL"


@query(_fold_sql("student_id, topic") + _END)
def ability_replay(spark, sf_dir):
    """The ability in every topic, replayed from the log."""
    out = learner.ability(role(spark, sf_dir, "answers"), ["student_id", "topic"], ["seq"])
    return out.withColumn("theta", F.bround("theta", 6))


@query(_fold_sql("session_id") + "SELECT session_id, seq, i AS position, round_even(before, 6) AS theta_before, round_even(theta, 6) AS theta_after FROM f")
def session_trail(spark, sf_dir):
    """Every session's abilities before and after each answer."""
    out = learner.trail(role(spark, sf_dir, "answers"), ["session_id"], ["seq"])
    return out.select("session_id", "seq", "position", F.bround("theta_before", 6).alias("theta_before"), F.bround("theta_after", 6).alias("theta_after"))


@query(_fold_sql("student_id, topic", "question_id % 7 <> 0") + _END)
def retire_and_replay(spark, sf_dir):
    """Abilities after some questions are retired."""
    a = role(spark, sf_dir, "answers")
    gone = a.where("question_id % 7 = 0").select("question_id").distinct()
    return learner.retire_and_replay(a, gone, ["question_id"], ["student_id", "topic"], ["seq"]).withColumn("theta", F.bround("theta", 6))


@query(_fold_sql("student_id, topic") + ", m AS (SELECT student_id, topic, max_by(theta, i) AS theta FROM f GROUP BY ALL) SELECT student_id, round_even(avg(theta), 6) AS theta FROM m GROUP BY student_id")
def session_start(spark, sf_dir):
    """Where a new session starts: the mean over a learner's topics."""
    m = learner.ability(role(spark, sf_dir, "answers"), ["student_id", "topic"], ["seq"])
    return learner.session_start(m, ["student_id"]).withColumn("theta", F.bround("theta", 6))


@query("""WITH l AS (SELECT c_custkey AS learner, c_acctbal / 10000 AS theta, 'Brand#' || (c_custkey % 25 + 1) AS book_id FROM customer),
q AS (SELECT question_id, book_id, round_even(difficulty, 1) AS difficulty FROM {questions} WHERE verified), s AS (SELECT DISTINCT student_id * 10 AS learner, question_id FROM {answers}),
t AS (SELECT *, greatest(0.1, least(0.95, theta - 0.05)) AS target FROM l),
p AS (SELECT t.learner, q.question_id, difficulty, target, s.question_id IS NOT NULL AS seen, abs(difficulty - target) AS gap FROM t JOIN q USING (book_id) LEFT JOIN s ON s.learner = t.learner AND s.question_id = q.question_id),
r AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY seen, round_even(gap, 9), difficulty, question_id) AS i FROM p)
SELECT learner, question_id, difficulty, round_even(target, 6) AS target, seen, round_even(gap, 6) AS gap, gap > 0.2 OR seen AS generate FROM r WHERE i = 1""")
def next_item_pick(spark, sf_dir):
    """The next question for every learner: unseen, and nearest to the target."""
    c = table(spark, sf_dir, "customer")
    l = c.select(F.col("c_custkey").alias("learner"), (F.col("c_acctbal") / 10000).alias("theta"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("scope"))  # noqa: E741
    q = role(spark, sf_dir, "questions").where("verified").select("question_id", F.col("book_id").alias("scope"), F.bround("difficulty", 1).alias("difficulty"))
    seen = role(spark, sf_dir, "answers").select((F.col("student_id") * 10).alias("learner"), "question_id")
    out = learner.needs_generation(learner.next_item(l, q, seen, by="learner"))
    return out.select("learner", "question_id", "difficulty", F.bround("target", 6).alias("target"), "seen", F.bround("gap", 6).alias("gap"), "generate")


@query("""WITH RECURSIVE o AS (SELECT student_id, card_id, known, day, row_number() OVER (PARTITION BY student_id, card_id ORDER BY seq) AS i FROM {reviews}),
f AS (SELECT student_id, card_id, i, day, CAST(CASE WHEN known THEN 2.6 ELSE 2.3 END AS DOUBLE) AS ease, CAST(1 AS BIGINT) AS days, CAST(CASE WHEN known THEN 1 ELSE 0 END AS BIGINT) AS reps FROM o WHERE i = 1
UNION ALL SELECT o.student_id, o.card_id, o.i, o.day, CASE WHEN o.known THEN least(3.0, f.ease + 0.1) ELSE greatest(1.3, f.ease - 0.2) END,
CAST(CASE WHEN NOT o.known OR f.reps = 0 THEN 1 WHEN f.reps = 1 THEN 3 ELSE greatest(1, round_even(f.days * f.ease, 0)) END AS BIGINT), CASE WHEN o.known THEN f.reps + 1 ELSE 0 END
FROM f JOIN o ON o.student_id = f.student_id AND o.card_id = f.card_id AND o.i = f.i + 1)
SELECT student_id, card_id, round_even(max_by(ease, i), 2) AS ease, max_by(days, i) AS interval_days, max_by(reps, i) AS reps, max_by(day, i) + CAST(max_by(days, i) AS INT) AS due_date FROM f GROUP BY ALL""")
def review_schedule(spark, sf_dir):
    """Spaced repetition: ease, interval and due day of every card."""
    return learner.review_schedule(role(spark, sf_dir, "reviews"), ["student_id", "card_id"], ["seq"])


_STATE = "s AS (SELECT card_id, min(day) + 3 AS due_date, count(*) AS reps FROM {reviews} WHERE student_id = 7 GROUP BY card_id)"


@query(f"WITH {_STATE} SELECT c.card_id, CAST(coalesce(reps, 0) AS BIGINT) AS reps, due_date FROM {{cards}} c LEFT JOIN s USING (card_id) WHERE due_date IS NULL OR due_date <= DATE '2024-01-10' ORDER BY coalesce(due_date, DATE '1970-01-01'), c.card_id LIMIT 50")
def due_cards(spark, sf_dir):
    """The 50 cards that one learner should review first."""
    return learner.due_cards(role(spark, sf_dir, "cards"), _state(spark, sf_dir), F.lit("2024-01-10").cast("date"), limit=50).select("card_id", "reps", "due_date")


def _state(spark, sf_dir):
    r = role(spark, sf_dir, "reviews").where("student_id = 7")
    return r.groupBy("card_id").agg(F.date_add(F.min("day"), 3).alias("due_date"), F.count("*").alias("reps")).withColumns({"ease": F.lit(2.5), "interval_days": F.lit(3)})


@query(f"WITH {_STATE} SELECT count(*) AS total, count(s.card_id) AS reviewed, count(*) FILTER (due_date IS NULL OR due_date <= DATE '2024-01-10') AS due, count(*) - count(s.card_id) AS new FROM {{cards}} c LEFT JOIN s USING (card_id)")
def card_stats(spark, sf_dir):
    """How many cards a learner has, has reviewed, and should review."""
    return learner.card_stats(role(spark, sf_dir, "cards"), _state(spark, sf_dir), F.lit("2024-01-10").cast("date"))


@query("""WITH RECURSIVE o AS (SELECT student_id, topic, correct, row_number() OVER (PARTITION BY student_id, topic ORDER BY seq) AS i FROM {answers}),
f AS (SELECT student_id, topic, i, CAST(CASE correct WHEN 1 THEN 80 ELSE 40 END AS BIGINT) AS m FROM o WHERE i = 1
UNION ALL SELECT o.student_id, o.topic, o.i, CAST(round_even(CAST(f.m * 7 + o.correct * 300 AS DOUBLE) / 10, 0) AS BIGINT) FROM f JOIN o ON o.student_id = f.student_id AND o.topic = f.topic AND o.i = f.i + 1)
SELECT student_id, topic, max_by(m, i) / 100 AS mastery, max(i) AS attempts FROM f GROUP BY ALL""")
def mastery_ema(spark, sf_dir):
    """Topic mastery as an exponential average."""
    return learner.mastery_average(role(spark, sf_dir, "answers"), ["student_id", "topic"], ["seq"])


@query("""WITH RECURSIVE o AS (SELECT student_id, topic, correct, row_number() OVER (PARTITION BY student_id, topic ORDER BY seq) AS i FROM {answers}),
f AS (SELECT student_id, topic, i, CAST(greatest(0.0, least(1.0, 0.5 + CASE correct WHEN 1 THEN 0.15 ELSE -0.15 END)) AS DOUBLE) AS mastery FROM o WHERE i = 1
UNION ALL SELECT o.student_id, o.topic, o.i, greatest(0.0, least(1.0, f.mastery + CASE o.correct WHEN 1 THEN 0.15 ELSE -0.15 END)) FROM f JOIN o ON o.student_id = f.student_id AND o.topic = f.topic AND o.i = f.i + 1),
m AS (SELECT student_id, topic, round_even(max_by(mastery, i), 6) AS mastery, max(i) AS attempts FROM f GROUP BY ALL) SELECT * FROM m WHERE mastery < 0.6""")
def weak_topics(spark, sf_dir):
    """Topics under six tenths, by the additive mastery."""
    m = learner.mastery_steps(role(spark, sf_dir, "answers"), ["student_id", "topic"], ["seq"])
    return learner.weak_topics(m.withColumn("mastery", F.bround("mastery", 6)), by=["student_id", "topic"])


# ---- prerequisites: chapter k needs chapter k DIV 2 -----------------------------

_NODES = "n AS (SELECT DISTINCT book_id, chapter FROM {prereqs} UNION SELECT DISTINCT book_id, prereq_chapter FROM {prereqs}), e AS (SELECT DISTINCT book_id, chapter, prereq_chapter FROM {prereqs} WHERE chapter != prereq_chapter)"


def _graph(spark, sf_dir):
    p = role(spark, sf_dir, "prereqs")
    nodes = p.select("book_id", "chapter").unionByName(p.select("book_id", F.col("prereq_chapter").alias("chapter"))).distinct()
    return nodes, p.where("chapter != prereq_chapter").distinct()


@query(f"""WITH RECURSIVE {_NODES}, l AS (SELECT book_id, chapter, 0 AS level FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.book_id = n.book_id AND e.chapter = n.chapter)
UNION ALL SELECT e.book_id, e.chapter, l.level + 1 FROM l JOIN e ON e.book_id = l.book_id AND e.prereq_chapter = l.chapter) SELECT book_id, chapter, max(level) AS level FROM l GROUP BY ALL""")
def topo_levels(spark, sf_dir):
    """How deep in its book's prerequisites each chapter is."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.levels(nodes, edges, "book_id")


@query(f"WITH {_NODES} SELECT n.book_id, n.chapter, array_to_string(coalesce((SELECT list(prereq_chapter ORDER BY prereq_chapter) FROM e WHERE e.book_id = n.book_id AND e.chapter = n.chapter), []), ',') AS prereqs, array_to_string(coalesce((SELECT list(chapter ORDER BY chapter) FROM e WHERE e.book_id = n.book_id AND e.prereq_chapter = n.chapter), []), ',') AS unlocks FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.book_id = n.book_id AND (e.chapter = n.chapter OR e.prereq_chapter = n.chapter))")
def prerequisite_neighbours(spark, sf_dir):
    """What each chapter needs and what it unlocks."""
    _, edges = _graph(spark, sf_dir)
    return graph.neighbours(edges, ["book_id"]).select("book_id", "chapter", F.array_join("prereqs", ",").alias("prereqs"), F.array_join("unlocks", ",").alias("unlocks"))


def _nodes_with_status(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    n = F.col("chapter").cast("int")
    status = F.when(n % 3 == 0, "weak").when(n % 3 == 1, "pending").otherwise("completed")
    slot = F.when(n <= 17, "T1").when(n <= 33, "T2").otherwise("T3")
    return nodes.select("book_id", "chapter", status.alias("status"), slot.alias("slot"), n.alias("place")), edges


# A book's chapters in the order of preference; each step takes the first that is not done and whose prerequisites are.
_ORDER = f"""WITH RECURSIVE {_NODES},
c AS (SELECT n.book_id, n.chapter, CAST(n.chapter AS INT) AS place, CASE CAST(n.chapter AS INT) % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'pending' ELSE 'completed' END AS status,
  coalesce((SELECT list(prereq_chapter) FROM e WHERE e.book_id = n.book_id AND e.chapter = n.chapter), []::VARCHAR[]) AS needs FROM n),
b AS (SELECT book_id, list({{'chapter': chapter, 'needs': needs}} ORDER BY CASE status WHEN 'weak' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, CASE WHEN place <= 17 THEN 0 WHEN place <= 33 THEN 1 ELSE 2 END, place) AS wanted FROM c GROUP BY book_id),
o AS (SELECT book_id, wanted, []::VARCHAR[] AS done FROM b
  UNION ALL SELECT book_id, wanted, list_append(done, nxt) FROM (SELECT *, list_filter(wanted, lambda x: NOT list_contains(done, x.chapter) AND list_has_all(done, x.needs))[1].chapter AS nxt FROM o) WHERE nxt IS NOT NULL),
d AS (SELECT book_id, max_by(done, len(done)) AS done FROM o GROUP BY book_id),
s AS (SELECT c.*, list_contains(done, chapter) AS reached, CAST(row_number() OVER (PARTITION BY c.book_id ORDER BY coalesce(list_position(done, chapter), 1000000), place) AS INT) AS step FROM c JOIN d USING (book_id))"""


@query(_ORDER + " SELECT book_id, step, chapter, reached FROM s")
def topo_order(spark, sf_dir):
    """The order in which to learn each book's chapters, weak ones first."""
    nodes, edges = _nodes_with_status(spark, sf_dir)
    return graph.learning_order(nodes, edges, "book_id")


@query(_ORDER + """, u AS (SELECT e.book_id, e.chapter, count(*) AS needed, coalesce(string_agg(DISTINCT e.prereq_chapter, ', ' ORDER BY e.prereq_chapter) FILTER (coalesce(p.status, '') <> 'completed'), '') AS unmet FROM e LEFT JOIN c p ON p.book_id = e.book_id AND p.chapter = e.prereq_chapter GROUP BY ALL)
SELECT s.book_id, step, s.chapter, status, CASE WHEN NOT reached THEN 'independent' WHEN status = 'weak' THEN 're-study' WHEN status = 'completed' THEN 'mastered' WHEN needed IS NULL THEN 'begin' WHEN unmet <> '' THEN 'blocked by ' || unmet ELSE 'ready' END AS advice
FROM s LEFT JOIN u ON u.book_id = s.book_id AND u.chapter = s.chapter""")
def learning_advice(spark, sf_dir):
    """Advice for every step of that order."""
    nodes, edges = _nodes_with_status(spark, sf_dir)
    return graph.recommendations(graph.learning_order(nodes, edges, "book_id"), nodes, edges, "book_id")


@query(f"""WITH {_NODES} SELECT book_id, count(*) AS total, count(*) FILTER (CAST(chapter AS INT) % 3 = 2) AS completed, count(*) FILTER (CAST(chapter AS INT) % 3 = 0) AS weak, count(*) FILTER (CAST(chapter AS INT) % 3 = 1) AS pending,
round_even(count(*) FILTER (CAST(chapter AS INT) % 3 = 2) * 100.0::DOUBLE / count(*), 1) AS readiness FROM n GROUP BY book_id""")
def readiness(spark, sf_dir):
    """Chapters by status, and how much of a book is done."""
    return graph.readiness(_nodes_with_status(spark, sf_dir)[0], "book_id")


@query("SELECT book_id, chapter, slot FROM (SELECT book_id, chapter, CASE WHEN i <= greatest(1, round_even(n / 3, 0)) THEN 'T1' WHEN i <= greatest(greatest(1, round_even(n / 3, 0)) + 1, round_even(2 * n / 3, 0)) THEN 'T2' ELSE 'T3' END AS slot FROM (SELECT book_id, chapter, row_number() OVER (PARTITION BY book_id ORDER BY m) AS i, count(*) OVER (PARTITION BY book_id) AS n FROM (SELECT book_id, chapter, min(id) AS m FROM {chunks} GROUP BY ALL))) WHERE slot = 'T1'")
def syllabus_view(spark, sf_dir):
    """The first midterm's chapters of every book, by default thirds."""
    from loreforge.operators import activity

    c = exam.partition_thirds(activity.chapters(role(spark, sf_dir, "chunks")), ["book_id"], ["place"])
    return exam.slot_view(c, "T1").select("book_id", "chapter", "slot")
