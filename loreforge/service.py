"""The application's requests as functions from its tables to DataFrames, one for each route.

Nothing here writes: requests that change tables return the tables' next states.
``now`` and seeds are parameters.  A missing key raises KeyError, a state conflict or
a bad argument ValueError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreforge.functions import scores, text
from loreforge.operators import activity, exam, generation, graph, learner, search, upserts
from loreforge.sources import catalog
from loreforge.storage import written


@dataclass
class Library:
    """The application's tables (see ``sources.catalog.TABLES``); those not given are empty.

    ``index``: a folder for the keyword index of all books, which is then built once; without it each search builds its own.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    index: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else catalog.empty(self.spark, name)

    # ---- reading aids

    def _scoped(self, df: DataFrame, book: str | None, chapter: str | None = None) -> DataFrame:
        if book:
            df = df.where(F.col("book_id") == book.upper())
        if chapter and chapter.startswith("exam:"):
            slots = {"T1": ["T1"], "T2": ["T2"], "T1+T2": ["T1", "T2"], "T1_PLUS_T2": ["T1", "T2"]}.get(chapter[5:].upper())
            if slots is None:
                return df
            some = self["syllabus_exam_map"].where(F.col("exam_slot").isin(slots)).select("book_id", "chapter")
            return df.join(some, ["book_id", "chapter"], "left_semi")
        return df.where(F.col("chapter") == chapter.strip()) if chapter else df

    def _questions(self, book: str | None = None, chapter: str | None = None, qtype: str | None = "mcq") -> DataFrame:
        """Verified questions with their chunk's place."""
        c = self._scoped(self["chunks"].select("chunk_id", "book_id", "chapter", "chapter_title", "section", "page_start"), book, chapter)
        q = self["question_bank"].where("verified")
        return (q.where(F.col("qtype") == qtype) if qtype else q).withColumnRenamed("id", "question_id").join(c, "chunk_id")

    def _slots(self, book: str) -> DataFrame:
        """book_id, chapter, slot, position of a book: as assigned, or thirds if nothing is."""
        given = self["syllabus_exam_map"].where(F.col("book_id") == book.upper()).select("book_id", "chapter", F.col("exam_slot").alias("slot"), "position")
        if not given.isEmpty():
            return given
        return exam.partition_thirds(activity.chapters(self._scoped(self["chunks"], book)), ["book_id"], ["place"]).select("book_id", "chapter", "slot", "position")

    def _chapters(self, book: str) -> DataFrame:
        return activity.chapters(self._scoped(self["chunks"], book)).join(self._slots(book), ["book_id", "chapter"], "left")

    def _one(self, name: str, id: int):
        row = self[name].where(F.col("id") == id).first()
        if row is None:
            raise KeyError(f"{name}: {id}")
        return row

    # ---- books and search

    def health(self) -> DataFrame:
        return self["chunks"].agg(F.count("*").alias("chunks"))

    def search(self, question: str, vector: list[float] | None, k: int = 5, book: str | None = None, stemmed: bool = True) -> DataFrame:
        """Hits with rank, score, similarity, found_by, pages and location; none for a blank question."""
        c = self["chunks"]
        if not question.strip():
            return c.limit(0)
        k = min(max(k, 1), 15)
        q = self.spark.createDataFrame([(0, vector, book.upper() if book else None)], "qid int, q array<float>, want string")
        vec = search.vector_topk(c, q, search.POOL, id="id", book="book_id", mode="overfetch") if vector else c.limit(0).select("id", F.lit(0).alias("rank"))
        scope = self._scoped(c, book)
        columns = {"text": F.coalesce("text", F.lit("")), "breadcrumb": F.coalesce("breadcrumb", F.lit(""))}
        if self.index and not book:
            index, sizes = search.keyword_index(c, columns, f"{self.index}/{'stems' if stemmed else 'words'}", id="id", stemmed=stemmed)
        else:
            index = search.postings(scope, columns, id="id", stemmed=stemmed)
            sizes = index.groupBy("id").agg(F.count("*").alias("n"))
        hits = search.fuse(vec, search.bm25(index, sizes, search.query_phrases(question, stemmed), search.POOL, id="id"), k, id="id")
        hits = search.with_similarity(hits, c, q, id="id") if vector else hits.withColumn("similarity", F.lit(0.0))
        pages = text.page_label(F.col("page_start"), F.col("page_end"))
        where = text.location(F.coalesce("book_title", "book_id"), F.col("chapter"), F.col("chapter_title"), F.col("section"), F.col("section_title"), pages)
        out = c.drop("embedding").join(F.broadcast(hits), "id")  # at most 15
        return out.withColumns({"pages": pages, "location": where, "similarity": F.bround("similarity", 4), "score": F.bround("score", 5)})

    def ask(self, question: str, vector: list[float], model: Callable[[str], str], k: int = 5, book: str | None = None) -> DataFrame:
        """answer, cited, used_model: from the hits if the best is similar enough."""
        hits = search.answerable(self.search(question, vector, k, book))
        body = search.context(hits, "location", "text").first().context
        if not body:
            return self.spark.createDataFrame([("", [], False)], "answer string, cited array<int>, used_model boolean")
        reply = model(f"<context>\n{body}\n</context>\n\nQuestion: {question.strip()}")
        return search.cite(self.spark.createDataFrame([(reply.strip(), True)], "answer string, used_model boolean")).select("answer", "cited", "used_model")

    def chapters(self, book: str) -> DataFrame:
        return activity.chapters(self._scoped(self["chunks"], book)).orderBy("place")

    # ---- questions and flashcards

    def generate_questions(self, write, verify, *, book: str | None, chapter: str | None, qtype: str, count: int, level: str, seed: str) -> DataFrame:
        chunks = generation.pick(self._scoped(self["chunks"], book, chapter), self["question_bank"], generation.chunks_needed(count), seed=seed)
        return generation.generate(chunks, write, verify, qtype=qtype, level=level, count=count)

    def questions(self, book: str | None = None, chapter: str | None = None, qtype: str | None = None, limit: int = 50, answers: bool = False) -> DataFrame:
        out = self._questions(book, chapter, qtype).orderBy(F.desc("question_id")).limit(min(max(limit, 1), 200))
        return out if answers else exam.public(out)

    def generate_flashcards(self, write, verify, *, book: str | None, chapter: str | None, count: int, seed: str) -> DataFrame:
        used = self["flashcards"].select("chunk_id")
        chunks = generation.pick(self._scoped(self["chunks"], book, chapter), used, generation.chunks_needed(count, flashcards=True), seed=seed)
        cards = generation.generate(chunks, write, verify, qtype="short", level="medium", count=count)
        return cards.select("chunk_id", F.col("question").alias("front"), F.col("answer").alias("back"))

    def flashcards(self, book: str | None = None, chapter: str | None = None, limit: int = 100) -> DataFrame:
        c = self["chunks"].select("chunk_id", "book_id", "chapter", "chapter_title", "section", "page_start")
        return self._scoped(self["flashcards"].join(c, "chunk_id", "left"), book, chapter).orderBy(F.desc("id")).limit(min(max(limit, 1), 500))

    def due_flashcards(self, student: str, now: date, book: str | None = None, chapter: str | None = None, limit: int = 50) -> DataFrame:
        cards = self.flashcards(book, chapter, 500).withColumnRenamed("id", "card_id")
        mine = self["student_cards"].where(F.col("student_id") == student).drop("student_id")
        return learner.due_cards(cards, mine, F.lit(now), limit=min(max(limit, 1), 500))

    def review_flashcard(self, student: str, card: int, known: bool, now: date) -> DataFrame:
        """The next ``student_cards``."""
        start = self.spark.createDataFrame([(student, card)], "student_id string, card_id long")
        had = start.join(self["student_cards"], ["student_id", "card_id"], "left")
        ease, days, reps = F.coalesce("ease", F.lit(2.5)), F.coalesce("interval_days", F.lit(0)), F.coalesce("reps", F.lit(0)) + 1
        if known:
            new = {"interval_days": F.when(reps == 1, 1).when(reps == 2, 3).otherwise(F.greatest(F.lit(1), F.bround(days * ease, 0))).cast("int"), "ease": F.least(F.lit(3.0), ease + 0.1), "reps": reps}
        else:
            new = {"interval_days": F.lit(1), "ease": F.greatest(F.lit(1.3), ease - 0.2), "reps": F.lit(0)}
        row = had.withColumns(new).withColumn("due_date", F.date_add(F.lit(now), F.col("interval_days")))
        return upserts.replace(self["student_cards"], row, ["student_id", "card_id"])

    def flashcard_stats(self, student: str, now: date, book: str | None = None) -> DataFrame:
        cards = self._scoped(self["flashcards"].join(self["chunks"].select("chunk_id", "book_id", "chapter"), "chunk_id", "left"), book).withColumnRenamed("id", "card_id")
        return learner.card_stats(cards, self["student_cards"].where(F.col("student_id") == student), F.lit(now))

    # ---- adaptive sessions

    def start_session(self, student: str, book: str, chapter: str | None = None, questions: int = 10) -> DataFrame:
        """The new session: its id follows the largest, its ability is the learner's mean."""
        mine = self._scoped(self["adaptive_mastery"].where(F.col("student_id") == student), book, None)
        mine = mine.where(F.col("chapter") == chapter.strip()) if chapter else mine
        theta = mine.agg(F.coalesce(F.avg("theta"), F.lit(scores.START)).alias("theta"))
        top = self["adaptive_sessions"].agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
        return top.join(theta, F.lit(True)).select("id", F.lit(student).alias("student_id"), F.lit(book.upper()).alias("book_id"), F.lit(chapter).alias("chapter"), F.lit(questions).alias("max_questions"), "theta")

    def next_question(self, session: int) -> DataFrame:
        """What to ask next, with its gap to the target and whether new questions should be generated; no rows if nothing is left."""
        s = self._one("adaptive_sessions", session)
        asked = self["adaptive_answers"].where(F.col("session_id") == session).select("question_id")
        pool = self._questions(s.book_id, s.chapter).join(asked, "question_id", "left_anti").withColumn("scope", F.lit(s.book_id))
        mine = self["adaptive_sessions"].where(F.col("student_id") == s.student_id).select(F.col("id").alias("session_id"))
        seen = self["adaptive_answers"].join(mine, "session_id", "left_semi").select(F.lit(session).cast("long").alias("session"), "question_id")
        who = self.spark.createDataFrame([(session, s.theta, s.book_id)], "session long, theta double, scope string")
        pick = learner.needs_generation(learner.next_item(who, pool, seen, by="session"))
        return exam.public(pool.drop("difficulty", "scope")).join(F.broadcast(pick), "question_id")  # one row

    def answer(self, session: int, question: int, letter: str) -> dict[str, DataFrame]:
        """The session's next answers and row, and the learner's next mastery."""
        s = self._one("adaptive_sessions", session)
        if s.finished_at is not None:
            raise ValueError("session already finished")
        if s.current_question_id != question:
            raise ValueError("this is not the question currently asked in this session")
        q = self._questions(qtype=None).where(F.col("question_id") == question).first()
        if q is None:
            raise ValueError("this question was retired")
        log = self["adaptive_answers"].where(F.col("session_id") == session)
        n = log.count()
        right = letter.strip().upper()[:1] == (q.answer or "").strip().upper()[:1]
        top = self["adaptive_answers"].agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        old = F.lit(s.theta)
        after = scores.step(old, F.lit(q.difficulty), F.lit(int(right)), F.lit(n))
        key = (F.col("student_id") == s.student_id) & (F.col("book_id") == s.book_id) & (F.col("chapter") == (q.chapter or ""))
        had = self["adaptive_mastery"].where(key).first()
        m = (had.theta, had.attempts, had.correct) if had else (scores.START, 0, 0)
        new = self.spark.createDataFrame([(top + 1, session, question, n + 1, letter.strip().upper()[:1], int(right))], "seq long, session_id long, question_id long, position int, answer_given string, correct int")
        new = new.withColumns({"theta_before": old, "theta_after": after, "time_ms": F.lit(None).cast("int"), "mastery_before": F.lit(m[0])})
        mastery = self.spark.createDataFrame([(s.student_id, s.book_id, q.chapter or "", m[1] + 1, m[2] + int(right))], "student_id string, book_id string, chapter string, attempts int, correct int")
        mastery = mastery.withColumns({"theta": scores.step(F.lit(m[0]), F.lit(q.difficulty), F.lit(int(right)), F.lit(m[1])), "updated_at": F.lit(None).cast("timestamp")})
        done = n + 1 >= s.max_questions
        here = F.col("id") == session
        rows = upserts.update_where(self["adaptive_sessions"], here, {"theta": after, "current_question_id": F.lit(None).cast("long")})
        rows = rows.withColumn("finished", F.when(here, F.lit(done)).otherwise(F.col("finished_at").isNotNull()))
        return {"adaptive_answers": self["adaptive_answers"].unionByName(new), "adaptive_mastery": upserts.replace(self["adaptive_mastery"], mastery, ["student_id", "book_id", "chapter"]), "adaptive_sessions": rows}

    def session_summary(self, session: int) -> DataFrame:
        """By chapter: asked, correct, accuracy, weak; weakest first."""
        self._one("adaptive_sessions", session)
        q = self["question_bank"].select(F.col("id").alias("question_id"), "chunk_id").join(self["chunks"].select("chunk_id", "chapter", "chapter_title"), "chunk_id", "left")
        a = self["adaptive_answers"].where(F.col("session_id") == session).join(q, "question_id")
        return learner.chapter_summary(a, ["chapter", "chapter_title"]).orderBy("accuracy")

    def ability_trend(self, session: int) -> DataFrame:
        return self["adaptive_answers"].where(F.col("session_id") == session).orderBy("position").select("position", F.bround("theta_after", 3).alias("ability"))

    def current_question(self, session: int) -> DataFrame:
        s = self._one("adaptive_sessions", session)
        if s.finished_at is not None:
            raise ValueError("session already finished")
        return exam.public(self._questions(qtype=None).where(F.col("question_id") == (s.current_question_id or -1)))

    def progress(self, student: str, book: str | None = None) -> DataFrame:
        titles = activity.first_titles(self["chunks"], ["book_id", "chapter"])
        m = self._scoped(self["adaptive_mastery"].where(F.col("student_id") == student), book).join(titles, ["book_id", "chapter"], "left")
        return m.withColumn("level", scores.learner_level(F.col("theta"))).withColumn("theta", F.bround("theta", 3)).orderBy("theta")

    def flag_question(self, question: int) -> dict[str, DataFrame]:
        """Retires a question: its answers go, and the sessions and masteries that had it are replayed."""
        self._one("question_bank", question)
        log = self["adaptive_answers"]
        bad = log.where(F.col("question_id") == question)
        place = self["question_bank"].select(F.col("id").alias("question_id"), "difficulty", "chunk_id").join(self["chunks"].select("chunk_id", "chapter"), "chunk_id", "left")
        owner = self["adaptive_sessions"].select(F.col("id").alias("session_id"), "student_id", "book_id")
        full = log.join(owner, "session_id").join(place, "question_id").withColumn("chapter", F.coalesce("chapter", F.lit("")))
        touched = bad.select("session_id").distinct()
        starts = log.join(touched, "session_id").groupBy("session_id").agg(F.min_by("theta_before", "position").alias("start"))
        rest = full.where(F.col("question_id") != question)
        redo = rest.join(starts, "session_id").withColumn("at", F.col("position"))
        trail = learner.trail(redo, ["session_id", "start"], ["at", "question_id"], start=F.col("start")).drop("at", "start")
        keep = upserts.delete_where(log, F.col("question_id") == question).join(trail.toDF("session_id", "question_id", "p", "b", "a"), ["session_id", "question_id"], "left")
        answers = keep.withColumns({"position": F.coalesce(F.col("p").cast("int"), "position"), "theta_before": F.coalesce("b", "theta_before"), "theta_after": F.coalesce("a", "theta_after")}).select(*log.columns)
        keys = ["student_id", "book_id", "chapter"]
        hit = full.where(F.col("question_id") == question).select(*keys).distinct()
        again = learner.ability(rest.join(hit, keys, "left_semi"), keys, ["seq"])
        stay = self["adaptive_mastery"].join(hit, keys, "left_anti")
        again = again.select(*keys, "theta", F.col("attempts").cast("int").alias("attempts"), F.col("correct").cast("int").alias("correct"), F.lit(None).cast("timestamp").alias("updated_at"))
        questions = upserts.update_where(self["question_bank"], F.col("id") == question, {"verified": F.lit(False)})
        return {"question_bank": questions, "adaptive_answers": answers, "adaptive_mastery": stay.unionByName(again)}

    def bank(self, book: str, chapter: str | None = None) -> DataFrame:
        return exam.level_counts(self._questions(book, chapter), ["book_id"])

    def prefill_plan(self, book: str, quota: int, chapter: str | None = None) -> DataFrame:
        """How many questions of each level are to be generated."""
        return learner.deficits(self.bank(book, chapter), quota)

    def prefill(self, write, verify, *, book: str, quota: int, chapter: str | None = None, seed: str, at_once: int = 8, patience: int = 2) -> tuple[DataFrame | None, dict[str, int]]:
        """Questions generated until every level has its quota (None if none came), and how many each level still lacks.

        A level is given up after ``patience`` rounds that bring nothing.  What a round has
        brought is written, as a model wouldn't say the same again.
        """
        plan = self.prefill_plan(book, quota, chapter).first()
        lacks = {level: plan[level] if plan else quota for level in scores.DIFFICULTY}
        chunks, used, made = self._scoped(self["chunks"], book, chapter), self["question_bank"].select("chunk_id"), []
        for level in lacks:
            rounds = idle = 0
            while lacks[level] > 0 and idle < patience:
                want = min(lacks[level], at_once)
                some = generation.pick(chunks, used, generation.chunks_needed(want), seed=f"{seed}/{level}/{rounds}")
                got = written(generation.generate(some, write, verify, level=level, count=want), "prefill")
                n = got.count()
                rounds, idle, lacks[level] = rounds + 1, idle + (n == 0), lacks[level] - n
                if n:
                    made.append(got)
                    used = used.unionAll(got.select("chunk_id"))
        return (reduce(DataFrame.unionByName, made) if made else None), lacks

    # ---- dashboards

    def subjects(self) -> DataFrame:
        books = activity.books(self["chunks"], self["extracted_images"])
        fallback = self["topic_mastery"].select(F.upper(F.regexp_extract("topic_id", "^([A-Za-z]+)", 1)).alias("book_id"), F.col("mastery_score").alias("mastery"))
        return books.join(activity.subject_progress(self["adaptive_mastery"], fallback, "book_id"), "book_id", "left").fillna(0, ["progress"])

    def subject(self, book: str) -> DataFrame:
        return self.chapters(book)

    def _logs(self) -> list[tuple[DataFrame, str]]:
        return [(self["adaptive_sessions"], "started_at"), (self["mock_exams"], "started_at")]

    def overview(self, now: date) -> DataFrame:
        """One row of totals: answers, accuracy, exams, cards, mastered topics, streak."""
        answers = self["adaptive_answers"].agg(F.count("*").alias("asked"), F.sum("correct").alias("correct"))
        items = self["mock_exam_items"].where("answer_given is not null").agg(F.count("*").alias("asked"), F.count_if(F.col("marks_awarded") > 0).alias("correct"))
        quiz = self["quiz_attempts"].agg(F.count("*").alias("asked"), F.count_if(F.col("is_correct")).alias("correct"))
        total = activity.totals([answers, items, quiz])
        topics = self["chunks"].where("chapter is not null and chapter != ''").agg(F.countDistinct("book_id", "chapter").alias("topics"))
        done = self["adaptive_mastery"].where("theta >= 0.55").agg(F.countDistinct("book_id", "chapter").alias("mastered"))
        due = self["student_cards"].agg(F.count_if(F.col("due_date") <= F.lit(now)).alias("cards_due"))
        everyone = [(df.withColumn("one", F.lit(1)), ts) for df, ts in self._logs()]
        run = activity.streaks(activity.active_days(everyone, ["one"]), ["one"], F.lit(now)).agg(F.coalesce(F.max("streak"), F.lit(0)).alias("streak"))
        out = total
        for part in (topics, done, due, run):
            out = out.join(part, F.lit(True))
        return out.withColumn("progress", scores.percentage(F.col("mastered"), F.col("topics")))

    def weekday_activity(self) -> DataFrame:
        return activity.by_weekday(activity.daily(self._logs()))

    def focus_areas(self, n: int = 4) -> DataFrame:
        titles = activity.first_titles(self["chunks"], ["book_id", "chapter"])
        practised = activity.focus(self["adaptive_mastery"], titles, ["book_id", "chapter"]).select("book_id", "chapter", "name", "score", "attempts", "status")
        needed = self["chapter_prereqs"].select("book_id", F.col("prereq_chapter").alias("chapter")).distinct().join(titles, ["book_id", "chapter"], "left")
        rest = needed.select("book_id", "chapter", F.coalesce("title", F.concat(F.lit("Chapter "), "chapter")).alias("name"), F.lit(0.0).alias("score"), F.lit(0).alias("attempts"), F.lit("Foundational Prerequisite").alias("status"))
        return activity.fill_up(practised, rest, n, ["book_id", "chapter"], [F.asc("score"), F.desc("attempts"), text.leading_integer(F.col("chapter"))])

    def mastery(self, n: int = 8) -> DataFrame:
        """Practised topics, strongest first, filled up with chapters not yet begun."""
        place = activity.chapters(self["chunks"]).select("book_id", "chapter", "title", "place")
        done = self["adaptive_mastery"].join(place, ["book_id", "chapter"], "left").select("book_id", "chapter", "title", F.bround(F.col("theta") * 100, 0).cast("int").alias("score"), "attempts", "place")
        rest = place.select("book_id", "chapter", "title", F.lit(0).alias("score"), F.lit(0).alias("attempts"), "place")
        return activity.fill_up(done, rest, max(n, done.count()), ["book_id", "chapter"], [F.desc("score"), F.asc("place")]).drop("place")

    def record_attempt(self, student: int, topic: str, right: bool) -> DataFrame:
        """The next ``topic_mastery``."""
        new = self.spark.createDataFrame([(student, topic, topic, 0.8 if right else 0.4, 1)], "student_id long, topic_id string, topic_name string, mastery_score double, attempts_count int").withColumn("last_evaluated", F.lit(None).cast("timestamp"))
        score = F.bround(F.bround(scores.clamp(F.col("old.mastery_score") * 0.7 + (0.3 if right else 0.0), 0.0, 1.0), 9), 2)
        return upserts.merge(self["topic_mastery"], new, ["student_id", "topic_id"], {"mastery_score": score, "attempts_count": F.col("old.attempts_count") + 1, "last_evaluated": None})

    def history(self, limit: int = 20) -> DataFrame:
        return self["quiz_attempts"].orderBy(F.desc("id")).limit(limit)

    def resources(self) -> DataFrame:
        return activity.books(self["chunks"], self["extracted_images"])

    def figures(self, book: str | None = None, limit: int = 50) -> DataFrame:
        return self._scoped(self["extracted_images"], book).orderBy("book_id", "page_number", "image_id").limit(min(max(limit, 1), 500))

    def profile(self, username: str) -> DataFrame:
        want = self.spark.createDataFrame([(username,)], "username string")
        return upserts.get_or_create(self["students"], want, ["username"], {"name": F.lit("Student Account")})

    def update_profile(self, username: str, values: dict[str, str]) -> DataFrame:
        return upserts.update_where(self["students"], F.col("username") == username, {k: F.lit(v) for k, v in values.items()})

    def system(self) -> DataFrame:
        return catalog.describe(self.tables)

    # ---- syllabus, prerequisites, exams

    def syllabus(self, book: str) -> DataFrame:
        """Chapters by slot, and how many."""
        return self._chapters(book).groupBy("slot").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("place", "chapter"))), lambda x: x["chapter"]).alias("chapters"))

    def syllabus_view(self, book: str, view: str) -> DataFrame:
        return exam.slot_view(self._chapters(book), view).orderBy("place")

    def assign_slot(self, book: str, chapter: str, slot: str) -> DataFrame:
        """The next ``syllabus_exam_map``; the chapter goes to the slot's end."""
        if slot.upper() not in exam.SLOTS:
            raise ValueError(f"no such slot: {slot}")
        n = self["syllabus_exam_map"].where((F.col("book_id") == book.upper()) & (F.col("exam_slot") == slot.upper())).count()
        new = self.spark.createDataFrame([(book.upper(), chapter.strip(), slot.upper(), n)], "book_id string, chapter string, exam_slot string, position int").withColumn("updated_at", F.lit(None).cast("timestamp"))
        return upserts.replace(self["syllabus_exam_map"], new, ["book_id", "chapter"])

    def assign_slots(self, book: str, slots: list[tuple[str, str]]) -> DataFrame:
        """The next ``syllabus_exam_map``: the book's assignments are replaced, in order."""
        if any(s.upper() not in exam.SLOTS for _, s in slots):
            raise ValueError("a slot is none of " + ", ".join(exam.SLOTS))
        new = self.spark.createDataFrame([(book.upper(), c.strip(), s.upper(), i) for i, (c, s) in enumerate(slots)], "book_id string, chapter string, exam_slot string, place int")
        at = (F.row_number().over(Window.partitionBy("exam_slot").orderBy("place")) - 1).cast("int")
        new = new.withColumns({"position": at, "updated_at": F.lit(None).cast("timestamp")}).drop("place")
        return upserts.delete_where(self["syllabus_exam_map"], F.col("book_id") == book.upper()).unionByName(new)

    def reset_slots(self, book: str) -> DataFrame:
        """The next ``syllabus_exam_map``: the book in thirds."""
        thirds = exam.partition_thirds(activity.chapters(self._scoped(self["chunks"], book)), ["book_id"], ["place"])
        new = thirds.select("book_id", "chapter", F.col("slot").alias("exam_slot"), F.col("position").cast("int").alias("position"), F.lit(None).cast("timestamp").alias("updated_at"))
        return upserts.delete_where(self["syllabus_exam_map"], F.col("book_id") == book.upper()).unionByName(new)

    def _topics(self, book: str, student: str) -> DataFrame:
        m = self._scoped(self["adaptive_mastery"].where(F.col("student_id") == student), book).select("book_id", "chapter", "theta", "attempts", "correct")
        c = self._chapters(book).join(m, ["book_id", "chapter"], "left")
        status = scores.topic_status(F.bround("theta", 2), F.col("attempts"), F.col("correct"))
        return c.withColumn("status", status).withColumn("slot", F.coalesce("slot", F.lit("T1")))

    def prerequisites(self, book: str, student: str) -> dict[str, DataFrame]:
        """nodes with status and neighbours, the learning sequence with advice, and the readiness."""
        edges = self._scoped(self["chapter_prereqs"], book)
        nodes = self._topics(book, student)
        order = graph.learning_order(nodes, edges, "book_id")
        return {"nodes": nodes.join(graph.neighbours(edges, ["book_id"]), ["book_id", "chapter"], "left"), "sequence": graph.recommendations(order, nodes, edges, "book_id"), "summary": graph.readiness(nodes, "book_id")}

    def create_exam(self, book: str, kind: str = "T3", n: int = 30, *, seed: str) -> DataFrame:
        """The exam's questions, without answers."""
        pool = self._questions(book).join(self._slots(book).select("book_id", "chapter", "slot"), ["book_id", "chapter"], "left")
        out = exam.stratified(pool, n, exam=kind.upper(), seed=seed)
        if out.isEmpty():
            raise ValueError(f"no questions for {book}")
        return exam.public(out)

    def exam(self, exam_id: int) -> DataFrame:
        """An exam's questions; answers only once it is submitted."""
        e = self._one("mock_exams", exam_id)
        items = self["mock_exam_items"].where(F.col("exam_id") == exam_id)
        q = self["question_bank"].withColumnRenamed("id", "question_id")
        return exam.public(items.join(q, "question_id"), reveal=F.lit(e.submitted_at is not None)).orderBy("position")

    def submit_exam(self, exam_id: int, answers: dict[str, str]) -> dict[str, DataFrame]:
        """items graded, the result, accuracy by tier, and what to revise."""
        e = self._one("mock_exams", exam_id)
        given = F.create_map(*[F.lit(x) for kv in answers.items() for x in kv]) if answers else F.create_map().cast("map<string,string>")
        q = self["question_bank"].select(F.col("id").alias("question_id"), "question", "answer", "explanation", "chunk_id")
        place = self["chunks"].select("chunk_id", "book_id", "chapter")
        items = self["mock_exam_items"].where(F.col("exam_id") == exam_id).select("exam_id", "question_id", "position").join(q, "question_id").join(place, "chunk_id", "left")
        items = items.join(self._slots(e.book_id).select("book_id", "chapter", "slot"), ["book_id", "chapter"], "left")
        graded = exam.graded(items.withColumn("given", exam.given_answer(given, F.col("question_id"), F.col("position"))))
        prereqs = self._scoped(self["chapter_prereqs"], e.book_id).select("chapter", "prereq_chapter").distinct()
        return {"items": graded, "result": exam.results(graded, ["exam_id"]), "tiers": exam.tier_accuracy(graded, ["exam_id"]), "revise": exam.missed_prerequisites(graded, prereqs, ["exam_id"])}

    def exams(self, student: str, book: str | None = None, limit: int = 50) -> DataFrame:
        out = self["mock_exams"].where(F.col("student_id") == student)
        out = out.where(F.col("book_id") == book.upper()) if book else out
        return out.withColumn("percentage", F.when(F.col("total_questions") > 0, scores.percentage(F.col("score"), F.col("total_questions")))).orderBy(F.desc("id")).limit(limit)

