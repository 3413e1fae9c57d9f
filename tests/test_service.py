"""Every request once over a small library, and the states that it must refuse."""

import datetime
import math

import pytest

from loreforge.service import Library
from loreforge.sources import catalog

NOW = datetime.date(2024, 1, 10)
TOPICS = ["red black tree balance", "hash table probing", "dynamic programming memo", "graph search queue"]


@pytest.fixture(scope="module")
def library(spark):
    def table(name, rows):
        names = [c.split()[0] for c in catalog.TABLES[name].split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], catalog.TABLES[name]).cache()

    vec = lambda a: [math.cos(a), math.sin(a)]
    chunks = [dict(id=i, chunk_id=f"c{i}", book_id="DS", book_title="Data", breadcrumb="Data", chapter=str(i % 6 + 1), chapter_title=f"T{i % 6 + 1}", section="", page_start=i + 1, page_end=i + 1 + i % 2, text=TOPICS[i % 4] + f" {i} " + "words about it " * 60, embedding=vec(i / 10)) for i in range(12)]
    questions = [dict(id=i, chunk_id=f"c{i}", qtype="mcq", question=f"q{i}", options=["a", "b", "c", "d"], answer="ABCD"[i % 4], explanation="e", difficulty=(i + 1) / 13, marks=1, verified=i != 11) for i in range(12)]
    sessions = [dict(id=1, student_id="s", book_id="DS", max_questions=3, theta=0.5, started_at=datetime.datetime(2024, 1, 9, 5), current_question_id=3), dict(id=2, student_id="s", book_id="DS", max_questions=2, theta=0.6, started_at=datetime.datetime(2024, 1, 10, 5), finished_at=datetime.datetime(2024, 1, 10, 6))]
    answers = [dict(seq=1, session_id=2, question_id=4, position=1, answer_given="A", correct=1, theta_before=0.5, theta_after=0.6), dict(seq=2, session_id=2, question_id=5, position=2, answer_given="A", correct=0, theta_before=0.6, theta_after=0.55)]
    mastery = [dict(student_id="s", book_id="DS", chapter="5", theta=0.6, attempts=1, correct=1), dict(student_id="s", book_id="DS", chapter="6", theta=0.3, attempts=1, correct=0)]
    return Library(
        spark,
        {
            "chunks": table("chunks", chunks), "question_bank": table("question_bank", questions), "adaptive_sessions": table("adaptive_sessions", sessions), "adaptive_answers": table("adaptive_answers", answers), "adaptive_mastery": table("adaptive_mastery", mastery),
            "chapter_prereqs": table("chapter_prereqs", [dict(book_id="DS", chapter=str(i), prereq_chapter=str(i // 2)) for i in range(2, 7)]), "flashcards": table("flashcards", [dict(id=i, chunk_id=f"c{i}", front="f", back="b") for i in range(3)]),
            "student_cards": table("student_cards", [dict(student_id="s", card_id=0, ease=2.5, interval_days=3, reps=2, due_date=datetime.date(2024, 1, 20))]), "mock_exams": table("mock_exams", [dict(id=1, student_id="s", book_id="DS", total_questions=4, started_at=datetime.datetime(2024, 1, 8))]),
            "mock_exam_items": table("mock_exam_items", [dict(exam_id=1, question_id=i, position=i + 1) for i in range(4)]), "students": table("students", [dict(id=1, username="s", name="S")]), "quiz_attempts": table("quiz_attempts", [dict(id=1, student_id=1, is_correct=True)]),
            "extracted_images": table("extracted_images", [dict(image_id="i", book_id="DS", page_number=1)]), "topic_mastery": table("topic_mastery", [dict(student_id=1, topic_id="ds_1", topic_name="t", mastery_score=0.5, attempts_count=1)]),
        },
    )


def test_search_and_ask(library):
    hits = library.search("What is a red black tree?", [1.0, 0.0], 3).orderBy("rank").collect()
    assert [h.rank for h in hits] == [1, 2, 3] and hits[0].id == 0 and hits[0].found_by == "vector+keyword"
    assert hits[0].location == "Data > Chapter 1: T1 > p. 1"
    assert library.search(" ", [1.0, 0.0]).count() == 0 and library.search("tree", [1.0, 0.0], book="X").count() == 0
    got = library.ask("red black tree", [1.0, 0.0], lambda prompt: "It is [1][2]. " + str("red black" in prompt)).first()
    assert (got.answer, got.cited, got.used_model) == ("It is [1][2]. True", [1, 2], True)
    assert not library.ask("red black tree", [0.0, -1.0], lambda prompt: "never").first().used_model


def test_lists(library):
    assert library.health().first().chunks == 12
    assert [r.chapter for r in library.chapters("ds").collect()] == list("123456")
    assert library.questions("DS").columns.count("answer") == 0 and library.questions("DS", answers=True).count() == 11
    assert [r.question_id for r in library.questions("DS", "2").collect()] == [7, 1]
    assert library.flashcards("DS").count() == 3
    assert [r.card_id for r in library.due_flashcards("s", NOW).collect()] == [1, 2]
    assert tuple(library.flashcard_stats("s", NOW).first()) == (3, 1, 2, 2)
    b = library.bank("DS").first()
    assert b.easy + b.medium + b.hard == 11
    p = library.prefill_plan("DS", 5).first()
    assert (p.easy, p.medium, p.hard) == tuple(max(5 - x, 0) for x in (b.easy, b.medium, b.hard))


def test_generate(library):
    reply = '{"questions": [{"question": "what is it?", "options": ["p", "q", "r", "s"], "answer": "A", "explanation": ""}]}'
    assert library.generate_questions(lambda body: reply, lambda body, asked: {0}, book="DS", chapter=None, qtype="mcq", count=2, level="hard", seed="x").count() == 2
    assert library.generate_flashcards(lambda body: reply, lambda body, asked: {0}, book="DS", chapter="4", count=3, seed="x").first().front == "What is it?"
    assert library.generate_questions(lambda body: reply, lambda body, asked: {0}, book="NONE", chapter=None, qtype="mcq", count=2, level="hard", seed="x").count() == 0


def test_prefill_fills_levels_and_gives_up(library):
    """Rounds go on until a level has its quota; two that bring nothing end it."""
    reply = '{"questions": [{"question": "what is it?", "options": ["p", "q", "r", "s"], "answer": "A", "explanation": ""}]}'
    b = library.bank("DS").first()
    made, lacks = library.prefill(lambda body: reply, lambda body, asked: {0}, book="DS", quota=6, seed="x", at_once=2)
    assert set(lacks.values()) == {0} and {r.difficulty: r["count"] for r in made.groupBy("difficulty").count().collect()} == {d: 6 - n for d, n in ((0.3, b.easy), (0.5, b.medium), (0.8, b.hard)) if n < 6}
    made, lacks = library.prefill(lambda body: "no", lambda body, asked: {0}, book="DS", quota=6, seed="x")
    assert made is None and lacks == {"easy": 6 - b.easy, "medium": 6 - b.medium, "hard": 6 - b.hard}


def test_index_is_built_once(library, tmp_path):
    kept = Library(library.spark, library.tables, index=f"file://{tmp_path}/index")
    want = [(r.id, r.score) for r in library.search("red black tree", [1.0, 0.0], 5).orderBy("rank").collect()]
    for _ in range(2):
        assert [(r.id, r.score) for r in kept.search("red black tree", [1.0, 0.0], 5).orderBy("rank").collect()] == want
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    kept.search("hash table", [1.0, 0.0], 5).collect()
    assert files == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} and files


def test_cards(library):
    state = {r.card_id: r for r in library.review_flashcard("s", 0, True, NOW).collect()}
    assert (state[0].reps, state[0].interval_days, state[0].due_date) == (3, 8, datetime.date(2024, 1, 18))
    state = {r.card_id: r for r in library.review_flashcard("s", 1, False, NOW).collect()}
    assert len(state) == 2 and (state[1].reps, state[1].interval_days, state[1].ease) == (0, 1, 2.3)


def test_sessions(library):
    s = library.start_session("s", "ds").first()
    assert s.id == 3 and s.theta == pytest.approx(0.45)
    pick = library.next_question(1).first()
    assert pick.question_id not in (4, 5) and abs(pick.difficulty - 0.45) < 0.1 and "answer" not in pick.asDict()
    out = library.answer(1, 3, "d")
    new = out["adaptive_answers"].where("session_id = 1").first()
    assert (new.seq, new.position, new.correct, new.theta_before) == (3, 1, 1, 0.5) and new.theta_after > 0.5
    assert out["adaptive_mastery"].count() == 3
    row = out["adaptive_sessions"].where("id = 1").first()
    assert row.current_question_id is None and not row.finished and row.theta == new.theta_after
    for call in (lambda: library.answer(2, 4, "a"), lambda: library.answer(1, 4, "a"), lambda: library.current_question(2)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        library.session_summary(99)
    assert [r.chapter for r in library.session_summary(2).collect()] == ["6", "5"]
    assert [r.ability for r in library.ability_trend(2).collect()] == [0.6, 0.55]
    assert library.current_question(1).first().question_id == 3
    assert [r.level for r in library.progress("s").collect()] == ["beginner", "advanced"]


def test_flag(library):
    out = library.flag_question(4)
    left = out["adaptive_answers"].collect()
    assert [(r.question_id, r.position, r.theta_before) for r in left] == [(5, 1, 0.5)]
    assert {r.chapter for r in out["adaptive_mastery"].collect()} == {"6"}
    assert not out["question_bank"].where("id = 4").first().verified


def test_dashboards(library):
    assert library.subjects().first().progress == 45
    assert library.subject("DS").count() == 6
    o = library.overview(NOW).first()
    assert (o.asked, o.correct, o.topics, o.mastered, o.streak, o.cards_due) == (3, 2, 6, 1, 3, 0)
    assert sum(r.n for r in library.weekday_activity().collect()) == 3
    assert [r.chapter for r in library.focus_areas().collect()] == ["6", "5", "1", "2"]
    assert [r.score for r in library.mastery().collect()] == [60, 30, 0, 0, 0, 0]
    assert library.record_attempt(1, "ds_1", True).first().mastery_score == 0.65
    assert library.record_attempt(1, "new", False).count() == 2
    assert library.history().count() == 1 and library.figures("DS").count() == 1
    assert library.resources().first().diagrams == 1
    assert [r.created for r in library.profile("x").collect()] == [True]
    assert library.update_profile("s", {"name": "New"}).first()["name"] == "New"
    assert library.system().where("table = 'chunks'").first()["rows"] == 12


def test_syllabus(library):
    assert {r.slot: r.n for r in library.syllabus("DS").collect()} == {"T1": 2, "T2": 2, "T3": 2}
    assert [r.chapter for r in library.syllabus_view("DS", "T1+T2").collect()] == list("1234")
    assert library.syllabus_view("DS", "T3").count() == 6
    for call in (lambda: library.syllabus_view("DS", "T9"), lambda: library.assign_slot("DS", "1", "T9"), lambda: library.assign_slots("DS", [("1", "X")])):
        with pytest.raises(ValueError):
            call()
    assert library.assign_slot("DS", "1", "T2").first().exam_slot == "T2"
    assert [(r.exam_slot, r.position) for r in library.assign_slots("DS", [("1", "T1"), ("2", "T1"), ("3", "T2")]).orderBy("chapter").collect()] == [("T1", 0), ("T1", 1), ("T2", 0)]
    assert library.reset_slots("DS").count() == 6


def test_prerequisites(library):
    out = library.prerequisites("DS", "s")
    assert {r.chapter: r.status for r in out["nodes"].collect()}["6"] == "weak"
    steps = [r.chapter for r in out["sequence"].orderBy("step").collect()]
    assert sorted(steps) == list("123456") and all(steps.index(str(i)) > steps.index(str(i // 2)) for i in range(2, 7))
    assert out["summary"].first().total == 6


def test_exams(library):
    e = library.create_exam("DS", "T1", 3, seed="x").collect()
    assert len(e) == 3 and {r.slot for r in e} == {"T1"} and "answer" not in e[0].asDict()
    with pytest.raises(ValueError):
        library.create_exam("NONE", seed="x")
    assert {r.answer for r in library.exam(1).collect()} == {None}
    out = library.submit_exam(1, {"0": "a", "2": "d", "4": "D"})
    assert {r.question_id: (r.given, r.is_correct) for r in out["items"].collect()} == {0: ("A", True), 1: ("D", False), 2: ("D", False), 3: ("D", True)}
    r = out["result"].first()
    assert (r.score, r.total, r.percentage, r.grade) == (2.0, 4, 50.0, "D")
    assert {r.slot: r.asked for r in out["tiers"].collect()} == {"T1": 2, "T2": 2, "T3": 0}
    assert [(r.prereq_chapter, r.missed) for r in out["revise"].orderBy("rank").collect()] == [("1", 2)]
    assert library.exams("s").first().percentage is None
    assert library.submit_exam(1, {})["result"].first().score == 0.0
