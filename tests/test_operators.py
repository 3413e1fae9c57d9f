import datetime

import pytest
from pyspark.sql import functions as F

from loreforge.operators import activity, cleanup, exam, generation, graph, learner, quality, search, structure, upserts
from loreforge.sources import catalog, images, loading, outlines, paged, records

D = datetime.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


rows_of = rows


# ---- search


def test_query_phrases():
    assert search.query_phrases("What is a binary search tree?", stemmed=False) == [["binary", "search", "tree"], ["binary"], ["search"], ["tree"]]
    assert search.query_phrases("what is the", stemmed=False) == []
    assert search.query_phrases("a_b trees", stemmed=True) == [["a", "b", "tree"], ["a", "b"], ["tree"]]


def test_bm25_phrase_and_weights(spark):
    docs = spark.createDataFrame([(1, "red black tree", "x"), (2, "black red tree", "x"), (3, "other words here", "tree"), (4, "nothing", "y"), (5, "none", "y")], "id bigint, text string, crumb string")
    index = search.postings(docs, {"text": F.col("text"), "breadcrumb": F.col("crumb")}, id="id", stemmed=True)
    sizes = index.groupBy("id").agg(F.count("*").alias("n"))
    hits = search.bm25(index, sizes, [["red", "black"], ["tree"]], 10, id="id").collect()
    assert [h.id for h in hits][0] == 1 and {h.id for h in hits} == {1, 2, 3}
    assert search.bm25(index, sizes, [], 10, id="id").collect() == []


def test_many_queries_meet_documents_in_blocks(spark):
    """The same rows as with few queries: ties, books, null vectors and vectors of another length too."""
    import random

    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, -0.5]) for _ in range(4)], rng.choice("xyz")) for i in range(300)] + [(300, None, "x"), (301, [0.5, 0.5], "x"), (302, [0.5, None, 0.0, 0.0], "y")]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", [rng.choice([0.5, 0.25, 0.0]) for _ in range(4)], rng.choice(["x", "y", None])) for i in range(40)], "qid string, q array<float>, want string")
    old = search.FEW_QUERIES, search.QUERY_ROWS, search.DOCUMENT_ROWS
    try:
        for mode, book in (("exact", None), ("exact", "label"), ("overfetch", "label")):
            got = []
            for search.FEW_QUERIES, search.QUERY_ROWS, search.DOCUMENT_ROWS in (old, (3, 7, 16)):
                got.append(rows_of(search.vector_topk(docs.where("vec_id <> 302"), queries, 6, book=book, mode=mode)))
            assert got[0] == got[1] and len(got[0]) > 100
        assert {r.vec_id for r in search.vector_topk(docs, queries, 400).collect()} == set(range(300))
    finally:
        search.FEW_QUERIES, search.QUERY_ROWS, search.DOCUMENT_ROWS = old


def test_fusion_ties_and_provenance(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank int")
    k = spark.createDataFrame([(3, 1), (2, 2)], "id bigint, rank int")
    got = search.fuse(v, k, 3, id="id").orderBy("rank").collect()
    assert [(r.id, r.found_by) for r in got] == [(2, "vector+keyword"), (1, "vector"), (3, "keyword")]
    assert got[0].score == pytest.approx(2 / 62)


def test_gate(spark):
    h = spark.createDataFrame([(1, 0.2), (2, 0.29)], "id int, similarity double")
    assert search.answerable(h).count() == 0 and search.answerable(h, 0.29).count() == 2


# ---- learners


def test_replay_equals_fold_of_the_rest(spark):
    log = spark.createDataFrame([(s, i, q, (i * q) % 2, q / 10) for s in (1, 2) for i, q in enumerate([3, 5, 3, 7, 9, 5])], "student int, seq int, question int, correct int, difficulty double")
    gone = spark.createDataFrame([(3,)], "question int")
    a = learner.retire_and_replay(log, gone, ["question"], ["student"], ["seq"])
    b = learner.ability(log.where("question <> 3"), ["student"], ["seq"])
    assert rows(a) == rows(b)
    t = learner.trail(log, ["student"], ["seq"]).where("student = 1").orderBy("seq").collect()
    assert t[0].theta_before == 0.5 and all(x.theta_after == y.theta_before for x, y in zip(t, t[1:], strict=False))
    assert learner.ability(log, ["student"], ["seq"]).where("student = 1").first().theta == t[-1].theta_after


def test_review_sequence(spark):
    seq = ["know", "know", "know", "again", "know"]
    log = spark.createDataFrame([(1, i, x == "know", D(2024, 1, 1 + i)) for i, x in enumerate(seq)], "card int, seq int, known boolean, day date")
    upto = lambda n: learner.review_schedule(log.where(F.col("seq") < n), ["card"], ["seq"]).first()
    assert [(upto(n).reps, upto(n).interval_days) for n in range(1, 6)] == [(1, 1), (2, 3), (3, 8), (0, 1), (1, 1)]
    assert upto(3).due_date == D(2024, 1, 11) and upto(3).ease == 2.8


def test_next_item_prefers_unseen(spark):
    who = spark.createDataFrame([(1, 0.55, "B"), (2, 0.55, "B")], "student int, theta double, scope string")
    q = spark.createDataFrame([(10, "B", 0.5), (11, "B", 0.5), (12, "B", 0.9)], "question_id int, scope string, difficulty double")
    seen = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (2, 12)], "student int, question_id int")
    got = {r.student: (r.question_id, r.seen) for r in learner.next_item(who, q, seen, by="student").collect()}
    assert got == {1: (11, False), 2: (10, True)}


# ---- exams and graphs


def test_midterm_falls_back_and_quotas(spark):
    assert exam.quotas(30, "T3") == {"T1": 9, "T2": 9, "T3": 12} and exam.quotas(1, "T3") == {"T1": 1, "T2": 1, "T3": 1}
    pool = spark.createDataFrame([(i, "T2" if i < 5 else None) for i in range(20)], "question_id int, slot string")
    assert exam.stratified(pool, 4, exam="T1").count() == 4
    assert {r.slot for r in exam.stratified(pool, 4, exam="T2").collect()} == {"T2"}
    got = exam.stratified(pool, 8).collect()
    assert len({r.question_id for r in got}) == 8 and sorted(r.position for r in got) == list(range(1, 9))


def test_thirds(spark):
    for n, want in ((1, "T1"), (2, "T1 T2"), (3, "T1 T2 T3"), (4, "T1 T2 T2 T3"), (5, "T1 T1 T2 T3 T3")):
        c = spark.createDataFrame([("B", i) for i in range(n)], "book string, i int")
        assert " ".join(r.slot for r in exam.partition_thirds(c, ["book"], ["i"]).orderBy("i").collect()) == want


def test_order_with_cycle_and_missing_prerequisite(spark):
    nodes = spark.createDataFrame([("B", c, s, "T1", i) for i, (c, s) in enumerate([("1", "completed"), ("2", "pending"), ("3", "weak"), ("4", "pending"), ("5", "pending"), ("6", "pending")])], "book string, chapter string, status string, slot string, place int")
    edges = spark.createDataFrame([("B", "2", "1"), ("B", "4", "5"), ("B", "5", "4"), ("B", "6", "99")], "book string, chapter string, prereq_chapter string")
    order = graph.learning_order(nodes, edges, "book")
    assert [(r.chapter, r.reached) for r in order.orderBy("step").collect()] == [("3", True), ("1", True), ("2", True), ("4", False), ("5", False), ("6", False)]
    advice = {r.chapter: r.advice for r in graph.recommendations(order, nodes, edges, "book").collect()}
    assert advice == {"1": "mastered", "2": "ready", "3": "re-study", "4": "independent", "5": "independent", "6": "independent"}
    level = {r.chapter: r.level for r in graph.levels(nodes, edges, "book").collect()}
    assert level == {"1": 0, "2": 1, "3": 0, "4": None, "5": None, "6": None}


# ---- activity and upserts


def test_streaks_and_gaps(spark):
    days = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 2, 3, 5, 6)] + [("b", D(2024, 1, 1))] + [("c", D(2024, 1, d)) for d in (4, 5)], "u string, day date")
    at = F.lit(D(2024, 1, 6))
    assert rows(activity.streaks(days, ["u"], at)) == [("a", 2), ("b", 0), ("c", 2)]
    assert rows(activity.gaps(days, ["u"], "day", 1)) == [("a", D(2024, 1, 3), D(2024, 1, 5))]
    assert [r.n for r in activity.by_weekday(days.withColumn("n", F.lit(1))).orderBy("weekday").collect()] == [2, 1, 1, 1, 2, 1, 0]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 5)], "k int, v string, n int")
    assert rows(upserts.replace(old, new, ["k"])) == [(1, "a", 1), (2, "c", 5), (3, "d", 5)]
    assert rows(upserts.ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 1), (3, "d", 5)]
    assert rows(upserts.merge(old, new, ["k"], {"n": F.col("old.n") + F.col("new.n")})) == [(1, "a", 1), (2, "b", 6), (3, "d", 5)]
    assert rows(upserts.counters(old.drop("v"), new, ["k"], "n")) == [(1, 1), (2, 2), (3, 1)]
    assert rows(upserts.latest(old.unionByName(new).withColumn("s", F.col("n")), ["k"], "s").drop("s")) == [(1, "a", 1), (2, "c", 5), (3, "d", 5)]
    assert sorted(r.id for r in upserts.next_ids(old.withColumnRenamed("k", "id"), spark.range(7).select(F.col("id").alias("x")), "id", ["x"]).collect()) == list(range(3, 10))


def test_schema_rules(spark):
    t = {"syllabus_exam_map": spark.createDataFrame([("B", "1", "T1"), ("B", "1", "T9")], "book_id string, chapter string, exam_slot string")}
    t["mock_exam_items"] = spark.createDataFrame([(1,), (2,)], "exam_id bigint")
    t["mock_exams"] = spark.createDataFrame([(1,)], "id bigint")
    got = {(r.table, r.rule): r.n for r in catalog.violations(t).collect()}
    assert got == {("syllabus_exam_map", "unique"): 1, ("syllabus_exam_map", "check"): 1, ("mock_exam_items", "parent"): 1, ("mock_exams", "unique"): 0}
    assert catalog.conform(t["mock_exams"], spark, "mock_exams").columns == catalog.empty(spark, "mock_exams").columns


# ---- books

BOOK = "\n\n===== PAGE 1 =====\n\nPreface words\nAll rights reserved\n\n===== PAGE 2 =====\n\n1.1\nFirst Things\nSome algo-\nrithm is called good. It ends.\n12-13\n\n===== PAGE 3 =====\n\n1.1.2\nFiner Things\nint x = 1;\n  y = 2;\n\nMore prose here, at last.\n"


def test_pages_and_chunks(spark):
    books = spark.createDataFrame([("DS", BOOK)], "book_id string, text string")
    assert [r.page for r in paged.pages(books).orderBy("page").collect()] == [1, 2, 3]
    assert [r.page for r in paged.pages(spark.createDataFrame([("X", "no marker")], "book_id string, text string")).collect()] == [1]
    kinds = spark.createDataFrame([("DS", "ds")], "book_id string, kind string")
    titles = spark.createDataFrame([("DS", "Data")], "book_id string, book_title string")
    got = structure.build(books, kinds, titles).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.chunk_id, r.chapter, r.section, r.section_title, r.page_start, r.page_end, r.contains_code, r.contains_definition) == ("DS_CHUNK_00001", "1", "1.1", "First Things", 2, 3, True, True)
    assert r.text == "1.1 First Things\n\nSome algorithm is called good. It ends.\n\n1.1.2 Finer Things\n\nint x = 1;\n  y = 2;\n\nMore prose here, at last."
    assert quality.assert_sound(structure.build(books, kinds, titles)).count() == 1


def test_heal(spark):
    pages = [["algo-", "rithm, x", "end-", "Cap"], ["a-", "b-", "c"], ["x", "", "  y-", "  zed  "], ["tail-"]]
    df = spark.createDataFrame([("B", p, i, line) for p, lines in enumerate(pages) for i, line in enumerate(lines)], "book_id string, page int, line_no int, line string")
    got = structure.heal_pages(df).orderBy("page", "line_no").collect()
    assert [[r.line for r in got if r.page == p] for p in range(4)] == [["algorithm , x", "end-", "Cap"], ["ab -", "c"], ["x", "", "  yzed"], ["tail-"]]


def content(lines, heading=""):
    """Rows as ``structure.segments`` makes them."""
    return [("B", page, i, line, 0, heading, "1", "", "", "", "", "") for i, (line, page) in enumerate(lines)]


CONTENT = "book_id string, page int, line_no int, line string, segment int, heading string, chapter string, chapter_title string, section string, section_title string, subsection string, subsection_title string"


def test_blocks(spark):
    lines = [("Some words", 1), ("go on", 1), ("", 1), ("int main() {", 2), ("  x;", 2), ("", 2), ("}", 2), ("O(n) = n", 3), ("Table 1.2 Things", 3), ("a b", 3), ("", 3), ("end", 4)]
    got = structure.blocks(spark.createDataFrame(content(lines), CONTENT)).orderBy("block").collect()
    assert [(b.kind, b.text, b.first, b.last) for b in got] == [("text", "Some words go on", 1, 1), ("code", "int main() {\n  x;\n\n}", 2, 2), ("math", "O(n) = n", 3, 3), ("table", "Table 1.2 Things\na b", 3, 3), ("text", "end", 4, 4)]


def test_blocks_end_where_they_should(spark):
    """Two blank lines end code, code ends a table, a table has at most 30 lines, indented prose alone is prose."""
    lines = [("x = 1;", 1), ("", 1), ("", 1), ("  indented words", 1), ("sto-", 1), ("ry", 2), ("Figure 3 A", 2), ("row", 2), ("y = 2;", 2), ("  goes on", 2), ("∑ a", 2), ("∑ b;", 3), ("Table 9", 3), *[(f"r {i}", 4) for i in range(35)]]
    got = structure.blocks(spark.createDataFrame(content(lines), CONTENT)).orderBy("block").collect()
    assert [(b.kind, b.text) for b in got[:5]] == [("code", "x = 1;"), ("text", "indented words story"), ("figure", "Figure 3 A\nrow"), ("code", "y = 2;\n  goes on"), ("math", "∑ a\n∑ b;")]
    assert [(b.kind, len(b.text.split("\n"))) for b in got[5:]] == [("table", 30), ("text", 1)] and got[6].text.startswith("r 29 r 30")


def test_long_code_is_one_block(spark):
    lines = [(f"x{i} = {i};", 1) if i % 3 else ("", 1) for i in range(1, 20000)]
    assert [b.kind for b in structure.blocks(spark.createDataFrame(content(lines), CONTENT)).collect()] == ["code"]


def test_packing():
    def sizes(*b):
        ends = structure.pack([n for n, _ in b], [s for _, s in b])
        return [sum(n for n, _ in b[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    text, code = False, True
    assert sizes((500, text), (400, text), (100, text)) == [1000]
    assert sizes((500, text), (400, code), (300, text)) == [500, 700]
    assert sizes((700, text), (600, text), (300, text)) == [700, 900]
    assert sizes((900, text), (10, text)) == [910] and sizes((1190, text), (20, text)) == [1190, 20] and sizes() == []
    assert structure.overlap_tail("One two three. Four five six. Seven eight nine ten.", 100) == ""
    assert structure.overlap_tail("A b. " + "Word " * 40 + "end. Last one.", 100) == "Last one."
    long = " ".join(f"{'word ' * 99}end." for _ in range(30)).replace("word word", "Word word", 1)
    assert [len(t.split()) for t in structure.cut_long(long.replace("end. word", "end. Word"))] == [800, 800, 800, 600]


def test_packing_equals_one_block_at_a_time():
    import random

    rng = random.Random(3)
    for _ in range(300):
        blocks = [(rng.choice([1, 30, 200, 500, 799, 800, 1000, 1500]), rng.random() < 0.4) for _ in range(rng.randint(1, 25))]
        groups, size = [[]], 0
        for n, structured in blocks:
            if groups[-1] and size + n > (800 if structured else 1200):
                groups.append([])
                size = 0
            groups[-1].append(n)
            size += n
            if size >= 800:
                groups.append([])
                size = 0
        groups = [g for g in groups if g]
        if len(groups) > 1 and sum(groups[-1]) < 250 and sum(groups[-2]) + sum(groups[-1]) <= 1200:
            groups[-2:] = [groups[-2] + groups[-1]]
        ends = structure.pack([n for n, _ in blocks], [s for _, s in blocks])
        assert [e - b for b, e in zip([0, *ends], ends, strict=False)] == [len(g) for g in groups]


def test_repeated_heads_go(spark):
    lines = [("B", p, 0, "Running Head") for p in range(8)] + [("B", p, 1, f"Line number {p}") for p in range(8)]
    df = spark.createDataFrame(lines, "book_id string, page int, line_no int, line string")
    assert {r.line for r in structure.clean_lines(df).collect()} == {f"Line number {p}" for p in range(8)}


# ---- cleaning


def test_headers_by_frequency(spark):
    c = spark.createDataFrame([("B", f"c{i}", f"{i} CHAPTER Trees\n\nBody text {'abc'[i] * 3} is long enough.") for i in range(3)] + [("B", "c3", "9 OTHER Head\n\n12\n\nT he end")], "book_id string, chunk_id string, text string")
    got = {r.chunk_id: (r.cleaned, r.headers) for r in cleanup.without_headers(c).collect()}
    assert got["c0"] == ("Body text aaa is long enough.", 1)
    assert got["c3"] == ("9 OTHER Head\n\nThe end", 1)


def test_overlap(spark):
    a, b = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(10, 30))
    df = spark.createDataFrame([("B", 1, a), ("B", 2, b), ("B", 3, "w28 w29 other")], "book string, i int, text string")
    got = [(r.overlap, r.rest) for r in cleanup.without_overlap(df, ["book"], ["i"]).orderBy("i").collect()]
    assert got == [(0, a), (10, " ".join(f"w{i}" for i in range(20, 30))), (0, "w28 w29 other")]


def test_pieces_keep_all_words_within_budget():
    body = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(n)) + "." for i, n in enumerate((30, 5, 200, 10, 3)))
    got = cleanup.pieces(body, 100)
    assert all(cleanup.estimate(t) <= 100 or len(t.split()) <= 1 for t, *_ in got)
    words = body.split()
    assert got[0][1] == 0 and got[-1][2] == got[-1][3] == len(words)
    assert all(a[2] >= b[1] for a, b in zip(got, got[1:], strict=False))
    assert set(words) == {w for t, *_ in got for w in t.split()}
    assert cleanup.pieces("", 100) == []


PIECE = "book_id string, parent_chunk_id string, piece int, text string, chapter string, chapter_title string, section string, section_title string, subsection string, subsection_title string"


def labelled(spark, rows, titles=()):
    df = spark.createDataFrame(rows, PIECE)
    known = spark.createDataFrame(list(titles), "book_id string, chapter string, title string")
    return cleanup.label_pieces(df, known).orderBy("book_id", "parent_chunk_id", "piece").collect()


def test_headings_move_forward(spark):
    label = ("3", "C", "3.2", "S", "", "")
    texts = ["3.3 Next Things\nbody\n9.1 Too Far\n4.1 New Chapter Here\n", "nothing", "x " * 100 + "\n4.1.2 Deep Thing\n", "rest"]
    got = labelled(spark, [("DS", "p1", i, t, *label) for i, t in enumerate(texts)] + [("DS", "p2", 0, "x " * 100 + "\n3.2.1 Deep Thing\n", *label), ("DS", "p2", 1, "rest", *label), ("X", "p3", 0, "3.3 Next Things", *label)], [("DS", "4", "Four")])
    own = [(r.chapter, r.chapter_title, r.section, r.section_title, r.subsection, r.subsection_title) for r in got]
    assert own[0] == ("3", "C", "3.3", "Next Things", "", "")
    assert own[1] == ("4", "Four", "4.1", "New Chapter Here", "", "")
    assert own[2] == own[1] and own[3] == ("4", "Four", "4.1", "New Chapter Here", "4.1.2", "Deep Thing")
    assert own[4] == label and own[5] == ("3", "C", "3.2", "S", "3.2.1", "Deep Thing")  # a parent begins with its own label
    assert own[6] == label  # no book with headings


def test_headings_that_do_not_count(spark):
    label = ("1", "A", "1.2", "S", "", "")
    bad = ["0.3 Zero Chapter", "1.1 Going Back", "1.15 Too Many Steps", "1.3 x = y;", "1.3 Ends with a stop.", "1.3 " + "Word " * 17, "3.1 Skips One", "2.3 Late in the Next"]
    got = labelled(spark, [("DS", f"p{i}", 0, t + "\nbody", *label) for i, t in enumerate(bad)] + [("DS", "q", 0, "7.7 Any Goes\nbody", "B", "", "", "", "", "")])
    assert [r.section for r in got] == ["1.2"] * len(bad) + ["7.7"]


def test_exercise_run(spark):
    quiet, blank = "plain words", ("",) * 5
    texts = [(quiet, "1"), ("Exercises\n", "1"), *[(quiet, "1")] * 4, ("Point out the errors", "1"), (quiet, "2"), (quiet, "2"), ("Chapter 2: New\nExercises\n", "2"), *[(quiet, "2")] * 2, ("[A] One", "2"), (quiet, "2")]
    got = labelled(spark, [("C", "p", i, t, c, *blank) for i, (t, c) in enumerate(texts)])
    assert [r.is_exercise for r in got] == [False, True, True, True, False, False, True, False, False, True, True, True, True, True]
    long = labelled(spark, [("C", "p", i, "Point out the errors" if i in (0, 60, 120, 121) else "[A] One", "1", *blank) for i in range(300)])
    assert [i for i, r in enumerate(long) if not r.is_exercise] == [120, *range(241, 300)]


def test_exclusion(spark):
    refs = " ".join(f"[{i}] A. Author, Title." for i in range(5))
    df = spark.createDataFrame([(refs,), ("word " * 20,), ("1 2 3 4",), ("a ......... 1\nb ......... 2\nc ......... 3 " + "w " * 20,)], "t string")
    assert [r[0] for r in df.select(cleanup.exclude_reason(F.col("t"), F.lit(False))).collect()] == ["reference_list", None, "tiny_or_numeric", "outline"]
    assert df.select(cleanup.exclude_reason(F.col("t"), F.lit(True))).collect()[1][0] == "exercise"
    prose = "Good prose " * 20
    assert spark.createDataFrame([(prose + "References [1] A. B, c.",)], "t string").select(cleanup.trim_references(F.col("t"))).first()[0] == prose.strip()


def test_labels_fill_and_vote(spark):
    c = spark.createDataFrame([("B", 1, "1", "Chapter 1: Trees\n"), ("B", 2, "0", "Chapter 1: Trees\nChapter 1: Bees\n"), ("B", 3, "", ""), ("B", 4, "2", "")], "book_id string, chunk_id int, chapter string, text string")
    assert [r.chapter for r in cleanup.inherit_chapter(c, ["book_id"], ["chunk_id"], ("chapter",)).orderBy("chunk_id").collect()] == ["1", "1", "1", "2"]
    assert rows(cleanup.majority_titles(c)) == [("B", "1", "Trees")]
    s = spark.createDataFrame([("B", 1, "1", "1.1", "Good"), ("B", 2, "1", "9.9", "Table 3"), ("B", 3, "2", "7.7", "Figure 1")], "book_id string, i int, chapter string, section string, section_title string")
    assert [(r.section, r.section_title) for r in cleanup.last_good_section(s, ["book_id"], ["i"]).orderBy("i").collect()] == [("1.1", "Good"), ("1.1", "Good"), ("", "")]
    t = lambda x: spark.createDataFrame([("B", "1", x)], "book_id string, chapter string, title string")
    assert rows(cleanup.titles_by_precedence(t(""), t("outline"), t("built in"))) == [("B", "1", "outline")]


def test_rebuilt_labels(spark):
    c = spark.createDataFrame([("X", 1, "1.1 Start Here\nbody", "", "", "", ""), ("X", 2, "5.1 Too Far\nbody", "", "", "", ""), ("X", 3, "2.1 Second Chapter\nbody", "", "", "", "")], "book_id string, n int, text string, chapter string, chapter_title string, section string, section_title string")
    titles = spark.createDataFrame([("X", "2", "Two")], "book_id string, chapter string, title string")
    got = cleanup.rebuild_labels(c, titles, ["n"]).orderBy("n").collect()
    assert [(r.chapter, r.section, r.chapter_title) for r in got] == [("1", "1.1", ""), ("1", "1.1", ""), ("2", "2.1", "Two")]


def test_report_counts_what_was_done(spark):
    books = spark.createDataFrame([("C", "\n\n===== PAGE 1 =====\n\nChapter 1: Loops\n" + "\n".join(f"Some words of prose number {i} go on here." for i in range(80)) + "\n\n===== PAGE 9 =====\n\nExercises\n[A] What is it?\n" + "More words. " * 60)], "book_id string, text string")
    chunks = structure.build(books, spark.createDataFrame([("C", "c")], "book_id string, kind string"), spark.createDataFrame([("C", "Letters")], "book_id string, book_title string"))
    parents = cleanup.cleaned_parents(chunks)
    none = spark.createDataFrame([], "book_id string, chapter string, title string")
    pieces = cleanup.clean_pieces(parents, none)
    rows_, r = pieces.collect(), cleanup.cleanup_report(pieces, parents).collect()
    assert len(r) == 1 and len(r[0]) >= 25
    kept = [p for p in rows_ if p.exclude_reason is None]
    assert (r[0].chunks, r[0].pieces, r[0].kept, r[0].exercises) == (chunks.count(), len(rows_), len(kept), sum(p.is_exercise for p in rows_))
    tokens = sorted(int(max(len(p.search_text.split()) * 1.5, len(p.search_text) / 3.6)) for p in kept)
    assert (r[0].tokens_median, r[0].most_tokens) == (tokens[len(tokens) // 2], tokens[-1]) and tokens[-1] <= 250
    assert [p.chunk_id for p in sorted(kept, key=lambda p: (p.parent_chunk_id, p.piece))] == [f"C_CHUNK_{i + 1:05d}" for i in range(len(kept))]


# ---- generation and sources


def test_generation(spark):
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", "bad")], "chunk_id string, text string")

    def write(body):
        if body == "bad":
            raise RuntimeError("down")
        q = f'{{"question": "what is {body} ?", "options": ["A) p", "B) q", "C) r", "D) s"], "answer": "B", "explanation": "the excerpt says so"}}'
        return f'```json\n{{"questions": [{q}, {q}]}}\n```'

    got = generation.generate(chunks, write, lambda body, asked: {0}).collect()
    assert sorted(r.chunk_id for r in got) == ["c1", "c2"]
    for r in got:
        assert sorted(r.options) == ["p", "q", "r", "s"] and r.options[ord(r.answer) - 65] == "q" and r.explanation == "The textbook says so"
    assert generation.parse_json('x [1, 2] y') == [1, 2] and generation.parse_json("none") is None


def test_provider_chain():
    calls = []

    def slow(prompt):
        calls.append("slow")
        raise RuntimeError("429 too many")

    def down(prompt):
        calls.append("down")
        raise RuntimeError("500")

    assert generation.chain([slow, down, lambda p: p.upper()])("hi") == "HI" and calls == ["slow", "slow", "down"]
    with pytest.raises(RuntimeError, match="slow: 429 too many; slow: 429 too many; down: 500"):
        generation.chain([slow, down])("hi")


def test_images(spark):
    i = spark.createDataFrame([("B", 1, 7, 100, 100), ("B", 1, 7, 100, 100), ("B", 1, 8, 10, 100), ("B", 1, 9, 2000, 100)], "book_id string, page_number int, xref int, width int, height int")
    assert images.keep_pictures(i).count() == 1
    cap = spark.createDataFrame([("B", 1, 1, 100.0, 500.0)], "book_id string, page int, caption_id int, x double, y double")
    dr = spark.createDataFrame([("B", 1, 1, 50.0, 300.0, 150.0, 400.0), ("B", 1, 2, 90.0, 410.0, 120.0, 480.0), ("B", 1, 3, 900.0, 410.0, 950.0, 480.0)], "book_id string, page int, drawing_id int, x0 double, y0 double, x1 double, y1 double")
    assert rows(images.figures(cap, dr)) == [("B", 1, 1, 42.0, 292.0, 158.0, 488.0)]


def test_outline_and_titles(spark, tmp_path):
    o = spark.createDataFrame([("B", 2, 0, "Chapter 1: Deep", 9), ("B", 1, 1, "1 Shallow", 3), ("B", 1, 2, "1 Later", 4), ("B", 1, 3, "2 ab", 5)], "book_id string, level int, place int, title string, page int")
    assert rows(outlines.chapters(o)) == [("B", "1", "Shallow", 3)]
    (tmp_path / "t.json").write_text('{"C": {"1": "One"}}')
    assert rows(outlines.read_titles(spark, str(tmp_path / "t.json"))) == [("C", "1", "One")]


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "text": "é"}\n\nnot json\n')
    got = records.read(spark, str(tmp_path / "a.jsonl")).cache()
    assert {(r.chunk_id, r.text) for r in got.collect()} == {("x", "é"), (None, None)}
    assert [r.bad for r in records.malformed(spark, str(tmp_path / "a.jsonl")).collect()] == [1]
    records.write(got.where("chunk_id is not null").select("chunk_id", "text"), str(tmp_path / "out"))
    assert records.read(spark, str(tmp_path / "out")).first().text == "é"


def test_loading(spark):
    import numpy as np

    c = spark.createDataFrame([("c1", "C", "T", None, "one", 1, 2, False), ("c2", "C", "T", "crumb", None, 3, 3, False), ("c3", "C", "T", None, "three", 9, 9, False)], "chunk_id string, book_id string, book_title string, breadcrumb string, text string, page_start int, page_end int, contains_figure boolean")
    pics = spark.createDataFrame([("C", 2, "p2"), ("C", 1, "p1"), ("C", 2, "p1"), ("D", 3, "x")], "book_id string, page_number int, image_id string")
    got = {r.chunk_id: r for r in loading.load(c, pics, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), most=2).collect()}
    assert set(got) == {"c1", "c2"}
    assert (got["c1"].image_paths, got["c1"].contains_figure, got["c1"].search_text) == (["p1", "p2"], True, "[T]\n\none")
    assert (got["c2"].image_paths, got["c2"].contains_figure, got["c2"].breadcrumb) == ([], False, "crumb")
    assert sum(x * x for x in got["c1"].embedding) == pytest.approx(1)
    old, new = spark.createDataFrame([("a", "A")], "username string, name string"), spark.createDataFrame([("a", "B"), ("b", "C")], "username string, name string")
    assert rows(loading.exported(old, new, "students")) == [("a", "B"), ("b", "C")]
    assert loading.books(spark).count() == 4
