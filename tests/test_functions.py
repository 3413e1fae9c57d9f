import pytest
from pyspark.sql import functions as F

from loreforge.functions import scores, text
from loreforge.functions.porter import stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.normalise_characters, "ﬁne ﬂow eﬀect oﬃce a b soft­hy​phen ﬅ", "fine flow effect office a b softhyphen st"),
        (text.strip, "\t x y \n", "x y"),
        (text.words, " a  b\tc ", ["a", "b", "c"]),
        (text.word_count, "a é  b", 3),
        (text.digit_shape, " Page 12 of 345 ", "Page # of #"),
        (text.alpha_ratio, "ab1é", 0.75),
        (text.alpha_ratio, "", 0.0),
        (text.has_long_repeat, "aaaaaaaaaa", True),
        (text.has_long_repeat, "aaaaaaaaa", False),
        (text.is_spaced_out, "A n O v e r v i e w", True),
        (text.is_spaced_out, "An overview of all that a book has", False),
        (text.join_drop_caps, "T o see. T he end\nT hese", "To see. T he end\nThese"),
        (text.drop_leading_page_number, "81 Expanding out", "Expanding out"),
        (text.drop_leading_page_number, "1984 Was a year", "1984 Was a year"),
        (text.capitalise_first, "aBC", "ABC"),
        (text.token_estimate, "one two three", 4),
        (text.citations, "see [2] and [10][2], [x]", [2, 10]),
        (text.match_form, "Red-Black\n Tree", "red black tree"),
        (text.option_text, " B) second ", "second"),
        (text.answer_letter, "c) d", None),
        (text.answer_letter, "(c)", "C"),
        (text.answer_letter, "E", None),
        (text.tidy, "according to the excerpt, what is it ?", "What is it?"),
        (lambda c: text.tidy(c, explanation=True), "the given passage says so; The text too, the textbook not", "The textbook says so; The textbook too, the textbook not"),
        (text.leading_integer, "12a", 12),
        (text.leading_integer, "A", 0),
        (lambda c: text.snippet(c, F.lit("TREE"), 3, 6), "a red tree here", "ed tree h"),
        (lambda c: text.from_breadcrumb(c, "Chapter"), "Book > Chapter 3: Trees > Section 3.1", "3"),
        (lambda c: text.from_breadcrumb(c, "Section"), "Book > Chapter 3: Trees > Section 3.1", "3.1"),
        (lambda c: text.is_garbled(text.mark_control_characters(c)), "a\x00b\x02c\x03", True),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_labels(spark):
    df = spark.createDataFrame([(None, 3, "1", "", ""), (3, 3, "1", "One", "1.2"), (3, 5, "", "", "")], "a int, b int, ch string, title string, sec string")
    pages = [r[0] for r in df.select(text.page_label(F.col("a"), F.col("b"))).collect()]
    assert pages == ["", "p. 3", "pp. 3-5"]
    where = [r[0] for r in df.select(text.location(F.lit("B"), F.col("ch"), F.col("title"), F.col("sec"), F.lit(None).cast("string"), F.lit("p. 3"))).collect()]
    assert where == ["B > Chapter 1 > p. 3", "B > Chapter 1: One > Section 1.2 > p. 3", "B > p. 3"]
    order = [r[0] for r in spark.createDataFrame([("10",), ("b",), ("9",)], "x string").orderBy(*text.numeric_first_key(F.col("x"))).collect()]
    assert order == ["9", "10", "b"]


def test_scores(spark):
    assert one(spark, 2.5, scores.half_even, "double") == 2.0
    assert one(spark, 0.5, lambda c: scores.chance(c, F.lit(0.5)), "double") == 0.5
    assert one(spark, 0.5, lambda c: scores.step(c, F.lit(0.5), F.lit(1), F.lit(0)), "double") == pytest.approx(0.65)
    assert one(spark, 0.97, lambda c: scores.step(c, F.lit(0.9), F.lit(1), F.lit(0)), "double") == 0.98
    assert [one(spark, x, scores.learner_level, "double") for x in (0.34, 0.35, 0.6)] == ["beginner", "intermediate", "advanced"]
    assert [one(spark, float(x), scores.grade, "double") for x in (90, 89, 70, 60, 50, 49)] == ["A+", "A", "B", "C", "D", "F"]
    status = lambda *v: spark.range(1).select(scores.topic_status(*[F.lit(x) for x in v])).first()[0]
    assert [status(0.6, 2, 2), status(0.5, 2, 2), status(0.6, 1, 0), status(0.6, 1, 1), status(None, None, None)] == ["completed", "weak", "weak", "completed", "pending"]


def test_porter():
    assert [stem(w) for w in ("relational", "hopping", "troubles", "formalize", "sky", "trees", "is", "controlling")] == ["relat", "hop", "troubl", "formal", "sky", "tree", "is", "control"]
