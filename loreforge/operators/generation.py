"""Questions and flashcards from chunks by a model that is given as a callable.

The model is an outside effect: ``write`` and ``verify`` are called in batches on the
executors; with plain functions everything can be tested without one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions import scores, text
from loreforge.operators import exam

#: Questions asked of a chunk, least characters and letters' share of a chunk to ask about.
PER_CHUNK, LEAST_CHARS, LEAST_LETTERS = 2, 500, 0.6
#: Wording that shows a question to be unusable.
BROKEN = r"(?:(?<=\s)|^)[’'](?:s\b|(?=\s|$))"
EXERCISE_ID = r"(?m)\b\d{1,2}\.\d{1,2}-\d{1,2}\b|\bProblems?\s+\d{1,2}-\d{1,2}\b|^\s*\d{1,2}-\d{1,2}\s+[A-Z]"
POINTS_AT_TEXT = r"(?i)\b(?:described|illustrated|depicted|discussed above|shown in|in the figure|above|below)\b"
TRIVIA = (
    r"(?i)\bwho(?:m)?\b.{0,40}\b(?:invent\w*|credit\w*|propos\w*|devis\w*|introduc\w*|creat\w*|discover\w*|develop\w*|named?|wrote|designed)\b"
    r"|\bin\s+which\s+year\b|\bwhen\s+(?:was|were)\b.{0,40}\b(?:invent\w*|introduc\w*|publish\w*|propos\w*)\b"
)
INDEX_RANGE = r"[\w+\-]+\s*[≤<]=?\s*\w+\s*[≤<]=?\s*\w+|\b\w+\s*(?:\.{2,3}|…)\s*\w+\b"
NAMES_SOURCE = r"(?i)\b(?:excerpt|passage)\b"


def is_substantial(c: Column) -> Column:
    return (F.length(c) >= LEAST_CHARS) & (text.alpha_ratio(c) >= LEAST_LETTERS)


def is_askable(c: Column) -> Column:
    """Worth asking about: substantial, without lost symbols, no exercise."""
    return is_substantial(c) & ~c.rlike(BROKEN) & ~c.rlike(EXERCISE_ID)


def is_bad(c: Column) -> Column:
    return c.rlike(TRIVIA) | c.rlike(INDEX_RANGE)


def pick(chunks: DataFrame, questions: DataFrame, n: int, *, seed: str) -> DataFrame:
    """Chunks to ask about, those without questions first; ones whose mathematics is garbled are left out where the chunks say so."""
    if "garbled_math" in chunks.columns:
        chunks = chunks.where(~F.coalesce(F.col("garbled_math").cast("boolean"), F.lit(False)))
    return exam.draw_fresh_first(chunks.where(is_askable(F.col("text"))), questions, n, id="chunk_id", seed=seed)


def chunks_needed(count: int, flashcards: bool = False) -> int:
    return max(2, count // 3 + 2) if flashcards else -(-count // PER_CHUNK) + 2


def parse_json(reply: str):
    """The JSON of a model's reply: without code fences, or else its outermost object or list; None if there is none."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply or "")
    for candidate in (bare, *(m[0] for m in [re.search(r"(?s)[\[{].*[\]}]", bare)] if m)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def chain(providers: list[Callable[[str], str]], attempts: int = 2, again: Callable[[Exception], bool] = lambda e: "429" in str(e)) -> Callable[[str], str]:
    """A model that asks providers in turn; one is tried again only after errors that say so.  All errors are named if none answers."""

    def ask(prompt: str) -> str:
        errors = []
        for provider in providers:
            for _ in range(attempts):
                try:
                    return provider(prompt)
                except Exception as e:  # noqa: BLE001
                    errors.append(f"{getattr(provider, '__name__', 'provider')}: {e}")
                    if not again(e):
                        break
        raise RuntimeError("; ".join(errors) or "no provider")

    return ask


def generate(chunks: DataFrame, write: Callable[[str], str], verify: Callable[[str, list[dict]], set[int]], *, qtype: str = "mcq", level: str = "medium", count: int = 10) -> DataFrame:
    """Raw questions of the chunks that a second pass accepts: chunk_id, question, options, answer, explanation, qtype, difficulty, marks.

    A chunk whose reply can't be read gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, body in batch.itertuples(index=False):
                try:
                    reply = parse_json(write(body))
                    asked = [q for q in (reply or {}).get("questions", []) if isinstance(q, dict)][:PER_CHUNK]
                    accepted = verify(body, asked)
                except Exception:  # noqa: BLE001
                    continue
                rows += [(chunk_id, *(str(q.get(k, "")).strip() for k in ("question", "answer", "explanation")), [str(o) for o in q.get("options") or []]) for i, q in enumerate(asked) if i in accepted]
            yield pd.DataFrame(rows, columns=["chunk_id", "question", "answer", "explanation", "options"])

    raw = chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, question string, answer string, explanation string, options array<string>")
    return valid_questions(raw, qtype).withColumns({"qtype": F.lit(qtype), "difficulty": F.lit(scores.DIFFICULTY[level]), "marks": F.lit(scores.MARKS[qtype])}).limit(count)


def judged(raw: DataFrame, qtype: str) -> DataFrame:
    """Adds the tidied texts and ok; options lose their letters."""
    q, e = text.tidy(F.col("question")), text.tidy(F.col("explanation"), explanation=True)
    out = raw.withColumns({"question": q, "explanation": e})
    bad = (F.col("question") == "") | (F.col("answer") == "") | F.col("question").rlike(NAMES_SOURCE) | F.col("question").rlike(BROKEN) | F.col("answer").rlike(BROKEN) | F.col("question").rlike(POINTS_AT_TEXT)
    bad = bad | is_bad(F.concat_ws(" ", "question", *([] if qtype == "mcq" else ["answer"]), "explanation"))
    if qtype != "mcq":
        return out.withColumn("ok", ~bad)
    bare = F.transform("options", text.option_text)
    bad = bad | (F.size("options") != 4) | F.exists("options", lambda o: o.rlike(NAMES_SOURCE) | o.rlike(BROKEN)) | is_bad(F.array_join("options", " "))
    out = out.withColumn("_bad", bad).withColumn("options", bare)
    distinct = F.size(F.array_distinct(F.transform("options", F.lower))) == 4
    letter = text.answer_letter(F.col("answer"))
    return out.withColumn("ok", ~F.col("_bad") & distinct & ~F.array_contains("options", "") & letter.isNotNull()).withColumn("answer", letter).drop("_bad")


def valid_questions(raw: DataFrame, qtype: str, *, seed: str = "options") -> DataFrame:
    """The usable questions; options are put in an order drawn by hash, and the answer's letter follows."""
    good = judged(raw, qtype).where("ok").drop("ok")
    if qtype != "mcq":
        return good.withColumn("options", F.lit(None).cast("array<string>"))
    answer = F.get("options", text.letter_index(F.col("answer")))
    order = F.transform(F.array_sort(F.transform("options", lambda o: F.struct(F.md5(F.concat(o, F.lit(seed), F.col("question"))).alias("h"), o.alias("o")))), lambda x: x["o"])
    out = good.withColumn("answer_text", answer).withColumn("options", order)
    return out.withColumn("answer", F.substr(F.lit("ABCD"), F.array_position("options", F.col("answer_text")).cast("int"), F.lit(1)))
