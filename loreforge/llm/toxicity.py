"""Toxicity by a classifier chain: linear models in a row, each fed the earlier categories' probabilities.

The later links are trained with out-of-fold predictions of the earlier ones, since
those of a model on its own training rows are too sure to learn from.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS``, ``SAMPLE_CHARS``),
drawn by hash; scoring reads every whole text.  Features say whether a word, or a
word's first 3 to 6 letters, is in a text; a category's features are those that go
with it most by chi-square.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreforge.llm.common import bounded_batches, fresh, slices, table, text_or_empty, written

#: Bounds of the training sample: rows, and characters of their texts.
SAMPLE_ROWS, SAMPLE_CHARS = 10_000, 200_000_000
FOLDS, PER_CATEGORY, LEAST_ROWS, RIDGE, DRAW = 5, 200, 3, 1.0, "toxicity"
#: Of two features, one of which begins the other, the second chosen is left out if both are in as many texts of each kind, or in
#: more than ALIKE_ROWS of the category's and the smaller in this share of the larger's.
ALIKE, ALIKE_ROWS = 0.5, 20
PREFIXES = (3, 4, 5, 6)
#: Characters of a word whose features a scorer remembers; longer ones are looked up each time.
REMEMBERED = 40
#: Categories in the chain's order, as conditions on a row of labels; the last one decides.
CATEGORIES = (("toxic_prose", "toxic = 1 and quality = 1"), ("toxic_junk", "toxic = 1 and quality = 0"), ("toxic", "toxic = 1"))
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """``word`` and ``start*`` for its proper prefixes."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Link:
    """One linear model of the chain: weights of the features, then of the earlier links' probabilities, then the bias."""

    name: str
    weights: np.ndarray


@dataclass
class Chain:
    features: list[str]
    links: list[Link] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, on: np.ndarray) -> list[float]:
        """Of each category in order, for a text that has the features numbered ``on``."""
        out: list[float] = []
        n = len(self.features)
        for link in self.links:
            w = link.weights
            out.append(float(_sigmoid(w[on].sum() + (w[n : n + len(out)] @ np.array(out) if out else 0.0) + w[-1])))
        return out

    def scorer(self, keep: int = 500_000) -> Callable[[str], list[float]]:
        """Texts to probabilities; words seen before are remembered, up to ``keep`` of them."""
        number, seen = {f: i for i, f in enumerate(self.features)}, {}

        def of(word: str) -> list[int]:
            if len(seen) >= keep:
                seen.clear()
            got = [number[f] for f in word_features(word) if f in number]
            if len(word) <= REMEMBERED:
                seen[word] = got
            return got

        def score(text: str) -> list[float]:
            on: set[int] = set()
            for word in text_words(text):
                got = seen.get(word)
                if got is None:
                    got = of(word)
                if got:
                    on.update(got)
            return self.probabilities(np.array(sorted(on), np.int64))

        return score


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, ones: np.ndarray, n: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; row i stands for n[i] texts, ones[i] of them in the class.

    The bias comes last and isn't shrunk.  One class only: its smoothed share as bias.
    """
    total, yes = float(n.sum()), float(ones.sum())
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log((yes + 0.5) / (total - yes + 0.5))
    if yes in (0.0, total):
        return w
    full = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(full @ w)
        step = np.linalg.solve((full * (n * p * (1 - p))[:, None]).T @ full + np.diag(shrink), full.T @ (ones - n * p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit_chain(features: list[str], x: np.ndarray, ones: np.ndarray, n: np.ndarray, fold: np.ndarray, names: list[str]) -> Chain:
    """``ones``: a column for each category; equal rows of one fold may be taken together.  The threshold is the last link's best F1 out of fold."""
    chain = Chain(features)
    if not len(n):
        chain.links = [Link(name, np.append(np.zeros(len(features) + i), -30.0)) for i, name in enumerate(names)]
        return chain
    earlier = np.zeros((len(n), 0))
    for c, name in enumerate(names):
        at = np.column_stack([x, earlier])
        held_out = np.zeros(len(n))
        for f in np.unique(fold):
            rest = fold != f
            w = fit_linear(at[rest], ones[rest, c], n[rest]) if rest.any() else fit_linear(at, ones[:, c], n)
            held_out[~rest] = _sigmoid(at[~rest] @ w[:-1] + w[-1])
        chain.links.append(Link(name, fit_linear(at, ones[:, c], n)))
        earlier = np.column_stack([earlier, held_out])
    chain.threshold = best_threshold(earlier[:, -1], ones[:, -1], n)
    return chain


def best_threshold(p: np.ndarray, ones: np.ndarray, n: np.ndarray) -> float:
    """The cut in [0.05, 0.95] of the highest F1; the one nearest to a half where several are as good."""
    cuts = np.arange(5, 96) / 100
    hit = np.array([ones[p >= t].sum() for t in cuts], float)
    said = np.array([n[p >= t].sum() for t in cuts], float)
    f1 = 2 * hit / np.maximum(said + ones.sum(), 1)
    return float(min(cuts[f1 >= f1.max() - 1e-12], key=lambda t: abs(t - 0.5)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, categories, rows: int, chars: int) -> DataFrame:
    """body, c0, c1, ..., fold of at most about ``rows`` different labelled texts, written to the shared folder."""
    kinds = labels.select(F.col(key).alias("k"), *[F.coalesce(F.expr(f"cast({rule} as int)"), F.lit(0)).alias(f"c{i}") for i, (_, rule) in enumerate(categories)])
    kinds = kinds.where("k is not null").groupBy("k").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    order = F.md5(F.concat(F.lit(f"{DRAW}:"), F.col("k").cast("string")))
    total = labels.count()
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(min(1.0, 1.5 * rows / max(1, total)) * (1 << 20))
    some = F.broadcast(kinds.where(share).orderBy(order).limit(rows))
    body = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("body")).where("k is not null")
    found = written(body.join(some, "k").dropDuplicates(["k", "body"]), "labelled")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars")).first()
    part = min(1.0, rows / max(1, size.n), chars / max(1, size.chars))
    found = found.where(F.pmod(F.xxhash64("k", "body"), F.lit(1 << 20)) < int(part * (1 << 20)))
    return found.withColumn("fold", F.pmod(F.xxhash64("body"), F.lit(FOLDS)).cast("int")).drop("k")


def _select(sample: DataFrame, n: int, per_category: int) -> list[str]:
    """For each category the features that go with it most, by chi-square; at most ``n * per_category``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                bodies = part.column("body").to_pylist()
                sets = [sorted({f for w in text_words(b) for f in word_features(w)}) for b in bodies]
                which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                flat = pa.array([f for s in sets for f in s], pa.string())
                yield pa.RecordBatch.from_arrays([flat, *[part.column(f"c{i}").take(pa.array(which)) for i in range(n)]], names=["f", *[f"c{i}" for i in range(n)]])

    rows = bounded_batches(sample, 256).select("body", *[f"c{i}" for i in range(n)])
    each = rows.mapInArrow(run, ", ".join(["f string", *[f"c{i} int" for i in range(n)]]))
    seen = written(each.groupBy("f").agg(F.count("*").alias("df"), *[F.sum(f"c{i}").alias(f"a{i}") for i in range(n)]).where(F.col("df") >= LEAST_ROWS), "features")
    totals = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"t{i}") for i in range(n)]).first()
    out: dict[str, None] = {}
    for i in range(n):
        ones, all_rows = totals[f"t{i}"], totals["n"]
        if not 0 < ones < all_rows:
            continue
        a, df = F.col(f"a{i}").cast("double"), F.col("df").cast("double")
        excess = a * all_rows - df * ones
        chi = F.when(excess > 0, excess * excess / (df * (all_rows - df + 0.5) * ones * (all_rows - ones)))
        counts = ["df", *[f"a{j}" for j in range(n)]]
        taken: list[tuple] = []  # of this category: words without the mark of a start, and their texts
        for r in seen.select("f", chi.alias("chi"), *counts).where("chi is not null").orderBy(F.desc("chi"), F.length("f"), "f").limit(8 * per_category).collect():
            # What a chosen feature begins, or begins with, is in the same texts, or all but some; it would keep out rarer words.
            bare, at, has = r.f.rstrip("*"), r[f"a{i}"], tuple(r[c] for c in counts)
            if any((bare.startswith(x) or x.startswith(bare)) and (has == texts or min(at, texts[i + 1]) >= max(ALIKE * max(at, texts[i + 1]), ALIKE_ROWS)) for x, texts in taken):
                continue
            taken.append((bare, has))
            out[r.f] = None
            if len(taken) == per_category:
                break
    return list(out)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, categories=CATEGORIES, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, per_category: int = PER_CATEGORY) -> Chain:
    """A chain for ``categories``: (name, condition on a row of labels) in order; a condition that is null counts as false.

    Several label rows of one key are taken together: a category holds if any of
    them says so.  Keys that are null or have no text aren't used.  Without labelled
    texts every probability is 0; a category with one class only gets a constant.
    """
    names = [n for n, _ in categories]
    sample = _sample(docs, labels, key, text, categories, rows, chars)
    chosen = _select(sample, len(names), per_category)
    number = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [np.array(sorted({number[f] for w in text_words(b) for f in word_features(w) if f in number}), np.int32).tobytes() for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.binary()), *batch.columns[1:]], names=["on", *batch.schema.names[1:]])

    cols = [*[f"c{i}" for i in range(len(names))], "fold"]
    got = sample.select("body", *cols).mapInArrow(run, ", ".join(["on binary", *[f"{c} int" for c in cols]])).collect()  # at most ``rows`` of them, each of at most 4 bytes a feature
    rows_: dict[tuple, np.ndarray] = {}
    for r in got:
        at = rows_.setdefault((r.fold, bytes(r.on)), np.zeros(len(names) + 1))
        at += [1, *(r[c] for c in cols[:-1])]
    keys = sorted(rows_)
    x = np.zeros((len(keys), len(chosen)))
    for i, (_, on) in enumerate(keys):
        x[i, np.frombuffer(on, np.int32)] = 1
    y = np.array([rows_[k] for k in keys]).reshape(len(keys), len(names) + 1)
    return fit_chain(chosen, x, y[:, 1:], y[:, 0], np.array([f for f, _ in keys], int), names)


def score(df: DataFrame, chain: Chain, text: str = "text", *, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The table, or the columns ``keep`` of it, with a probability for each link and, last, the decision, named ``columns`` (free names by default).

    A null text is an empty one.  Rows are independent; all columns and repeated
    rows stay as they are.
    """
    kept = df.columns if keep is None else keep
    names = columns or fresh(kept, *[f"p_{link.name}" for link in chain.links], "is_toxic")
    schema = T.StructType([*[df.schema[k] for k in kept], *[T.StructField(n, T.DoubleType()) for n in names[:-1]], T.StructField(names[-1], T.BooleanType())])
    at, out = df.columns.index(text), [df.columns.index(k) for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = chain.scorer()
        for batch in batches:
            for part in slices(batch, 256):
                p = [of(t or "") for t in part.column(at).to_pylist()]
                made = [pa.array([x[i] for x in p], pa.float64()) for i in range(len(chain.links))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in out), *made, pa.array([x[-1] >= chain.threshold for x in p], pa.bool_())], names=[*kept, *names])

    return bounded_batches(df).mapInArrow(run, schema)


def op1_toxicity_chain(spark, sf_dir):
    """doc_id, a probability for each category, and toxic (boolean) of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = fit(docs, labels)
    names = [*[f"p_{n}" for n, _ in CATEGORIES], "toxic"]
    return score(docs.select("doc_id", "text"), chain, columns=names, keep=["doc_id"])


def without_toxic(spark, docs, sf_dir):
    """The rows whose text the chain, fitted on these rows' labels in ``sf_dir``, doesn't find toxic."""
    chain = fit(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs.columns, *[f"p_{n}" for n, _ in CATEGORIES], "is_toxic")
    return score(docs, chain, columns=names).where(~F.col(names[-1])).select(*docs.columns)
