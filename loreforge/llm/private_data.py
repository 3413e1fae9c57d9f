"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from strict patterns and stay.  Looser patterns propose further
candidates in the text that the base spans of the kind leave.  Five labelers vote on
every base span and candidate (for, against, or abstaining): the strict pattern, a
check of its digits, a gazetteer, the words before it, and its edges.  The votes'
patterns, at most 3**5 for each kind and feature mask, are counted over all rows;
expectation-maximisation estimates each labeler's reliability from these counts and
gives every pattern a probability, on which a linear classifier of span features is
trained for each kind.  Its features are the gazetteer, the words before, and the span's
form, length and place in its line, which no labeler sees.  Candidates that it accepts
are added.

Places are prefix sums of the lengths of matches and of the pieces between them,
taken in blocks, so that a text with very many matches costs little more than in
proportion.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match to the stated patterns, but possessive and anchored to a run's start, so that long runs cost linear time and no stack.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a strict match; cheap to look for.
HINTS = {"email": "contains({t}, '@')", "ip": r"{t} rlike '[0-9][.][0-9]'", "card": r"{t} rlike '[0-9][\\x20-]?[0-9]'", "phone": "contains({t}, '+')"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID = {"email": "true", "ip": rf"<x> rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'", "card": "length(<d>) between 14 and 19 and luhn_check(<d>)", "phone": "length(<d>) between 10 and 15"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+[\[({][Aa][Tt][\])}]\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?+[\[({][Dd][Oo][Tt][\])}]\x20?+)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{14,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
LOOSE_HINTS = {"email": r"{t} rlike '[\\[({{][Aa][Tt][\\])}}]'", "ip": r"{t} rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:'", "card": r"{t} rlike '[0-9]{{4}}[\\x20-]?[0-9]{{4}}'", "phone": r"{t} rlike '[0-9]{{3}}[)\\x20.-]{{1,2}}[0-9]{{3}}[\\x20.-][0-9]{{4}}'"}
#: Gazetteers: top-level domains, reserved addresses, card issuers' first digits, calling codes.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|ai|eu|de|fr|es|it|uk|us|ca|nl|be|ch|at|pl|se|no|dk|fi|pt|ie|cz|gr|ru|cn|jp|kr|in|br|mx|ar|cl|au|nz|za|tr|ua|ro|hu"
RESERVED = r"^(?:0|10|127|255|169[.]254|192[.]168|22[4-9]|2[345][0-9])[.]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64|65|62|50|5[6-9]|6[37])"
CALLING = r"^[+](?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {"email": "mail|correo|courriel|contact|kontakt|write to|addr", "ip": "ip|host|server|addr|ping|client|ssh", "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|pan|account", "phone": "phone|tel|call|fax|mobile|cell|sms|fono|numm|contact"}
AGAINST = "isbn|issn|doi|order|invoice|version|serial|sku|ref|commit|build|release|rfc|section"
NEAR, BLOCK = 32, 256
#: Characters from which a span of its kind is long.
LONG_SPAN = {"email": 30, "ip": 13, "card": 17, "phone": 14}
FEATURES = 8
ROUNDS = 60


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(k: str, x: str) -> str:
    return VALID[k].replace("<x>", x).replace("<d>", _digits(x))


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(text: str, pattern: str, hint: str) -> tuple[Column, Column]:
    """The matches in order, and the pieces between them (one more); both null without matches."""
    found = f"regexp_extract_all({text}, '{_sql(pattern)}', 0)"
    return F.expr(f"case when {hint.format(t=text)} then {found} end"), F.expr(f"split({text}, '{_sql(pattern)}', -1)")


def _places(m: str, p: str) -> tuple[str, str]:
    """SQL for an array of all matches' ends' sums by block, and for the end of match i, given m and p."""
    steps = f"transform({m}, (x, i) -> cast(length(x) + length({p}[i]) as bigint))"
    blocks = f"transform(sequence(0, (size({m}) - 1) div {BLOCK}), b -> aggregate(slice(steps, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))"
    return steps, blocks


def _candidates(k: str, m: str, p: str, strict: bool) -> str:
    """SQL: an array of (s, k, e, b, v, f) of the matches m: start, kind's place, end, base or not, votes and features."""
    n = KINDS.index(k)
    x, d = "c.x", _digits("c.x")
    ok = _valid(k, x) if strict else "true"
    if k == "card":
        check = f"luhn_check({d})"
        known = f"{d} rlike '{ISSUERS}'"
    elif k == "phone":
        check = "true" if strict else rf"{d} rlike '^[2-9][0-9]{{2}}[2-9]'"
        known = f"{x} rlike '{CALLING}'" if strict else "cast(null as boolean)"
    elif k == "ip":
        check = "true"
        known = f"case when {x} rlike '{RESERVED}' then false end"
    else:
        check = rf"{x} rlike '[A-Za-z]{{2,24}}$'"
        known = f"lower({x}) rlike '[^a-z](?:{DOMAINS})$'"
    cue, anti = f"lower(c.before) rlike '{CUES[k]}'", f"lower(c.before) rlike '{AGAINST}'"
    edge = r"not (c.before rlike '[\\p{L}\\p{N}_]$' or c.after rlike '^[\\p{L}\\p{N}_]')"
    made = (
        f"transform({m}, (x, i) -> named_struct('x', x, 'e', element_at(sums, cast(i div {BLOCK} as int) + 1) + aggregate(slice(steps, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (s, y) -> s + y),"
        f" 'before', right({p}[i], {NEAR}), 'after', left({p}[i + 1], 1)))"
    )
    judged = (
        f"transform(filter({made}, c -> {ok}), c -> named_struct('s', c.e - length(c.x), 'k', {n}, 'e', c.e, 'b', {str(strict).lower()},"
        f" 'check', {check}, 'known', {known}, 'cue', {cue}, 'anti', {anti}, 'edge', {edge}, 'parted', c.x rlike '[\\\\x20().-]',"
        f" 'repeats', c.x rlike '([0-9A-Za-z])\\\\1\\\\1\\\\1', 'long', length(c.x) >= {LONG_SPAN[k]}, 'opens', c.before rlike '(?:^|\\\\n)[\\\\x20\\\\t]*$', 'closes', c.after rlike '^[\\\\n.,;:!?)]|^$'))"
    )
    vote = lambda yes, no: f"case when {yes} then 2 when {no} then 0 else 1 end"
    votes = [vote("j.b", "false"), vote("j.check", "not j.check"), vote("j.known", "not j.known"), vote("j.cue", "j.anti"), vote("j.edge", "not j.edge")]
    bits = ["coalesce(j.known, false)", "j.cue", "j.anti", "j.parted", "j.repeats", "j.long", "j.opens", "j.closes"]
    v = " + ".join(f"{3**i} * ({x})" for i, x in enumerate(votes))
    f = " + ".join(f"if({x}, {1 << i}, 0)" for i, x in enumerate(bits))
    return f"transform({judged}, j -> named_struct('s', j.s, 'k', j.k, 'e', j.e, 'b', j.b, 'v', cast({v} as int), 'f', cast({f} as int)))"


_NONE = "cast(array() as array<struct<s:bigint,k:int,e:bigint,b:boolean,v:int,f:int>>)"


def _find(df: DataFrame, k: str, text: str, pattern: str, hint: str, strict: bool, out: str) -> DataFrame:
    """Adds the candidates of one pattern as ``out`` and leaves m, p for the caller to drop."""
    m, p = _matches(text, pattern, hint)
    df = df.withColumn("m", m)
    df = df.withColumn("p", F.when(F.size("m") > 0, p))
    steps, blocks = _places("m", "p")
    df = df.withColumn("steps", F.expr(f"case when p is not null then {steps} end"))
    df = df.withColumn("sums", F.expr(f"case when p is not null then aggregate({blocks}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))) end"))
    return df.withColumn(out, F.expr(f"case when p is not null then {_candidates(k, 'm', 'p', strict)} else {_NONE} end"))


def candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with an array of all base spans and candidates; df must not use the names that this makes (see ``spans``)."""
    made = []
    df = df.withColumn("t", text_or_empty(text))
    for k in KINDS:
        df = _find(df, k, "t", STRICT[k], HINTS[k], True, f"base_{k}")
        # The text without the base spans of this kind, at the same places.
        valid = _valid(k, "x")
        gone = f"case when p is null or size(base_{k}) = 0 then t else array_join(transform(p, (y, i) -> if(i < size(m), concat(y, transform(slice(m, i + 1, 1), x -> if({valid}, repeat('\\u0001', length(x)), x))[0]), y)), '') end"
        df = df.withColumn("rest", F.expr(gone))
        df = _find(df, k, "rest", LOOSE[k], LOOSE_HINTS[k], False, f"loose_{k}")
        made += [f"base_{k}", f"loose_{k}"]
    return df.withColumn(out, F.concat(*made)).drop(*made, "t", "m", "p", "steps", "sums", "rest")


# ---- what the votes say ------------------------------------------------------


def reliabilities(counts: dict[int, float], labelers: int = 5, rounds: int = ROUNDS) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over counted vote patterns of one kind.

    Returns the share of true spans, P(vote | class) as (class, labeler, vote), and
    each pattern's probability of being true.  It starts from the majority's vote.
    """
    patterns = sorted(counts)
    votes = np.array([[p // 3**i % 3 for i in range(labelers)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    q = 1 / (1 + np.exp(-(votes - 1.0).sum(axis=1)))
    prior, given = 0.5, np.full((2, labelers, 3), 1 / 3)
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + 2)
        for c, share in enumerate((1 - q, q)):
            for i in range(labelers):
                seen = np.array([(n * share)[votes[:, i] == v].sum() for v in range(3)]) + (1.0 if c == 0 else np.array([0.5, 1.0, 1.5]))
                given[c, i] = seen / seen.sum()
        odds = math.log(prior / (1 - prior)) + sum(np.log(given[1, i, votes[:, i]] / given[0, i, votes[:, i]]) for i in range(labelers))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return float(prior), given, dict(zip(patterns, q.tolist(), strict=True))


def span_classifier(masks: list[int], truth: list[float], n: list[float], ridge: float = 1.0) -> list[float]:
    """Weights of the features and the bias, last, of a logistic regression on soft labels."""
    x = np.array([[m >> j & 1 for j in range(FEATURES)] + [1] for m in masks], float)
    y, c = np.array(truth), np.array(n, float)
    w = np.zeros(FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES + 1), x.T @ (c * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(found: DataFrame, column: str) -> list[list[float]]:
    """A classifier for each kind, from all rows; a kind without candidates gets one that accepts nothing."""
    each = found.select(F.explode(column).alias("c")).groupBy("c.k", "c.v", "c.f").agg(F.count("*").alias("n"))
    rows = [(r.k, r.v, r.f, r.n) for r in each.collect()]  # at most 4 * 3**5 * 2**8 of them, whatever the input
    out = []
    for k in range(len(KINDS)):
        own = sorted(r[1:] for r in rows if r[0] == k)
        counts: dict[int, float] = {}
        for v, _, n in own:
            counts[v] = counts.get(v, 0) + n
        if not counts:
            out.append([0.0] * FEATURES + [-1.0])
            continue
        _, _, truth = reliabilities(counts)
        out.append(span_classifier([f for _, f, _ in own], [truth[v] for v, _, _ in own], [n for _, _, n in own]))
    return out


def _accepted(column: str, weights: list[list[float]]) -> str:
    """SQL: the base spans and the candidates that the classifier accepts, as (s, k, e) in order of place, then kind."""
    table_ = "array(" + ",".join("array(" + ",".join(f"{w!r}D" for w in row) + ")" for row in weights) + ")"
    score = f"aggregate(sequence(0, {FEATURES - 1}), {table_}[c.k][{FEATURES}], (s, j) -> s + if((shiftright(c.f, j) & 1) = 1, {table_}[c.k][j], 0D))"
    return _ordered(f"filter(`{column}`, c -> c.b or {score} >= 0)")


def _ordered(spans: str) -> str:
    return f"array_sort(transform({spans}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)))"


def _listed(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat_ws(':', {names}[c.k], cast(c.s as string), cast(c.e as string))), ',')"


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    A null text is an empty one and has no spans.  Places count code points, ends are
    exclusive.  Rows are independent but for the classifier, which all rows train, so
    repeated rows get equal results; ties of place are in the order of KINDS.  No
    rows: no rows.
    """
    found = written(candidates(df.select(F.col(key).alias("id"), F.col(text).alias("body")), "body", "c").select("id", "c"), "spans")
    weights = train(found, "c")
    out = found.select("id", F.expr(_ordered("filter(c, x -> x.b)")).alias("base"), F.expr(_accepted("c", weights)).alias("all"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("id").alias(key), *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("all")).alias("spans"), F.expr("cast(size(all) - size(base) as bigint)").alias("n_added"))


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The table with every span of its texts replaced by its kind, as in ``[EMAIL]``; spans that overlap become one, named after the first.

    The labelers' reliabilities and the classifier are fitted on the table itself, so
    other rows may decide whether a candidate beyond the base spans is replaced.
    ``length``, where the table has such a column, becomes the new text's code
    points in the rows that change.  All else stays; null texts stay null.
    """
    inner = [f"x{i}" for i in range(len(df.columns))]
    found = written(candidates(df.toDF(*inner), inner[df.columns.index(text)], "c"), "redact")
    merged = "aggregate(a, cast(array() as array<struct<s:bigint,k:int,e:bigint>>), (m, c) -> if(size(m) > 0 and c.s < element_at(m, -1).e, concat(slice(m, 1, size(m) - 1), array(named_struct('s', element_at(m, -1).s, 'k', element_at(m, -1).k, 'e', greatest(element_at(m, -1).e, c.e)))), concat(m, array(c))))"
    at = inner[df.columns.index(text)]
    names = "array(" + ",".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    parts = f"transform(r, (c, i) -> concat(substring({at}, cast(if(i = 0, 0, r[i - 1].e) as int) + 1, cast(c.s - if(i = 0, 0, r[i - 1].e) as int)), {names}[c.k]))"
    out = found.withColumn("a", F.expr(_accepted("c", train(found, "c")))).withColumn("r", F.expr(merged))
    out = out.withColumn("n", F.expr(f"case when size(r) = 0 then {at} else concat(array_join({parts}, ''), substring({at}, cast(element_at(r, -1).e as int) + 1)) end"))
    final = []
    for name, x in zip(df.columns, inner, strict=True):
        if name == text:
            final.append(F.col("n").alias(name))
        elif length is not None and name == length:
            final.append(F.expr(f"case when size(r) > 0 then length(n) else {x} end").cast(df.schema[name].dataType).alias(name))
        else:
            final.append(F.col(x).alias(name))
    return out.select(*final)


def without_private_data(spark, docs, sf_dir):
    """The documents with personal data replaced by its kind."""
    return redact(docs)


def op3_weak_supervision(spark, sf_dir):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    return spans(table(spark, sf_dir, "documents"))
