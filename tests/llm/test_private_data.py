import hashlib
import random
import re

from loreforge.llm import private_data as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(k, x):
    d = re.sub("[^0-9]", "", x)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]()


def brute_force(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if valid(k, m[0])]
    return ",".join(f"{P.KINDS[i]}:{a}:{b}" for a, i, b in sorted(found))


PIECES = ["a.b@c.de", "@", ".", "x_y", "é", "\U0001f600", " ", "-", "+", "1.2.3.4", "256.1.1.1", "10.0.0.000255", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "(743) 555-3824", "12", "0", "mail ", "\n", "1.2.3.4.5.6.7.8", "me [at] host [dot] org", "card 4111 1111 1111 1111 1234"]


def random_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def check(spark, df, folder):
    got = {r.doc_id: r for r in P.op3_weak_supervision(spark, folder(documents=df)).collect()}
    for row in df.collect():
        base, r = brute_force(row.text or ""), got[row.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (row.text, base, r.spans)
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s.startswith(k + ":") for s in base.split(",")) for k in P.KINDS]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_added == len(list(filter(None, r.spans.split(",")))) - len(list(filter(None, base.split(","))))
    return got


def test_base_spans_against_brute_force(spark, documents, folder):
    texts = [*random_texts(400), "a" * 50000, "1 " * 30000, "1.2.3.4 " * 3000, "a@b.c " * 3000, "a@b" + ".c" * 20000, "+" * 20000 + "1" * 12, "9" * 60000, "+1" + " " * 50000]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    check(spark, documents.unionByName(extra, allowMissingColumns=True), folder)


def test_sample_data(spark, sf, folder):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), folder)


def test_candidates_are_added_and_redacted(spark, folder):
    rng = random.Random(1)
    cards = ["4111 1111 1111 1111 1234", "no 5500005555555559 12"]
    texts = [f"call +1 (5{i:02d}) 555-{i:04d} or mail u{i}@host.com, card 4111111111111111" for i in range(60)] + cards * 10 + ["phone (743) 555-3824 today", "plain text, 3 words", "write me [at] host [dot] org"] * 5
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, len(t), "c") for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint, c string")
    got = check(spark, df, folder)
    assert all(got[i].n_added == 1 for i, t in enumerate(texts) if t.startswith(("4111", "no 55", "phone", "write")))
    out = {r.doc_id: r for r in P.redact(df).collect()}
    assert P.redact(df).columns == df.columns
    for i, t in enumerate(texts):
        r = out[i]
        assert r.n_chars == len(r.text) and r.c == "c"
        assert not re.search(r"@|[0-9]{10}|555-", r.text)
        if t.startswith("plain"):
            assert r.text == t
        if t.startswith("call"):
            assert r.text == "call [PHONE] or mail [EMAIL], card [CARD]"


LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[({][Aa][Tt][\])}] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({][Dd][Oo][Tt][\])}] ?)[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{14,19})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}


def votes_and_features(k, x, before, after, strict):
    """What each labeler says of a span (True, False or None), and the features, one by one."""
    d, has = re.sub("[^0-9]", "", x), lambda p, t: re.search(p, t) is not None
    if k == "email":
        check, known = has("[A-Za-z]{2,24}$", x), has(f"[^a-z](?:{P.DOMAINS})$", x.lower())
    elif k == "ip":
        check, known = True, False if has(P.RESERVED, x) else None
    elif k == "card":
        check, known = luhn(d), has(P.ISSUERS, d)
    else:
        check, known = strict or has("^[2-9][0-9]{2}[2-9]", d), has(P.CALLING, x) if strict else None
    cue, anti = has(P.CUES[k], before.lower()), has(P.AGAINST, before.lower())
    edge = not ((before and (before[-1].isalnum() or before[-1] == "_")) or (after and (after.isalnum() or after == "_")))
    votes = [True if strict else None, check, known, True if cue else False if anti else None, edge]
    features = [known is True, cue, anti, has("[ ().-]", x), has(r"([0-9A-Za-z])\1\1\1", x), len(x) >= P.LONG_SPAN[k], has(r"(?:^|\n)[ \t]*$", before), has(r"^[\n.,;:!?)]|^$", after)]
    return votes, features


def found_in(text):
    """(kind, start, end, base, votes' pattern, features' mask) of all base spans and candidates."""
    out = []
    for n, k in enumerate(P.KINDS):
        rest = text
        for strict in (True, False):
            matches = list(re.finditer((PATTERNS if strict else LOOSE)[k], rest))
            edges = [0, *(m.end() for m in matches)]
            for i, m in enumerate(matches):
                if strict and not valid(k, m[0]):
                    continue
                after = rest[m.end() : matches[i + 1].start() if i + 1 < len(matches) else None][:1]
                votes, features = votes_and_features(k, m[0], rest[edges[i] : m.start()][-P.NEAR :], after, strict)
                out.append((n, m.start(), m.end(), strict, sum(3**j * {True: 2, None: 1, False: 0}[v] for j, v in enumerate(votes)), sum(f << j for j, f in enumerate(features))))
            if strict:
                for m in matches:
                    if valid(k, m[0]):
                        rest = rest[: m.start()] + "\x01" * len(m[0]) + rest[m.end() :]
    return out


def test_added_spans_against_a_row_by_row_version(spark):
    rng = random.Random(9)
    texts = random_texts(500, seed=8)
    for _ in range(300):  # labelled ones, so that votes differ
        texts.append(rng.choice(["call ", "order no ", "card: ", "isbn ", "\n", "x", "write to "]) + rng.choice(["(743) 555-3824", "4111 1111 1111 1111", "4111 1111 1111 1112", "me (at) host.com", "bob [at] b [dot] c [dot] zz", "3782 822463 10005", "1:2:3:4:5:6:7:8", "a@b.com", "+49 30 1234567", "8.8.8.8"]) + rng.choice(["", ".", " ok", "z", "\n"]))
    rows = [found_in(t) for t in texts]
    weights = []
    for k in range(4):
        counts, own = {}, {}
        for _, _, _, _, v, f in (s for r in rows for s in r if s[0] == k):
            counts[v] = counts.get(v, 0) + 1
            own[v, f] = own.get((v, f), 0) + 1
        truth = P.reliabilities(counts)[2]
        weights.append(P.span_classifier([f for _, f in sorted(own)], [truth[v] for v, _ in sorted(own)], [own[x] for x in sorted(own)]))
    score = lambda k, f: weights[k][-1] + sum(w for j, w in enumerate(weights[k][:-1]) if f >> j & 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in P.spans(df).collect()}
    added = refused = 0
    for i, r in enumerate(rows):
        want = sorted((a, k, b) for k, a, b, strict, _, f in r if strict or score(k, f) >= 0)
        assert got[i].spans == ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want), (texts[i], got[i].spans)
        added += len(want) - sum(s[3] for s in r)
        refused += len(r) - len(want)
    assert added > 30 and refused > 30


def test_reliabilities_are_recovered():
    """Labelers that are right 95, 90, 80 and 55 times of 100, independently; the fifth abstains."""
    right, prior, counts = (0.95, 0.9, 0.8, 0.55), 0.4, {}
    for truth, share in ((1, prior), (0, 1 - prior)):
        for said in range(16):
            votes = [said >> i & 1 for i in range(4)]
            n = 1e5 * share
            for v, r in zip(votes, right, strict=True):
                n *= r if v == truth else 1 - r
            key = sum(2 * v * 3**i for i, v in enumerate(votes)) + 3**4
            counts[key] = counts.get(key, 0) + n
    got, given, q = P.reliabilities(counts, rounds=1000)
    assert abs(got - prior) < 0.02
    assert all(abs(given[1, i, 2] - r) < 0.02 and abs(given[0, i, 0] - r) < 0.02 for i, r in enumerate(right))
    assert q[2 + 6 + 81] > 0.9 and q[18 + 54 + 81] < 0.1


def test_no_rows_and_nulls(spark, documents, no_documents):
    assert P.spans(no_documents).collect() == []
    assert P.redact(no_documents).collect() == []
    assert sorted(map(str, P.redact(documents).collect())) == sorted(map(str, documents.collect()))
