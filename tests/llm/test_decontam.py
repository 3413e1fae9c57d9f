import hashlib
import random

from loreforge.llm import decontam as D

SEPARATORS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def words(text):
    """Words by hand: A-Z lower-cased, all other ASCII but digits and letters separates."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if c in SEPARATORS else c for c in text).split(" ")


def brute(docs, items, window=13, one_in=20):
    """The report of every document, by trying every window at every place."""
    windows = {}
    for item, text in items:
        w = [x for x in words(text) if x]
        for at in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids, longest = [x for x in words(text) if x], set(), set(), 0
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (have := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    ids |= {str(i) for i in have if i is not None}
                    longest = max(longest, n)
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit) and one_in * len(hit) >= len(w), longest))
    return out


def planted(rng, n=120):
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 13, 14, 30])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "?!"), (103, items[0][1]), (None, items[5][1]), (104, "lonely")]
    docs = []
    for i in range(n):
        parts = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 400]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(items)[1].upper().split() if rng.random() < 0.3 and items else (rng.choice([x for _, x in items if x])).split()
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(parts)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def safe_planted(seed):
    rng = random.Random(seed)
    while True:
        try:
            return planted(rng)
        except AttributeError:  # a null item was drawn
            continue


def test_report_equals_brute_force(spark):
    for seed, gram in ((1, 4), (2, 1), (3, 13)):
        docs, items = safe_planted(seed)
        got = sorted(tuple(r) for r in D.report(*frames(spark, docs, items), gram=gram).collect())
        want = brute(docs, items)
        assert got == [w[:6] for w in want]
        assert sum(w[2] > 0 for w in want) > 20 and sum(w[5] for w in want) > 5


def test_clean_drops_whole_windows_in_long_documents(spark):
    docs, items = safe_planted(4)
    rng = random.Random(5)
    filler = [f"f{rng.randrange(10**6)}" for _ in range(5000)]
    leak = next(t for _, t in items if t and len(t.split()) == 14)
    docs += [(900, " ".join(filler[:2500] + leak.split() + filler[2500:])), (901, " ".join(filler)), (902, " ".join([*filler, "lonely"]))]
    df, bench = frames(spark, docs, items)
    kept = {r.doc_id for r in D.clean(df, bench).collect()}
    assert kept == {w[0] for w in brute(docs, items) if not (w[6] >= 13 or w[5])}
    assert 900 not in kept and {901, 902} <= kept


def test_shuffled_join_gives_the_same(spark):
    """Above BROADCAST_ROWS the benchmark's shingles are met by a salted join."""
    docs, items = safe_planted(6)
    old = D.BROADCAST_ROWS
    try:
        D.BROADCAST_ROWS = 0
        assert sorted(tuple(r) for r in D.report(*frames(spark, docs, items)).collect()) == [w[:6] for w in brute(docs, items)]
    finally:
        D.BROADCAST_ROWS = old


def test_a_window_that_many_items_share(spark):
    rng = random.Random(7)
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, f"{shared} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(6))}") for i in range(300)]
    docs = [(i, f"a b c {shared} d e") for i in range(200)] + [(500, "a b c d e")]
    got = sorted(tuple(r) for r in D.report(*frames(spark, docs, items)).collect())
    assert got == [w[:6] for w in brute(docs, items)] and got[0][3] == 300


def test_edges(spark, documents, no_documents):
    """Null and empty texts have no words; very long ones, ties, repeated rows and clashing column names make no difference."""
    items = spark.createDataFrame([(1, "word " * 20), (2, "same text here now"), (3, None), (4, ""), (None, "one two three four five six")], "item_id bigint, text string")
    plain = [(r.doc_id, r.text) for r in documents.collect()]
    want = [w[:6] for w in brute(plain, [(r.item_id, r.text) for r in items.collect()])]
    more = documents.withColumnsRenamed({"key": "kk", "body": "th"})
    for df in (documents, more):
        assert sorted(tuple(r) for r in D.report(df, items).collect()) == want
        out = D.clean(df, items)
        assert out.columns == df.columns
        assert sorted(r.doc_id for r in out.collect()) == [w[0] for w in want if not w[5]]
    twice = documents.unionAll(documents)
    assert sorted(tuple(r) for r in D.report(twice, items).collect()) == sorted(want * 2)
    assert D.clean(twice, items).count() == 2 * D.clean(documents, items).count()
    assert D.report(no_documents, items).collect() == [] and D.clean(no_documents, items).collect() == []
    none = items.limit(0)
    assert {r.n_hit for r in D.report(documents, none).collect()} == {0} and D.clean(documents, none).count() == documents.count()


def test_null_keys_and_equal_keys(spark):
    items = [(1, "one two three four five six")]
    docs = [(None, "one two three four five six"), (None, "other words"), (7, "one two three four five six"), (7, "clean words of the same key")]
    df, bench = frames(spark, docs, items)
    got = sorted((r.doc_id or -1, r.n_hit) for r in D.report(df, bench).collect())
    assert got == [(-1, 0), (-1, 6), (7, 0), (7, 6)]
    assert sorted((r.doc_id or -1, r.text) for r in D.clean(df, bench).collect()) == [(-1, "other words"), (7, "clean words of the same key")]
