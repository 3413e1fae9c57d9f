import random

import numpy as np

from loreforge.llm import near_copies as N
from loreforge.llm.simhash import majority, shingle_hashes


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, words, k):
    words = list(words)
    for at in rng.sample(range(len(words)), k):
        words[at] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5).astype(np.uint64)
    names = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for b in base])
    names = np.column_stack([names, np.repeat(base, 40)])
    a, b = N.forest(names, 2)
    assert len(a) == len(names) - 5 and set(a.tolist()) == {0, 40, 80, 120, 160}
    assert all(i // 40 == j // 40 for i, j in zip(a, b, strict=True))


def test_small_buckets_are_joined_as_large_ones():
    """Random buckets: chains of pairs within NAME_BITS, not only pairs, join rows with the least of them."""
    rng = np.random.default_rng(2)
    rows = []
    for slot in range(60):
        name = rng.integers(0, 1 << 63, 2).astype(np.uint64)
        for _ in range(rng.integers(1, N.HOT + 1)):
            if rng.random() < 0.2:
                name = rng.integers(0, 1 << 63, 2).astype(np.uint64)
            name = name ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (12, 2)).astype(np.uint64), axis=0)
            rows.append((slot, *name))
    slot, names = np.array([r[0] for r in rows]), np.array([[i, *r[1:]] for i, r in enumerate(rows)], np.uint64)
    a, b = N._near_in_buckets(slot, names)
    want = set()
    for s in range(60):
        own = np.flatnonzero(slot == s)
        want |= {(int(own[i]), int(own[j])) for i, j in zip(*N.forest(names[own][:, 1:], N.NAME_BITS), strict=True)}
    assert set(zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True)) == want and len(want) > 100


def test_a_row_whose_nearest_link_is_not_true_is_tried_again():
    names = np.column_stack([np.array([0b0, 0b1, 0b111, 0b1111], np.uint64)] * 2)
    a, b = N._near_in_buckets(np.zeros(4, np.int32), names)
    assert set(zip(a[:, 0].tolist(), b[:, 0].tolist(), strict=True)) == {(0, 0b1), (0, 0b111), (0, 0b1111)}  # one group, of which all are compared


def test_stated_share_is_found(spark):
    """Pairs of about 0.85 and more: nearly all meet in a variant; unrelated texts don't."""
    rng = random.Random(3)
    texts, pairs = [], []
    for i in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(250)]
        texts += [" ".join(words), changed(rng, words, rng.randint(1, 4))]
        if jaccard(*texts[-2:]) >= 0.83:
            pairs.append((2 * i, 2 * i + 1))
    got = {r.key: r.least for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 100 and found / len(pairs) > 0.95
    assert all(got[i] in (i, i - 1) for i in range(len(texts)))
    assert N.share_found(0.8) > 0.93 and N.share_found(0.9) > 0.99


def test_a_repeated_line_does_not_part_copies(spark):
    rng = random.Random(7)
    texts = []
    for times in (10, 20, 40, 80) * 5:
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words + [f"r{rng.randrange(10**6)}" for _ in range(9)] * times)]
    assert all(jaccard(a, b) > 0.9 for a, b in zip(texts[::2], texts[1::2], strict=True))
    got = {r.key: r.least for r in N.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all(got[i] == i - i % 2 for i in got)


def test_equal_fingerprints_are_verified(spark):
    """A line repeated so often that it would decide all 64 bits of a fingerprint; the texts have little else in common."""
    rng = random.Random(8)
    line = [f"r{i}" for i in range(9)] * 40
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(100)] + line) for _ in range(6)]
    assert all(jaccard(a, b) < 0.1 for a in texts for b in texts if a is not b)
    assert N.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).count() == 6
    hashes = [np.unique(shingle_hashes(t, 5)[0]) for t in texts]
    assert len({N._set_name(h) for h in hashes}) == 6 and N._set_name(hashes[0]) == N.text_lanes(texts[0].upper())[0]


def test_one_of_each(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)] * 5 + [changed(rng, words, 1) for _ in range(40)] + [" ".join(rng.sample(words, 200)) for _ in range(20)]
    extra = spark.createDataFrame([(1000 + i, t, 7) for i, t in enumerate(texts)] + [(1000, texts[0], 7), (None, texts[0], 7), (None, "other words of a null key here", 7)], "doc_id bigint, text string, kk int")
    df = documents.unionByName(extra, allowMissingColumns=True).repartition(5)
    out = N.one_of_each(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None and i >= 1000) == [1000, *range(1045, 1065)]
    assert ids.count(None) == 1
    empty = {r.doc_id for r in documents.collect() if not shingles(r.text)}
    kept = {i for i in ids if i is not None and i < 1000}
    assert kept & empty == {min(empty)}
    same = {r.doc_id for r in documents.collect() if r.text == "same text here now"}
    assert kept & same == {min(same)}
    # "One TWO ... six." and its lower-case copy are one text for shingles.
    assert len(kept) == len({frozenset(shingles(r.text)) for r in documents.collect()})


def test_crowds_are_linked(spark):
    """Hundreds of different near copies: buckets pass HOT, in chunks too."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, changed(rng, words, 1)) for i in range(300)], "doc_id bigint, text string")
    old = N.CHUNK
    try:
        N.CHUNK = 50
        assert [r.doc_id for r in N.one_of_each(df).collect()] == [0]
    finally:
        N.CHUNK = old


def test_buckets_do_not_end_with_batches(spark):
    """A bucket of 100 rows that are far from each other, then 100 copies of them in later Arrow batches."""
    rng = random.Random(9)
    marks = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(100)]
    rows = [(1000 * copy + i, *marks[i], *[7] * N.LANES) for copy in (0, 1) for i in range(100)]
    lanes = spark.createDataFrame(rows, "f bigint, g bigint, h bigint, " + ", ".join(f"l{i} bigint" for i in range(N.LANES)))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for size in (30, 100, 10000):
            spark.conf.set(name, str(size))
            said = {frozenset((r.a, r.b)) for r in N.candidate_links(lanes).collect()}
            assert said == {frozenset((i, 1000 + i)) for i in range(100)}
    finally:
        spark.conf.set(name, old)


def test_true_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.9], rng.integers(0, 1 << 63, 5).astype(np.uint64)])) for _ in range(60)]
    old = N.TOKENS
    try:
        for N.TOKENS in (7, 4096):
            assert N.in_common(sets, sets[:9]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[:9]] for x in sets]
            a, b = N.true_links(sets[:40], sets[40:], 0.8)
            said = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
            true = {frozenset((i, j)) for i in range(40) for j in range(40, 60) if (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
            assert 0 < len(true) < 800 and said <= true and all(len({i for p in said for i in p} & p) == 2 for p in true)
    finally:
        N.TOKENS = old


def test_every_member_of_a_crowd_meets_its_base(spark):
    """A base and 1500 edited copies: all are near the base, and under 0.8 to each other."""
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(1500):
        mine = list(words)
        for at in rng.sample(range(2, 398, 5), 8):
            mine[at] = f"z{rng.randrange(10**9)}"
        texts.append(" ".join(mine))
    assert min(jaccard(" ".join(words), t) for t in texts) > 0.81 and max(jaccard(x, y) for i, x in enumerate(texts[:60]) for y in texts[:i]) < 0.8
    rows = [*enumerate(texts), (1500, " ".join(words))]
    got = N.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).select("least", "n").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 1501)]


def test_no_documents(no_documents):
    assert N.one_of_each(no_documents).collect() == []


def test_lanes_are_independent():
    hashes = shingle_hashes(" ".join(f"w{i}" for i in range(500)), 5)[0]
    lanes = [majority(hashes), *(majority(N._mixed(hashes, i)) for i in range(N.LANES))]
    assert all(16 <= ((a ^ b) & (1 << 64) - 1).bit_count() <= 48 for i, a in enumerate(lanes) for b in lanes[:i])


def family(rng, n, length, most):
    """A text and copies of it with 0 to ``most`` words replaced: some are near the base, some near each other, most to none."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    return [" ".join(words), *(changed(rng, words, rng.randint(0, most)) for _ in range(n - 1))]


def brute_classes(texts, similarity=0.8):
    """Least index of each text's class, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n >= similarity * (len(a) + len(sets[j]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_crowded_groups_against_all_pairs(spark):
    """Groups of which most texts are under 0.8 to each other: the classes are those of all pairs, by leaders or by blocks."""
    rng = random.Random(13)
    texts = family(rng, 350, 120, 10) + family(rng, 60, 60, 4) + family(rng, 40, 200, 12)
    rng.shuffle(texts)
    want = brute_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    old = N.CHUNK, N.ROUNDS, N.LEADER_BYTES
    try:
        for N.CHUNK, N.ROUNDS, N.LEADER_BYTES in ((40, 4, old[2]), (40, 1, 0)):
            got = {r.key: r.least for r in N.classes(df).collect()}
            linked = [i for i, w in enumerate(want) if w != i]
            assert len(linked) > 100 and len({w for w in want}) > 50
            found = sum(got[i] == got[want[i]] for i in linked) / len(linked)
            assert found >= 0.97, found
            assert all(want[i] == want[got[i]] for i in got)  # nothing else is linked
    finally:
        N.CHUNK, N.ROUNDS, N.LEADER_BYTES = old


def test_verification_alone_is_exact(spark):
    """All texts as one group: what leaders and blocks link is what all pairs link."""
    rng = random.Random(14)
    texts = family(rng, 200, 100, 25) + family(rng, 50, 90, 9) + [" ".join(f"u{i}x{j}" for j in range(70)) for i in range(30)] + ["", "one two"]
    want = brute_classes(texts)
    hashes = [np.unique(shingle_hashes(t, 5)[0]) for t in texts]
    names = {i: N._set_name(h) for i, h in enumerate(hashes)}
    groups = spark.createDataFrame([(f, 7) for f in set(names.values())], "f bigint, root bigint")
    sets = spark.createDataFrame([(f, bytearray(h)) for f, h in {names[i]: h.tobytes() for i, h in enumerate(hashes)}.items()], "f bigint, hs binary")
    old = N.CHUNK, N.ROUNDS
    try:
        for N.CHUNK, N.ROUNDS in ((1000, 4), (30, 4), (30, 1), (30, 0)):
            up = {f: f for f in names.values()}

            def find(f):
                while up[f] != f:  # noqa: B023
                    f = up[f]  # noqa: B023
                return f

            for r in N.verified(groups, sets, 0.8).collect():
                up[find(r.a)] = find(r.b)
            assert all((find(names[i]) == find(names[j])) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    finally:
        N.CHUNK, N.ROUNDS = old


def test_unrelated_texts_with_a_repeated_word_stay(spark):
    rng = random.Random(15)
    texts = ["buy " * 400 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(5)]
    assert max(jaccard(a, b) for a in texts for b in texts if a is not b) < 0.01
    assert N.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).count() == 5


def test_links_between_rows_of_different_leaders_are_found(spark):
    """Chains of sets of which only neighbours are linked: a leader settles three, and links lead on from those it has settled."""
    rng = random.Random(16)
    rows, links = [], []
    for root in range(12):
        for chain in range(rng.choice([1, 1, 3])):
            n, far = rng.choice([4, 6, 7, 12]), rng.choice([9, 10])
            names = rng.sample(range(1 << 40), n)
            sets = [np.arange(i * far, i * far + 100) + (root * 10 + chain) * 10**6 for i in range(n)]
            rows += [(root, f, bytearray(x.astype(np.int64).tobytes())) for f, x in zip(names, sets, strict=True)]
            links += zip(names, names[1:], strict=False)
    groups = spark.createDataFrame([(f, root) for root, f, _ in rows], "f bigint, root bigint")
    sets = spark.createDataFrame([(f, hs) for _, f, hs in rows], "f bigint, hs binary")

    def parts(pairs):
        up = {f: f for _, f, _ in rows}

        def find(f):
            while up[f] != f:
                f = up[f]
            return f

        for a, b in pairs:
            up[find(a)] = find(b)
        found = {}
        for f in up:
            found.setdefault(find(f), set()).add(f)
        return {frozenset(x) for x in found.values()}

    old = N.CHUNK, N.ROUNDS, N.LEADER_BYTES
    try:
        for N.CHUNK, N.ROUNDS, N.LEADER_BYTES in ((3, 4, old[2]), (3, 12, 0)):
            assert parts((r.a, r.b) for r in N.verified(groups, sets, 0.8).collect()) == parts(links)
    finally:
        N.CHUNK, N.ROUNDS, N.LEADER_BYTES = old
