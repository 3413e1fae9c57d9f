import random

import numpy as np

from loreforge.llm import toxicity as X


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic, quality = rng.random() < 0.2, rng.random() < 0.7
        text = rng.choices(words, k=rng.randint(20, 80))
        if toxic:
            text += rng.choices(["grunk", "blarg", "snortling", "snorted"], k=3)
        if not quality:
            text += ["buy###"] * 3
        rng.shuffle(text)
        docs.append((i, " ".join(text), toxic))
        if i % 2:
            labels.append((i, int(quality), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, documents, folder):
    docs, labels = corpus()
    put = folder(documents=spark.createDataFrame(docs, "doc_id bigint, text string, toxic boolean"), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in X.op1_toxicity_chain(spark, put).collect()}
    assert len(got) == len(docs)
    unlabelled = [(got[i].toxic, t) for i, _, t in docs if not i % 2]
    assert sum(a == b for a, b in unlabelled) / len(unlabelled) > 0.98
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_toxic_prose <= 1 and 0 <= r.p_toxic_junk <= 1 for r in got.values())


def test_sample_data(spark, sf):
    """The tables' own labels: held-out rows are those that training doesn't draw."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("pmod(xxhash64(doc_id), 3) > 0"), labels.where("pmod(xxhash64(doc_id), 3) = 0")
    chain = X.fit(docs, train)
    got = X.score(docs.join(test.select("doc_id", "toxic"), "doc_id"), chain, columns=["a", "b", "c", "said"]).select("toxic", "said").collect()
    assert sum(r.said == (r.toxic == 1) for r in got) / len(got) > 0.95


def test_later_links_take_held_out_probabilities():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 5)) < 0.3).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0] * (rng.random(200) < 0.9)])
    chain = X.fit_chain(list("abcde"), x, y, np.ones(200), np.arange(200) % 5, ["one", "two"])
    assert [len(link.weights) for link in chain.links] == [6, 7]
    assert chain.links[1].weights[5] > 0
    p = chain.probabilities(np.array([0]))
    w = chain.links[1].weights
    assert np.isclose(p[1], 1 / (1 + np.exp(-(w[0] + w[5] * p[0] + w[6]))))


def test_edges(spark, documents, no_documents):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (documents, no_documents):
        chain = X.fit(docs, labels)
        assert [link.name for link in chain.links] == ["toxic_prose", "toxic_junk", "toxic"]
        assert X.score(docs, chain).count() == docs.count()
    none = X.fit(documents, labels.limit(0))
    assert {r.is_toxic for r in X.score(documents, none).collect()} == {False}
    assert X.score(documents, none).drop("p_toxic_prose", "p_toxic_junk", "p_toxic", "is_toxic").columns == documents.columns
    assert max(none.probabilities(np.array([], int))) < 1e-9


def test_one_class_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "c")], "doc_id bigint, text string")
    chain = X.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert [r.is_toxic for r in X.score(docs, chain).collect()] == [False] * 4


def test_rare_kinds_are_learned(spark):
    """A tenth of the toxic texts is in another language, whose words are far behind in chi-square."""
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(3000):
        toxic = rng.random() < 0.15
        text = [f"w{rng.randrange(400)}" for _ in range(40)]
        if toxic:
            text += [f"zorq{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(3)] if rng.random() < 0.1 else rng.sample(["grunk", "blarg", "snort", "fleem", "krill", "plonk", "dweeb", "twerp", "nitwit", "dolt"], 4)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    chain = X.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").where("doc_id % 2 = 0"))
    got = {r.doc_id: r.is_toxic for r in X.score(df, chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels if i % 2) / 1500 > 0.995


def test_scores_against_a_plain_version(spark):
    """Every link's probability from whole feature sets, one word at a time; words of any length count."""
    long = "snort" * 40
    docs = [(i, f"{'word other '}{'grunk' if i % 3 == 0 else 'calm'} {long if i % 4 == 0 else ''} w{i % 7} Grunkish", int(i % 3 == 0 or i % 4 == 0)) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n int")
    labels = spark.createDataFrame([(i, i % 2, t) for i, _, t in docs], "doc_id bigint, quality int, toxic int")
    chain = X.fit(df, labels)
    assert any(f.startswith("sno") for f in chain.features)
    names = [*[f"p_{n}" for n, _ in X.CATEGORIES], "said"]
    got = {r.doc_id: r for r in X.score(df, chain, columns=names).collect()}
    kept = {r.doc_id: r for r in X.score(df, chain, columns=names, keep=["doc_id"]).collect()}
    for i, text, toxic in docs:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split())
        has = words | {f"{w[:n]}*" for w in words for n in (3, 4, 5, 6) if len(w) > n}
        earlier = []
        for link in chain.links:
            z = sum(w for f, w in zip(chain.features, link.weights, strict=False) if f in has)
            z += sum(w * p for w, p in zip(link.weights[len(chain.features) :], earlier, strict=False)) + link.weights[-1]
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose([got[i][n] for n in names[:-1]], earlier) and got[i].said == (earlier[-1] >= chain.threshold) == bool(toxic)
        assert tuple(kept[i]) == (i, *got[i][3:])
