import hashlib
import re
from array import array

import corpus_pipeline
from loreforge.llm import bpe_tree


def test_stages_over_sample_data(spark, sf):
    """Planted and clean rows of the sample tables through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = docs
    words = lambda t: re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split(" ")
    windows = lambda t: {tuple(w[i : i + 13]) for w in [[x for x in words(t) if x]] for i in range(len(w) - 12)}
    leaks = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows(r.text)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        came = kept.collect()
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        kept = spark.createDataFrame(rows, docs.schema)
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "toxicity":
            said = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum((i in set(ids)) == (said[i] == 0) for i in said) / len(said) > 0.9
        if name == "simhash_near_dedup":
            assert len({r.text for r in rows}) == len(rows)
        if name == "benchmark_decontamination":
            assert {r.doc_id for r in came if not leaks & windows(r.text)} == set(ids) and len(ids) < len(came)
    for r in rows:
        assert not re.search(r"[a-z.0-9]+@mail[0-9]+[.]example|[+]1 [(][0-9]{3}[)] 555", r.text)
    enc = bpe_tree.encoding(*bpe_tree.default_ranks())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        assert bytes(got[r.doc_id].ids) == array("I", ids).tobytes() and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edges(spark, documents, folder):
    sf = folder(documents=documents, labels=spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id bigint, text string"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert 5 not in got and 6 not in got and {0, 4, 7, 8, 9, 10} <= got
