import zlib
from collections import Counter

from loreforge.llm import sharding as S


def check(rows, got, shards=8):
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == Counter((g.doc_id, g.size, g.text_crc32) for g in got)
    by = Counter(g.shard for g in got)
    counts = [by[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(shards):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(by[s]))


def test_query(spark, documents, folder):
    got = S.op7_stratified_shards(spark, folder(documents=documents)).collect()
    check(documents.collect(), got)
    assert {g.law for g in got} == {"rows"} and {g.grown_shard for g in got} == {None}


def test_shards_match_the_mixture_in_many_cells(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 3 == 1 else f"few{i // 100}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = S.interleave(df, cell_rows=50).withColumnRenamed("crc", "text_crc32")
    got = placed.collect()
    check(df.collect(), got)
    one = {(g.doc_id, g.shard, g.slot) for g in S.interleave(df, cell_rows=10**6).collect()}
    assert one == {(g.doc_id, g.shard, g.slot) for g in got}  # cells change nothing
    source = {r[0]: r[2] for r in rows}
    for name, n in Counter(source.values()).items():
        by = Counter(g.shard for g in got if source[g.doc_id] == name)
        assert all(abs(by[s] - n / 8) <= 3 for s in range(8))


def test_few_rows_and_repeats(spark, no_documents):
    assert S.interleave(no_documents).collect() == []
    df = spark.createDataFrame([(1, "a", "x")] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    got = S.interleave(df).collect()
    check(df.collect(), got)
