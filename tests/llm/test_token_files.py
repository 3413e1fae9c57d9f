import io
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import token_files as T
from loreforge.llm.common import scratch_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    ef = T.EliasFano.from_bytes(T.EliasFano.of(values).to_bytes())
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10000))
    assert len(T.EliasFano.of(ends).to_bytes()) * 8 / 10000 < 2.5 + np.log2(1000) + 1


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_shard_random_access():
    out = io.BytesIO()
    w = T.ShardWriter(out, 2)
    docs = [(None, [2]), (None, [5, 2]), (-3, []), (7, [1] * 700), (7, [2])]
    for key, ids in docs:
        w.add(key, np.array(ids, np.uint16))
    w.close()
    r = T.ShardReader(Source(out.getvalue()))
    assert [(k, x.tolist()) for k, x in map(r.document, range(len(r)))] == docs
    assert [(k, x.tolist()) for k, _, x in r.documents(2)] == docs


def test_query_against_the_library(spark, documents, folder):
    got = sorted(T.op2_token_files(spark, folder(documents=documents)).collect())
    library = T.word_encoder(T.default_tokenizer())
    start = 0
    for row, r in zip(sorted(documents.collect()), got, strict=True):
        ids = [*library.tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_equal_whole_texts(spark, sf):
    encode = T.WordEncoder(T.default_tokenizer(), keep=50)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text, whole in zip(texts, encode.whole(texts), strict=True):
        assert encode(text).tolist() == whole.tolist()


def test_no_documents_and_null_keys(spark, no_documents):
    assert T.write_shards(no_documents, scratch_path(spark, "t")) == []
    assert T.read_shards(spark, []).collect() == []
    df = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (-1, None)], "doc_id bigint, text string")
    got = T.read_shards(spark, T.write_shards(df, scratch_path(spark, "t"))).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, -1, 3, 3]
