import hashlib
import random
from array import array

from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import bpe_tree as B

ENC = B.encoding(*B.default_ranks())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t  ab'sdé1²　中!.\x1c\x85\U0001f600"), max_size=150), st.integers(1, 9), st.integers(1, 9))
def test_tree_equals_the_library(text, leaf, window):
    assert list(B.encode_tree(text, ENC.encode_ordinary, leaf, window)) == ENC.encode_ordinary(text)


def test_join_is_associative():
    rng = random.Random(3)
    for _ in range(50):
        parts = ["".join(rng.choices("ab  '\ns1", k=rng.randint(0, 40))) for _ in range(3)]
        a, b, c = [array("I", ENC.encode_ordinary(p)) for p in parts]
        x, y, z = parts
        left = B.join(x + y, B.join(x, a, y, b, ENC.encode_ordinary, 3), z, c, ENC.encode_ordinary, 3)
        right = B.join(x, a, y + z, B.join(y, b, z, c, ENC.encode_ordinary, 3), ENC.encode_ordinary, 3)
        assert list(left) == list(right) == ENC.encode_ordinary(x + y + z)


def test_query_against_brute_force(spark, documents, folder):
    got = {r.doc_id: r for r in B.op10_bpe_tree(spark, folder(documents=documents)).collect()}
    for row in documents.collect():
        text = row.text or ""
        ids = ENC.encode_ordinary(text)
        r = got.pop(row.doc_id)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not got


def test_no_documents(no_documents):
    assert B.encode_column(no_documents, ["doc_id"]).collect() == []
