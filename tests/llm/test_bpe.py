import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import bpe

from . import edge


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def test_every_token_is_its_own_encoding(codec):
    assert all(codec.reduce(data) == [rank] for data, rank in codec.ranks.items())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="ab =-\n\t'sté日😀0", max_size=300))
def test_as_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 3000 + "x", "=-" * 2000, "\n" * 2000, "thethe" * 1000, "é" * 1500])
def test_long_pieces(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


def test_join_is_associative(codec):
    data = b"untruthfulness in hypothetically"
    for i in range(1, len(data) - 1):
        for j in range(i + 1, len(data), 5):
            a, b, c = (codec.reduce(x) if x else [] for x in (data[:i], data[i:j], data[j:]))
            assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.merge(data)


def test_digests(spark, library):
    got = {r["doc_id"]: r for r in bpe.digests(edge.docs(spark)).collect()}
    for doc_id, text, *_ in edge.rows():
        ids, r = library.encode_ordinary(text or ""), got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(edge.empty(spark)).count() == 0


def test_encoded_keeps_columns(spark, library):
    docs = edge.docs(spark)
    out = bpe.encoded(docs)
    assert out.columns == [*docs.columns, "token_ids", "decoded"]
    for r in out.collect():
        assert r["token_ids"] == library.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")
    with pytest.raises(ValueError):
        bpe.encoded(docs, ids="n")
