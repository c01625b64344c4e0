"""BPE against the tiktoken library and against plain merging; decoding against the standard library."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from postsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.text(max_size=80) | st.text("ab  \n\té'sll0<|>endoftext漢 ", max_size=80))
def test_encodes_as_the_library(encoder, library, text):
    assert list(encoder.encode(text)) == library.encode_ordinary(text)


def test_transducer_equals_plain_merging(ranks, encoder):
    rnd = random.Random(1)
    tokens = list(ranks)
    merges = encoder.transducer.merges
    for n in range(3000):
        if n % 3 == 0:
            piece = bytes([rnd.choice(b" a-=*0\n")]) * rnd.randint(1, 90)
        elif n % 3 == 1:
            piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4)))
        else:
            piece = bytes(rnd.choice(b"abcetnio rsthA'1\xc3\xa9\xe4\xb8") for _ in range(rnd.randint(1, 16)))
        if piece not in ranks:
            assert encoder.transducer.encode(piece) == tuple(ranks[p] for p in merges.parts(piece))


def test_neighbours_and_pruning(ranks, encoder):
    rnd = random.Random(3)
    merges, tokens = encoder.transducer.merges, list(ranks.items())
    for _ in range(5000):
        (a, i), (b, j) = rnd.choice(tokens), rnd.choice(tokens)
        assert merges.adjacent(i, j) == (merges.parts(a + b) == [a, b])


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 7)
    monkeypatch.setattr(bpe, "LONG_CHARS", 50)
    monkeypatch.setattr(bpe, "PART", 3)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    small.transducer.max_states = 10
    text = "The quick brown fox, jumping; über Äpfel und 12345 foxes!  \n" * 8
    assert list(small.encode(text)) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.binary(max_size=40) | st.text(max_size=20).map(str.encode), st.integers(1, 5))
def test_decodes_any_bytes(ranks, data, part):
    decoder = bpe.Utf8Decoder({i: t for t, i in ranks.items()})  # cheap enough: steps are found when needed
    ids = [ranks[data[i : i + 1]] for i in range(len(data))]
    text, left = "", b""
    for at in range(0, len(ids), part):
        more, left = decoder.decode(ids[at : at + part], left)
        text += more
    assert text + ("�" if left else "") == data.decode("utf-8", "replace") == decoder.text(ids)


def test_round_trip_in_spark(spark, odd_documents, library):
    encoded = bpe.encode(odd_documents, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = odd_documents.collect()
    want = sorted(((r.doc_id, library.encode_ordinary(r.text or "")) for r in rows), key=key)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=key) == want
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((r.doc_id, r.text or "") for r in rows), key=key)
    assert all(bytes(r.data) == r.text.encode() for r in back)
    assert bpe.round_trip(odd_documents.limit(0), PATH, public_tokenizers.PATTERN, keep_ids=True).count() == 0
    kept = bpe.round_trip(odd_documents, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in kept), key=key) == want and all(r.n_tokens == len(r.ids) for r in kept)
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(null, PATH).first().text == ""


def test_query_equals_the_library(spark, library, documents):
    import hashlib

    from postsift.llm import queries

    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = queries.QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
