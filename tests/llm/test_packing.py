"""Packing: ids against the tokenizers library, the plan against best fit piece by piece."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from postsift.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return packing.Encoder(file.read(), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab  \n\té'sll0<|>endoftext漢\x1c\x85\xa0²_ ", max_size=80) | st.just("<|endoftext|> a" + "b" * 200))
def test_ids_are_those_of_the_library(encoder, library, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library(text)


def test_both_expressions_agree(encoder):
    """On every character that the plain expression may meet, alone and beside letters, digits, marks and spaces."""
    for c in map(chr, range(0x2070)):
        if not packing._ODD.search(c):
            text = f"{c} a{c}a 1{c}1 .{c}. {c}{c}  {c}\n{c}"
            assert encoder.plain.findall(text) == encoder.split.findall(text), hex(ord(c))
    assert encoder.plain is not encoder.split and packing.plain_pattern(r"\p{Lu}+") is None


def test_long_texts_and_forgetting(encoder, library, monkeypatch):
    monkeypatch.setattr(packing, "LONG_CHARS", 100)
    monkeypatch.setattr(packing, "PART", 7)
    monkeypatch.setattr(packing, "KNOWN", 5)
    text = "It's a long text,  with 1234 numbers\n\n and words. " * 40
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library(text)


def best_fit(counts, capacity):
    """Rooms left by best fit over falling lengths, piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append(min(fitting, default=capacity) - length)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([5, 16, 40]).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 12), max_size=12))))
def test_plan_is_best_fit(given_counts):
    capacity, counts = given_counts
    taken, sequences = Counter(), {}
    for slot in packing.plan(counts, capacity):
        for rank in range(slot.rank_from, slot.rank_to):
            at = rank - slot.rank_from
            taken[slot.length, rank] += 1
            offset = slot.offset_from + at % slot.per_sequence * slot.length
            sequences.setdefault(slot.sequence_from + at // slot.per_sequence, []).append((offset, slot.length))
    assert taken == Counter({(length, rank): 1 for length, n in counts.items() for rank in range(n)})
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in parts) for parts in sequences.values()) == best_fit(counts, capacity)


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(2)
    counts = {n: int(c) for n, c in enumerate(rng.integers(1, 1000, 1024), 1)}
    few = packing.plan(counts)
    many = packing.plan({n: c * 1_000_003 for n, c in counts.items()})
    assert len(few) < 8000 and len(many) < 8000


def test_plan_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan({17: 1}, 16)


def check(rows, texts, library, capacity=1024):
    """Every document whole, every sequence gapless; returns the number of sequences."""
    wanted = Counter()
    for doc_id, text in texts:
        ids = np.array([*library(text), 2], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        start = 0
        for piece, end in enumerate([first, *range(first + capacity, len(ids) + 1, capacity)]):
            wanted[doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
            start = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_query_over_the_given_table(spark, documents, library):
    rows = queries.QUERIES["op12_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], library)
    counts = Counter(r["length"] for r in rows)
    assert n == len(best_fit(counts, 1024))
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_odd_documents(spark, odd_documents, library):
    packed = packing.pack_documents(odd_documents.repartition(5), PATH, public_tokenizers.PATTERN)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in odd_documents.collect()], library)
    empty = packing.pack_documents(odd_documents.limit(0), PATH, public_tokenizers.PATTERN)
    assert empty.collect() == []


def test_one_length_holds_all(spark, library):
    """Thousands of equal pieces over many partitions: ranks within one length."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same text' AS text").repartition(23)
    rows = packing.pack_documents(docs, PATH, public_tokenizers.PATTERN, capacity=16).collect()
    n = check(rows, [(k, "same text") for k in range(3000)], library, 16)
    assert n == 3000 // (16 // rows[0]["length"])


def test_sequences_hold_the_tokens(spark, documents, library):
    packed = packing.pack_documents(documents, PATH, public_tokenizers.PATTERN, capacity=64, keep_ids=True)
    found = packing.sequences(packed).collect()
    by_sequence = {r["sequence_id"]: r for r in found}
    texts = {r["doc_id"]: np.array([*library(r["text"]), 2]) for r in documents.collect()}
    for r in packed.collect():
        ids = by_sequence[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert ids == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist() == r["ids"]
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in found)
