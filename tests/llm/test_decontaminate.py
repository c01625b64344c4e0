"""Decontamination against a plain search of every window at every place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postsift.llm import decontaminate as D
from postsift.llm.common import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain(text, items, window):
    """(hit places, item ids) by trying every window everywhere."""
    own, hit, found = plain_words(text), set(), set()
    for item, body in items:
        w = plain_words(body)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[s : s + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return hit, found - {None}


def test_words_match_the_contract():
    text = "Ab-c3 É'x\x00y \x7fz ß_ 漢字;ÄÖ\u00a0q"
    assert [w.decode() for w in words(text.encode())] == plain_words(text)
    assert words(None) == words(b"") == []


@pytest.mark.parametrize("length", [1, 2, 3, 10])
def test_wu_manber_finds_all(length):
    rnd = random.Random(length)
    for _ in range(60):
        draw = lambda n: [bytes([rnd.choice(b"abc")]) for _ in range(n)]
        pieces = [(str(k), draw(rnd.randint(length, length + 6))) for k in range(rnd.randint(1, 5))]
        text = draw(rnd.randint(0, 60))
        for _, p in pieces:
            if rnd.random() < 0.5:
                at = rnd.randint(0, len(text))
                text[at:at] = p[: length + 1]
        want = sorted(
            (at, k) for k, (_, p) in enumerate(pieces) for s in range(len(p) - length + 1)
            for at in range(len(text) - length + 1) if text[at : at + length] == p[s : s + length]
        )
        assert sorted(D.WuManber(length, pieces).find(text)) == want


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 12])
def test_against_brute_force(spark, odd_documents, block_words):
    rnd = random.Random(5)
    draw = lambda n: " ".join(rnd.choice("alpha beta gamma delta eps".split()) for _ in range(n))
    items = [(k, draw(rnd.choice([0, 1, 3, 4, 9, 25]))) for k in range(8)]
    items += [(3, "Beta, GAMMA"), (None, "alpha alpha alpha"), (99, None), (100, "some words"), (5, items[5][1])]
    texts = [(k, draw(rnd.randint(0, 60))) for k in range(40)] + [(40, items[5][1] + " tail"), (40, items[5][1] + " tail"), (None, "beta gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit("clash"))
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd_documents.select("doc_id", "text"))
    rows = D.find_contamination(docs, bench, window=4, block_words=block_words).collect()
    want = []
    for r in docs.collect():
        hit, found = plain(r.text, [(None if i is None else str(i), t) for i, t in items], 4)
        want.append((r.doc_id, len(plain_words(r.text)), sorted(hit), sorted(found)))
    key = repr
    got = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], list(r["items"])) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = D.drop_contaminated(docs, bench, window=4, block_words=block_words)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in kept.collect() if r.doc_id and r.text) == sorted(
        (r.doc_id is None, r.doc_id, r.text is None, r.text) for r in docs.collect()
        if not plain(r.text, items, 4)[0] and r.doc_id and r.text
    )


def test_odd_rows_pass_through(spark, odd_documents):
    bench = spark.createDataFrame([(1, "plain text of some words as they stand")], "item_id long, text string")
    kept = D.drop_contaminated(odd_documents, bench)
    assert kept.schema == odd_documents.schema and kept.count() == odd_documents.count() - 2
    found = D.find_contamination(odd_documents, bench)
    assert found.columns == ["doc_id", "n_words", "spans", "items"] and found.count() == odd_documents.count()
    assert found.where("doc_id = 5").first().n_words == 80_000


def test_empty_tables(spark, odd_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(odd_documents, none).where("size(spans) > 0").count() == 0
    assert D.drop_contaminated(odd_documents, none).count() == odd_documents.count()
    bench = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert D.find_contamination(odd_documents.limit(0), bench).count() == 0
