"""Quality rules: measures against plain counting, the estimate against planted accuracies, and labelled documents."""

import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postsift.llm import quality_rules as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dups = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or "")) if words else 0
    n = len(words)
    return n, sum(map(len, words)), symbols, dups, len(inside), n < 50 or 100 * len(inside) > 50 * n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", "\n", " ", "\t", "\x0b", " ", " ", "漢", "$%", "\x1c", "x.\n"]), max_size=60).map("".join))
def test_measures(text):
    m = Q.measure(text)
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed) == plain(text)


def test_codes_hold_the_votes():
    m = Q.measure("Some plain words. " * 3 + "\nend here.")
    votes = Q.votes_of(np.array([Q.vote_code(m)]))[0]
    assert votes.tolist() == [rule(m) for rule in Q.RULES.values()]
    assert Q.votes_of(np.array([Q.vote_code(Q.measure(None))])).tolist() == [[Q.ABSTAIN] * len(Q.RULES)]


def test_estimates_planted_accuracies():
    rng = np.random.default_rng(0)
    k, n = len(Q.RULES), 40_000
    good = rng.random(n) < 0.75
    right = np.stack([np.linspace(0.55, 0.9, k), np.linspace(0.95, 0.8, k)], axis=1)
    hit = rng.random((n, k)) < np.where(good[:, None], right[:, 1], right[:, 0])
    votes = np.where(hit == good[:, None], Q.GOOD, Q.BAD)
    votes[rng.random((n, k)) < 0.2] = Q.ABSTAIN
    codes, counts = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
    model = Q.fit(codes, counts.astype(float))
    assert abs(model.prior - 0.75) < 0.03 and np.abs(model.right - right).max() < 0.06
    chosen = dict(zip(codes, model.posterior(codes) >= 0.5))
    assert np.mean([chosen[c] for c in votes @ 3 ** np.arange(k - 1, -1, -1)] == good) > 0.9


def test_posterior_is_bayes_rule():
    model = Q.LabelModel(0.7, np.tile([0.6, 0.9], (len(Q.RULES), 1)))
    votes = [Q.BAD, Q.GOOD] + [Q.ABSTAIN] * (len(Q.RULES) - 2)
    code = 0
    for v in votes:
        code = 3 * code + v
    good, bad = 0.7 * 0.1 * 0.9, 0.3 * 0.6 * 0.4
    assert abs(model.posterior(np.array([code]))[0] - good / (good + bad)) < 1e-12


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(folder + "documents.parquet"), spark.read.parquet(folder + "labels.parquet")
    rows = Q.judge(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.label) for r in rows]) > 0.95


def test_odd_rows(spark, odd_documents):
    rows = Q.judge(odd_documents.drop("quality")).collect()
    assert len(rows) == odd_documents.count()
    texts = {}
    for r in odd_documents.collect():
        texts.setdefault(r.doc_id, []).append(plain(r.text) if len(r.text or "") < 10_000 else None)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got in texts[r.doc_id] or None in texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    kept = Q.keep_good(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert Q.judge(odd_documents.limit(0)).count() == 0 and Q.keep_good(odd_documents.limit(0)).count() == 0


def test_both_forms_agree(spark, documents):
    kept = {r.doc_id for r in Q.judge(documents).where("kept").collect()}
    assert {r.doc_id for r in Q.keep_good(documents).collect()} == kept and kept
