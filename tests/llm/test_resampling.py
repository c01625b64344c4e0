"""Importance resampling against plain counting, sorting, and the distribution that Gumbel top-k draws from."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import resampling as R


def plain_weights(docs, target):
    hasher = R.Hasher()
    grams = lambda t: [int(b) for found in hasher.buckets((t or "").encode()) for b in found]
    models = []
    for texts in (target, docs):
        counts = Counter(g for t in texts for g in grams(t))
        total = sum(counts.values()) + R.BUCKETS
        models.append(lambda g, c=counts, n=total: np.log((c[g] + 1) / n))
    return [sum(models[0](g) - models[1](g) for g in grams(t)) for t in docs]


def test_weights_and_draw(spark, odd_documents):
    docs = odd_documents.unionByName(odd_documents.where("doc_id = 2"))
    target = docs.where("doc_id IN (1, 7)")
    rows = R.weigh(docs, target).collect()
    texts = docs.collect()
    want = plain_weights([r.text for r in texts], [r.text for r in target.collect()])
    key = lambda r: (str(r[0]), r[1])
    got = sorted(((r.doc_id, round(r.log_weight, 4)) if "doc_id" in r else (r.id, round(r.log_weight, 4)) for r in rows), key=key)
    assert np.allclose([g[1] for g in got], [w for _, w in sorted(zip([r.doc_id for r in texts], want), key=lambda r: (str(r[0]), round(r[1], 4)))], atol=1e-3)
    for k in (0, 3, 100):
        drawn = R.resample(docs, target, k=k).collect()
        keys = sorted((r.sample_key for r in rows), reverse=True)
        assert sorted(r.sample_key for r in drawn) == sorted(x for x in keys if k and x >= keys[min(k, len(keys)) - 1])


@pytest.mark.parametrize("seed", range(3))
def test_largest_finds_the_kth(spark, seed):
    rnd = random.Random(seed)
    values = [rnd.choice([rnd.gauss(0, 1e6), rnd.random() * 1e-9, 5.0, -1e300, 1e12]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 499):
        limit = sorted(values, reverse=True)[k - 1]
        assert sorted(r.x for r in R.largest(frame, "x", k).collect()) == sorted(v for v in values if v >= limit)


def test_gumbel_noise_draws_in_proportion():
    weights = np.log(np.array([1, 2, 3, 4]))
    wins = Counter(int(np.argmax([w + R.gumbel(f"{run}-{i}") for i, w in enumerate(weights)])) for run in range(20_000))
    assert np.allclose([wins[i] / 20_000 for i in range(4)], [0.1, 0.2, 0.3, 0.4], atol=0.015)


def test_long_texts_go_in_slices(monkeypatch):
    data = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = sorted(int(b) for f in R.Hasher().buckets(data) for b in f)
    monkeypatch.setattr(R, "SLICE", 64)
    monkeypatch.setattr(R, "KNOWN", 10)
    assert sorted(int(b) for f in R.Hasher().buckets(data) for b in f) == whole and len(whole) == 1999


def test_prefers_the_target(spark):
    folder = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(folder + "documents.parquet"), spark.read.parquet(folder + "labels.parquet")
    good = R.target_sample(docs, labels.where("doc_id % 2 = 0"))
    assert good.count() == labels.where("quality = 1 AND doc_id % 2 = 0").count() and R.target_sample(docs, labels, rows=5).count() == 5
    drawn = {r.doc_id for r in R.resample(docs, good, share=0.86).collect()}
    unseen = labels.where("doc_id % 2 = 1").collect()
    rate = lambda q: np.mean([r.doc_id in drawn for r in unseen if r.quality == q])
    assert rate(1) > 0.97 and rate(0) < 0.1


def test_empty(spark, odd_documents):
    assert R.resample(odd_documents.limit(0), odd_documents, share=0.5).count() == 0
    assert R.resample(odd_documents, odd_documents.limit(0), k=4).count() >= 4
    assert set(R.resample(odd_documents, odd_documents, share=1.0).columns) == {"doc_id", "log_weight", "n_grams", "sample_key"}
