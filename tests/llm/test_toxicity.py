"""Toxicity: gradients against differences, whole texts against slices, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import toxicity as T
from postsift.llm.common import words

FOLDER = "/root/testdata/sf0.1/"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(FOLDER + "documents.parquet"), spark.read.parquet(FOLDER + "labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return T.fit(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = T.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 500
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in held if r.lang == lang and r.toxic]
        clean = [r.predicted for r in held if r.lang == lang and not r.toxic]
        # one toxic label in eight or so stands at a text without any toxic word
        assert np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.03, lang


def test_labels_of_held_out_rows_are_not_learnt(spark, tables, model):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.fit(docs, turned)
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.thresholds, model.thresholds)
    assert T.fit(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), labels).bias == model.bias


def test_gradients():
    """A step's change of each kind of weight follows the loss, measured by differences."""
    rng = np.random.default_rng(1)
    texts = [[b"aaaa%d" % rng.integers(9) for _ in range(rng.integers(1, 12))] for _ in range(6)]
    labels = np.array([0, 1, 0, 1, 1, 0], np.float32)
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    rows = [np.array([vocabulary[w] for w in t]) for t in texts]
    buckets = np.array([[0] * (1 + len(T.BEGINNINGS)), *map(T.parts, vocabulary)])
    n = T.FILTERS * len(T.WIDTHS)

    def fresh():
        r = np.random.default_rng(3)
        vectors = r.normal(0, 0.3, (T.BUCKETS, T.DIM))
        vectors[0] = 0
        return T.Model(vectors, [r.normal(0, 0.3, (w, T.DIM, T.FILTERS)) for w in T.WIDTHS], r.normal(0, 0.1, n), r.normal(0, 0.3, n), 0.1, np.zeros(5))

    def loss(m):
        p = 1 / (1 + np.exp(-m.logits(T._pool(m, buckets, rows))))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    m, before = fresh(), fresh()
    seen = {"vectors": np.full_like(m.vectors, 1e-3), "filters": [np.full_like(f, 1e-3) for f in m.filters]}
    seen |= {"shifts": np.full_like(m.shifts, 1e-3), "weights": np.full_like(m.weights, 1e-3), "bias": 1e-3}
    T._learn(m, seen, buckets, rows, labels)
    slot = int(buckets[1][0])
    for get, moved in (
        (lambda x: (x.weights, 5), None), (lambda x: (x.shifts, 7), None), (lambda x: (x.filters[2][1], (2, 3)), None),
        (lambda x: (x.filters[0][0], (0, 1)), None), (lambda x: (x.vectors, (slot, 4)), None),
    ):
        up, down = fresh(), fresh()
        for x, step in ((up, 1e-5), (down, -1e-5)):
            array, at = get(x)
            array[at] += step
        slope = (loss(up) - loss(down)) / 2e-5
        array, at = get(m)
        change = array[at] - get(before)[0][at]
        # Adagrad: change = -rate * g / sqrt(1e-3 + g * g)
        expected = -T.RATE * slope / np.sqrt(1e-3 + slope * slope)
        assert abs(change - expected) < 2e-3


def test_long_texts_are_read_whole(model, monkeypatch):
    clean = words(b"the of and to in it is with thion ereth " * 3000)
    texts = [clean + [b"moron", b"scum", b"idiot"], [b"moron", b"scum", b"idiot"] + clean, clean, []]
    whole = T.Scorer(model).scores(texts)
    monkeypatch.setattr(T, "SLICE", 50)
    monkeypatch.setattr(T, "KNOWN", 3)
    assert np.allclose(T.Scorer(model).scores(texts), whole, atol=1e-6)
    assert whole[0] > 0.5 and whole[1] > 0.5 and whole[2] < 0.5 and whole[3] < 0.5


def test_thresholds():
    scores, labels = np.array([0.0, 1, 2, 3, 10, 11]), np.array([0, 0, 0, 0, 1, 1.0])
    assert T._best_threshold(scores, labels) == 6.5
    assert np.array_equal(T._thresholds(scores, np.zeros(6), np.zeros(6)), np.zeros(len(T.LANGUAGES)))
    many = np.concatenate([np.arange(40.0), np.arange(40.0) + 100])
    out = T._thresholds(many, np.tile(np.repeat([0.0, 1], 20), 2), np.repeat([0, 1], 40))
    assert out[0] == 19.5 and out[1] == 119.5


def test_language():
    assert [T.LANGUAGES[T.language(words(t.encode()))] for t in ("the cat of that", "der Hund und die", "le chat et les", "el gato y los", "zzz", "")] == [
        "en", "de", "fr", "es", "other", "other"]


def test_odd_rows(spark, odd_documents, model):
    rows = T.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    kept = T.drop_toxic(odd_documents, model)
    assert kept.schema == odd_documents.schema and kept.count() == sum(r.predicted == 0 for r in rows)
    assert T.score(odd_documents.limit(0), model).count() == 0


def test_odd_labels(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    assert T.score(odd_documents, T.fit(odd_documents, labels)).count() == odd_documents.count()
    untrained = T.fit(odd_documents, labels.limit(0))
    assert T.score(odd_documents, untrained).where("score IS NULL OR isnan(score)").count() == 0


def test_long_texts_are_learnt(spark):
    filler = "some plain words stand here and nothing else happens " * 450
    rows = [(i, filler + f" zorgle {i} " + filler if i % 4 == 0 else filler[: 90 + i] + f" {i}", int(i % 4 == 0)) for i in range(240)]
    assert len(rows[0][1]) > 40_000
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = T.score(table, T.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))).collect()
    assert {r.doc_id: r.predicted for r in got} == {i: toxic for i, _, toxic in rows}


def test_windows_of_long_texts_are_found_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [rng.integers(1, 40, n) for n in (0, 1, 3, 200, 49, 50, 51)]
    buckets = np.array([[0] * (1 + len(T.BEGINNINGS)), *(T.parts(b"word%d" % k) for k in range(40))])
    model = T._state(T._begin())[0]
    whole, found = T._chosen(model, buckets, rows)
    assert np.allclose(whole, np.concatenate([T._pool(model, buckets, [r]) for r in rows]), atol=1e-6)
    monkeypatch.setattr(T, "SLICE", 50)
    sliced, again = T._chosen(model, buckets, rows)
    assert np.allclose(whole, sliced, atol=1e-6) and all(np.array_equal(a, b) for a, b in zip(found, again))


def test_a_score_does_not_depend_on_the_text_beside_it():
    scorer = T.Scorer(T._state(T._begin())[0])
    texts = [[b"w%d" % (n * k) for k in range(n)] for n in range(30)]
    assert np.allclose(scorer.scores(texts), [scorer.scores([t])[0] for t in texts], atol=1e-6)


def test_shards_are_averaged_over_those_that_changed_a_number(spark):
    texts = {0: [(1, "alpha alpha common"), (0, "beta common")], 1: [(1, "gamma common"), (0, "delta common"), (0, "delta plain")]}
    rows = [(s, y, bytearray(t.encode())) for s, some in texts.items() for y, t in some]
    begin = T._begin()
    got = T._round(spark.createDataFrame(rows, "shard int, label int, data binary").repartition(2, "shard").sortWithinPartitions("shard", "data"), begin, 2)
    alone = {s: T.train(begin, [t.encode() for _, t in sorted(some, key=lambda r: r[1])], np.array([y for y, _ in sorted(some, key=lambda r: r[1])], np.float32), s, 2) for s, some in texts.items()}
    moved = {s: a != begin for s, a in alone.items()}
    only = moved[0] & ~moved[1]
    assert only.sum() > T.DIM and np.array_equal(got[only], alone[0][only])
    both = moved[0] & moved[1]
    assert both.sum() > T.DIM and np.allclose(got[both], (2 * alone[0] + 3 * alone[1])[both] / 5, atol=1e-6)
    assert np.array_equal(got[~moved[0] & ~moved[1]], begin[~moved[0] & ~moved[1]])


def test_every_row_is_learnt_or_sets_a_threshold(spark, monkeypatch):
    seen = {"learnt": 0, "counted": 0}
    turn, count = T._round, T._counts
    monkeypatch.setattr(T, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(T, "EPOCHS", 1)
    monkeypatch.setattr(T, "_round", lambda rows, *a: (seen.update(learnt=rows.count(), shards=rows.select("shard").distinct().count()), turn(rows, *a))[1])
    monkeypatch.setattr(T, "_counts", lambda rows, *a: (seen.update(counted=rows.count()), count(rows, *a))[1])
    docs = spark.range(6500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    T.fit(docs, labels)
    assert seen["learnt"] + seen["counted"] == labels.where(~T.held_out("doc_id")).count() > 5000 and seen["shards"] > 2


def test_shards_follow_the_bytes_and_not_the_partitions(spark, monkeypatch):
    """A model travels for each shard, so a join in many partitions must not make many of them."""
    frame = type(spark.range(0))
    seen, turn, repartition = {}, T._round, frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: repartition(self, max(n, 31) if isinstance(n, int) else n, *cols))
    monkeypatch.setattr(T, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(T, "EPOCHS", 1)
    monkeypatch.setattr(T, "_round", lambda rows, *a: (seen.update(shards=rows.select("shard").distinct().count()), turn(rows, *a))[1])
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"))
    T.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert 2 <= seen["shards"] <= 3


def test_texts_without_a_label_are_not_moved(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.lit("text").alias("data"))
    ids = spark.createDataFrame([(n, 0) for n in (*range(-5, 400), None, 19_999)], "id long, label int")
    got = {r.id for r in T._may_be_in(rows.dropna(), ids, 16 * 400).collect()}
    wanted = {n for n in (*range(400), 19_999) if n % 7}
    assert wanted <= got and len(got) < len(wanted) + 3000
    assert T._may_be_in(rows, ids.limit(0), 0).count() == 0
