"""Whitening against numpy on the different vectors, and exact sums against Python's numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from postsift.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 59), 1 << 59) | st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=12), st.sampled_from([0, 1]))
def test_square_sums_are_exact(rows, axis):
    values = np.array(rows, np.int64)
    assert whitening.square_sums(values, axis) == [int(v) for v in (values.astype(object) ** 2).sum(axis=axis)]


def test_centring_beyond_64_bits():
    x = np.array([[1 << 50, -5]], np.int64)
    assert whitening.centre(x, 1 << 20, [7, -3]).tolist() == [[(1 << 70) - 7, -5 * (1 << 20) + 3]]
    assert whitening.square_sums(whitening.centre(x, 1 << 20, [7, -3]), 1) == [((1 << 70) - 7) ** 2 + (5 * (1 << 20) - 3) ** 2]


def expected(vectors):
    """(n, sums, covariance, its eigenvalues and -vectors) of the different whole-number vectors, by exact fractions."""
    fit = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, own = np.linalg.eigh(v)
    return n, sums, v, values[::-1], own[:, ::-1].T


def test_whitened_vectors(spark):
    rng = np.random.default_rng(3)
    # far from zero, of very different spread, with one vector that a third of all rows repeat
    base = rng.normal(0, [30, 3, 1, 0.3, 0.1, 0.05], (120, 6)) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 4000
    vectors = [*base.astype(np.float32).tolist(), *[base[0].astype(np.float32).tolist()] * 60]
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    n, sums, v, values, own = expected(vectors)
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n} and n < len(rows)
    by_id = {(r["vec_id"], r["component"]): r for r in found}
    for k, vector in enumerate(vectors):
        x = [math.floor(256 * float(c)) for c in vector]
        for c in range(4):
            r = by_id[k, c + 1]
            assert int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            w = float(sum(float(Fraction(n * a - s, n)) * e for a, s, e in zip(x, sums, own[c]))) / math.sqrt(values[c])
            sign = np.sign(by_id[0, c + 1]["whitened"] * (np.array([math.floor(256 * float(q)) - s / n for q, s in zip(vectors[0], sums)]) @ own[c]))
            assert r["whitened"] == pytest.approx(sign * w, rel=1e-6, abs=1e-6)
            assert r["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
            assert r["identity_error"] < 1e-6


def test_unusable_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.001], "a"), (2, [0.25, 1.0], None), (2, [0.25, 1.0], None), (None, [1.5, 1.0], "b"), (3, None, "c"), (4, [], "d"),
        (5, [None, 1.0], "e"), (6, [nan, 1.0], "f"), (7, [inf, 1.0], "g"), (8, [-inf, 1.0], "h"), (9, [1.0, 2.0, 3.0], "i"), (10, [3e38, 1.0], "j"),
        (11, [-0.0, 0.0], "k"), (12, [0.0, -0.0], "l"),
    ]
    extra = "i long, j long, n long, x string, w string, id string, deviation string"
    df = spark.createDataFrame([(*r, *[None] * 3, *["y"] * 4) for r in rows], f"{SCHEMA}, {extra}")
    found = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == sorted((k, c) for k in (0, 1, 2, 2, 11, 12) for c in (1, 2))
    assert {r["n"] for r in found} == {4}  # the two zeros are one vector


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[1.0, 2.0], [1.0, 3.0]]])
def test_without_variance(spark, vectors):
    found = whitening.whiten(spark.createDataFrame([(k, v, None) for k, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(found) == 2 * len(vectors)
    for r in found:
        flat = len(set(map(tuple, vectors))) == 1 or r["component"] == 2
        assert (r["whitened"] is None) == flat and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(0.0 if flat else 1.0)


def test_query_over_the_given_table(spark):
    found = queries.QUERIES["op11_whiten_embeddings"](spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in table}
    n, sums, v, values, own = expected(list(vectors.values()))
    rows = found.collect()
    assert len(rows) == 4 * len(table)
    signs = {}
    for r in rows:
        x = [math.floor(256 * c) for c in vectors[r["vec_id"]]]
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = float(np.array([a - s / n for a, s in zip(x, sums)]) @ own[r["component"] - 1]) / math.sqrt(values[r["component"] - 1])
        if abs(w) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(w * r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(w), abs=1e-8)
        assert r["identity_error"] <= 1e-4
    assert all(len(s) == 1 for s in signs.values())
