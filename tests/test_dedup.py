"""Exact and similarity dedup against small sequential statements of the rules."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postsift.operators import dedup, similarity
from postsift.session import Rounds

SCHEMA = "seq BIGINT, title STRING, company STRING, location STRING, salary INT, easy_apply BOOLEAN, description STRING, note STRING"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def sequential_merge(rows):
    """One pass in order, keeping one record per key."""
    kept = {}
    for row in rows:
        key = tuple((row[c] or "").strip().lower() for c in ("title", "company", "location"))
        if key not in kept:
            kept[key] = dict(row)
            continue
        before = dict(kept[key])
        if before["salary"] is None and row["salary"] is not None:
            kept[key] = {c: before[c] if before[c] is not None else row[c] for c in row}
        if before["easy_apply"] is None and row["easy_apply"] is not None:
            kept[key]["easy_apply"] = row["easy_apply"]
        if before["description"] is None and row["description"]:
            kept[key]["description"] = row["description"]
    return sorted(tuple(r.values()) for r in kept.values())


def random_rows(n, groups, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        # a third of all rows share one key
        group = 0 if rng.random() < 0.33 else rng.randrange(groups)
        title = f"{rng.choice(['', ' ', chr(9)])}{rng.choice(['T', 't'])}{group}"
        rows.append(dict(zip(NAMES, (
            seq, title, rng.choice(["", None]), "x", rng.choice([None, None, rng.randrange(9)]), rng.choice([None, None, True, False]),
            rng.choice([None, None, "", f"d{seq}"]), rng.choice([None, f"n{seq}"])))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_exact_merge(spark, seed):
    rows = random_rows(4000, 1200, seed)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    out = dedup.dedup_exact(df.repartition(7), ("seq",))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(sequential_merge(rows), key=key)
    again = dedup.dedup_exact(out, ("seq",))
    assert again.exceptAll(out).isEmpty() and again.count() == out.count()


def test_empty_as_null(spark):
    df = spark.createDataFrame([(1, "a", "", "x", None, None, "", None), (2, "a", "", "x", 5, None, "text", "n")], SCHEMA)
    assert dedup.dedup_exact(df, ("seq",)).first().description == ""
    assert dedup.dedup_exact(df, ("seq",), treat_empty_as_null=True).first().description == "text"


def test_digests_move_instead_of_texts(spark, monkeypatch):
    from postsift.plans import registry
    from tests.conftest import SF

    registry.load()
    given = []
    monkeypatch.setattr(dedup, "dedup_exact", lambda df, *a, f=dedup.dedup_exact: given.append(df) or f(df, *a))
    registry.QUERIES["dedup_exact"](spark, SF)
    assert given[0].agg(F.max(F.length("description"))).first()[0] == 16


def test_binary_descriptions(spark):
    rows = [(1, "a", None, None), (2, "a", 5, ""), (3, "a", 6, "t"), (4, "b", 1, None), (5, "b", 2, "u"), (6, "c", None, None), (7, "c", None, "v"), (8, "c", 3, "")]
    df = spark.createDataFrame(rows, "seq INT, title STRING, salary INT, description STRING").withColumns(
        {"company": F.lit(""), "location": F.lit(""), "easy_apply": F.lit(True)})
    want = {1: (5, ""), 4: (1, "u"), 6: (3, "v")}
    assert {r.seq: (r.salary, r.description) for r in dedup.dedup_exact(df, ("seq",)).collect()} == want
    out = dedup.dedup_exact(df.withColumn("description", F.col("description").cast("binary")), ("seq",))
    assert {r.seq: (r.salary, r.description) for r in out.collect()} == {k: (n, bytearray(t.encode())) for k, (n, t) in want.items()}


def test_distinct_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, ""), (4, ""), (5, None), (6, "b")], "seq INT, url STRING")
    seqs = lambda blank: sorted(r.seq for r in dedup.distinct_first(df, "url", ("seq",), blank).collect())
    assert (seqs("drop"), seqs("keep_one"), seqs("keep_all")) == ([1, 6], [1, 2, 6], [1, 2, 4, 5, 6])


# -- similarity ---------------------------------------------------------------
def greedy(vectors, tau):
    """{row: leader or None} by the sequential rule."""
    kept, fate = [], {}
    for i, v in vectors:
        if v is None or not np.any(v):
            continue
        unit = np.asarray(v, float) / np.linalg.norm(v)
        hit = next((k for k, u in kept if unit @ u >= tau), None)
        fate[i] = hit
        if hit is None:
            kept.append((i, unit))
    return fate


def clustered(n, dim, seed, spread):
    """A third of the rows are copies or near copies around one centre."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(4, n // 8), dim))
    out = []
    for i in range(n):
        draw = rng.random()
        if draw < 0.15:
            v = centres[0]
        elif draw < 0.33:
            v = centres[0] + spread * rng.standard_normal(dim)
        elif draw < 0.36:
            v = np.zeros(dim) if draw < 0.34 else None
        else:
            v = centres[rng.integers(len(centres))] + spread * rng.standard_normal(dim)
        out.append((i, None if v is None else [float(x) for x in v]))
    order = rng.permutation(n)
    return [(int(k), out[i][1]) for k, i in enumerate(order)]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, None if i % 3 else i, f"t{i}" if i % 2 else None) for i, v in vectors], "id BIGINT, vec ARRAY<DOUBLE>, salary INT, title STRING")


@pytest.mark.parametrize("chunk", [16, 2048])
def test_scan_is_the_sequential_rule(spark, chunk):
    vectors = clustered(400, 12, 1, 0.12)
    links = similarity.similar_pairs(frame(spark, vectors), "id", "vec", 0.97, blocking="exact", chunk=chunk)
    assert dict(links.collect()) == {i: k for i, k in greedy(vectors, 0.97).items() if k is not None}


def test_blocks_are_the_sequential_rule_when_nothing_is_missed(spark):
    """Few, wide blocks: every near pair meets, also in blocks larger than the prefix and the chunk."""
    vectors = clustered(600, 12, 2, 0.12)
    links = similarity.similar_pairs(frame(spark, vectors), "id", "vec", 0.97, blocking="lsh", bits=2, recall=0.999999, prefix=40, chunk=10)
    assert dict(links.collect()) == {i: k for i, k in greedy(vectors, 0.97).items() if k is not None}


def test_blocks_recall(spark):
    vectors = clustered(1500, 32, 3, 0.03)
    want = {i for i, k in greedy(vectors, 0.97).items() if k is not None}
    links = similarity.similar_pairs(frame(spark, vectors), "id", "vec", 0.97, blocking="lsh").collect()
    assert len(want & {r.id for r in links}) >= 0.95 * len(want)
    unit = {i: np.asarray(v) / np.linalg.norm(v) for i, v in vectors if v is not None and np.any(v)}
    assert all(unit[r.id] @ unit[r.kept_id] >= 0.97 - 1e-9 and r.kept_id < r.id for r in links)


def test_merge_takes_the_first_paid_copy(spark):
    vectors = clustered(300, 12, 4, 0.05)
    fate = greedy(vectors, 0.97)
    rows = {i: (None if i % 3 else i, f"t{i}" if i % 2 else None) for i, _ in vectors}
    want = {}
    for i, _ in vectors:
        if fate.get(i) is None:
            salary, title = rows[i]
            if salary is None:
                donor = next((j for j, k in fate.items() if k == i and rows[j][0] is not None), None)
                if donor is not None:
                    salary, title = rows[donor][0], rows[donor][1] or title
            want[i] = (salary, title)
    for how in (dict(blocking="exact"), dict(blocking="lsh", bits=1, recall=0.999999)):
        out = similarity.dedup_semantic(frame(spark, vectors), "id", "vec", **how)
        assert {r.id: (r.salary, r.title) for r in out.collect()} == want


def test_chain_keeps_both_ends(spark):
    angle = np.arccos(0.975)
    vectors = [(i, [float(np.cos(i * angle)), float(np.sin(i * angle))]) for i in range(3)]
    links = similarity.similar_pairs(frame(spark, vectors), "id", "vec", 0.97, blocking="exact")
    assert [tuple(r) for r in links.collect()] == [(1, 0)]


@pytest.mark.parametrize("how", [dict(blocking="exact", chunk=16), dict(blocking="lsh", bits=2, recall=0.999999)])
def test_negative_ids(spark, how):
    vectors = [(i - 150, v) for i, v in clustered(300, 12, 5, 0.1)]
    links = similarity.similar_pairs(frame(spark, vectors), "id", "vec", **how)
    assert dict(links.collect()) == {i: k for i, k in greedy(vectors, 0.97).items() if k is not None}


def test_no_vectors(spark):
    df = frame(spark, [(0, None), (1, [0.0, 0.0])])
    for how in ("exact", "lsh"):
        assert similarity.dedup_semantic(df, "id", "vec", blocking=how).count() == 2


def test_repeated_ids_are_an_error(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [1.0, 0.1], 2), (8, [0.0, 1.0], None)], "id long, vec array<double>, salary int")
    with pytest.raises(ValueError):
        similarity.dedup_semantic(df, "id", "vec", blocking="lsh")


def test_unrelated_rows_change_no_link(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    rows = [(k, (base[k % 20] + 0.02 * rng.standard_normal(32)).tolist()) for k in range(60)]
    more = rows + [(k, v.tolist()) for k, v in zip(range(100, 900), rng.standard_normal((800, 32)))]
    links = [
        {(r.id, r.kept_id) for r in similarity.similar_pairs(spark.createDataFrame(x, "id long, vec array<double>"), "id", "vec", 0.92).collect()}
        for x in (rows, more)
    ]
    assert links[0] and links[0] == {l for l in links[1] if l[0] < 100}


def test_rows_that_meet_by_chance_leave_their_blocks(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=(40, 32))
    near[1::2] = near[::2] + rng.normal(size=(20, 32)) * 0.05
    vectors = np.concatenate([near, rng.normal(size=(1500, 32))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id BIGINT, vec ARRAY<FLOAT>").repartition(5)
    rounds = Rounds(spark, "test")
    cold = similarity._blocks(df, 0.97, 0.999, 4, 7, 10_000, rounds)
    assert {r.id for r in cold.select("id").distinct().collect()} == set(range(40))
    # blocks of more than a chunk keep all their rows
    hot = similarity._blocks(df, 0.97, 0.999, 2, 7, 100, rounds)
    assert hot.select("id").distinct().count() == len(vectors)
    pairs = similarity.similar_pairs(df, "id", "vec", 0.97, blocking="lsh", bits=4)
    assert {(r.id, r.kept_id) for r in pairs.collect()} == {(i + 1, i) for i in range(0, 40, 2)}


def test_company_is_counted_across_batches():
    rng = np.random.default_rng(9)
    block = np.sort(rng.integers(-9, 9, 300))
    sketch = rng.integers(0, 256, (300, similarity.SKETCH // 8), dtype=np.uint8)
    bits = np.unpackbits(sketch, axis=1)
    apart = 112
    differ = (bits[:, None] != bits[None]).sum(axis=2)
    expected = [i for i in range(300) if any(j != i and block[j] == block[i] and differ[i, j] <= apart for j in range(300))]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(block), pa.array(np.arange(300)), pa.array(sketch.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["block", "id", "sketch"])
    for size in (1, 7, 300):
        out = similarity._in_company(apart)(rows.slice(at, size) for at in range(0, 300, size))
        assert [i for b in out for i in b["id"].to_pylist()] == expected and 0 < len(expected) < 300


def test_equal_vectors_meet_without_moving(spark):
    nan, wide = float("nan"), [0.5, -1.0, 2.0]
    vectors = [(0, wide), (1, [0.0, 1.0, 0.0]), (2, wide), (3, [-0.0, 1.0, 0.0]), (4, [1.0, None, 2.0]), (5, [None, 1.0, 2.0]), (6, [1.0, None, 2.0]),
               (7, [nan, 1.0, 0.0]), (8, [nan, 1.0, 0.0]), (9, wide), (None, wide)]
    df = spark.createDataFrame(vectors, "id BIGINT, vec ARRAY<DOUBLE>").repartition(4)
    for how in ("exact", "lsh"):
        links = similarity.similar_pairs(df, "id", "vec", blocking=how)
        assert {tuple(r) for r in links.collect()} == {(2, 0), (9, 0), (3, 1), (6, 4), (8, 7)}
        # what is left to do joins ids, not vectors
        assert "vec" not in links._jdf.queryExecution().executedPlan().toString()


def test_digests_of_many_strings():
    import hashlib

    from postsift.functions.digest import md5_prefixes

    rng = np.random.default_rng(3)
    data, at = rng.integers(0, 256, 5000, dtype=np.uint8), rng.integers(0, 4800, 3000)
    ends = at + rng.integers(0, 140, 3000)
    ends[:200] = at[:200] + np.arange(200)
    want = [int(hashlib.md5(data[a:b].tobytes()).hexdigest()[:16], 16) for a, b in zip(at, ends)]
    assert md5_prefixes(data, at, ends).tolist() == want
    assert len(md5_prefixes(data, at[:0], ends[:0])) == 0


def test_embedding_counts_distinct_terms(spark, monkeypatch):
    import hashlib
    import re

    from postsift.operators import enrich

    rng = random.Random(6)
    bits = ["a", "B", "Ä", "word", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\x1c", "x" * 54, "y" * 56, "\0", "\u2028"]
    texts = ["", None, " \n", "a", "a a a", *("".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300))]

    def plain(text):
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w]
        out = np.zeros(32)
        for term in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}:
            h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            out[h // 2 % 32] += 1 - 2 * (h % 2)
        length = np.sqrt((out * out).sum())
        return (out / length if length else out).astype(np.float32).tolist() if words else None

    for size in (1, 1 << 22):
        monkeypatch.setattr(enrich, "_HASHED", size)
        got = enrich._term_vectors([(t or "").lower().encode() for t in texts], 32)
        assert [None if v is None else v.tolist() for v in got] == [plain(t) for t in texts]
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "id INT, text STRING, n INT")
    rows = enrich.embed_text(df, "id", F.col("text"), 32, "n").collect()
    assert {r.id: (r.n, r.embedding) for r in rows} == {i: (i % 7, plain(t)) for i, t in enumerate(texts)}


def test_signs_apart():
    from postsift.functions.vector import most_signs_apart

    assert most_signs_apart(0.97, 256, 1e-6) < 50 and most_signs_apart(0.3, 256, 1e-10) > 128 and most_signs_apart(0.5, 8, 2.0) == 0


def test_first_n(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("seq"))
    assert sorted(r.seq for r in dedup.first_n_per_group(df, "g", 2, ("seq",)).collect()) == [0, 1, 2, 3]
