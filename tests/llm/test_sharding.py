"""The lookup table against a plain simulation of shards taking turns, and placement against the table."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postsift.llm import sharding as S


def plain_table(shards, slots):
    prefer = {}
    for s in shards:
        d = hashlib.md5(s.encode()).digest()
        a, k = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefer[s] = [(a + i * k) % slots for i in range(slots)]
        assert sorted(prefer[s]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for s in sorted(shards):
            if len(owner) < slots:
                owner[next(x for x in prefer[s] if x not in owner)] = s
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 7), (5, 101), (13, 1009)])
def test_table(n, slots):
    names = [f"s{k}" for k in range(n)]
    table = S.fill_table(names[::-1], slots)
    assert table == plain_table(names, slots)
    counts = [table.count(s) for s in names]
    assert max(counts) - min(counts) <= 1


def test_a_lost_shard_moves_little():
    names = [f"s{k}" for k in range(20)]
    before, after = S.fill_table(names, 10_007), S.fill_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after) if a != "s19")
    assert moved < 0.06 * len(before)


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_wrong_parameters(shards, slots):
    with pytest.raises(ValueError):
        S.fill_table(shards, slots)


def test_placement(spark, odd_documents):
    names = [f"s{k}" for k in range(5)]
    table = S.fill_table(names, 101)
    placed = S.place(odd_documents, names, slots=101)
    assert set(placed.columns) == {*odd_documents.columns, "shard"} and placed.count() == odd_documents.count()
    for r in placed.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    assert S.place(odd_documents.limit(0), names).count() == 0


def test_shares_are_even(spark):
    counts = [r["count"] for r in S.place(spark.range(20_000), [f"s{k}" for k in range(8)], key_col="id").groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.15 * min(counts)


def test_written_shards_hold_all_rows(spark, odd_documents, tmp_path):
    names = ["x", "y", "z"]
    S.write_shards(odd_documents.withColumn("shard", F.lit("old")), str(tmp_path / "out"), names, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_documents.count() and set(back.columns) == {*odd_documents.columns, "shard"}
    want = {(r.doc_id, r.shard) for r in S.place(odd_documents, names).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want


def test_query_equals_the_table(spark):
    from postsift.llm import queries

    rows = queries.QUERIES["op4_shard_placement"](spark, "/root/testdata/sf0.001").collect()
    table = S.fill_table(queries.OP4_SHARDS)
    assert len(rows) == 200
    assert all(r.shard == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % S.SLOTS] for r in rows)
