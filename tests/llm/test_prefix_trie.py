"""The prefix trie against a trie built turn by turn, and contraction against a walk over the tree."""

import hashlib
import random
import zlib

import pytest

from postsift.llm import prefix_trie, queries
from postsift.session import Rounds

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """{(conv_id, depth): the other columns} of (conv_id, turn, role, text) rows without ties in turn."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    members, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt = tuple(own.get(conv - int(abs(conv) % 5) * (1 if conv >= 0 else -1), [])[:h] + turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(conv)
        ends.setdefault(rebuilt, []).append(conv)
    totals = {p: [0, 0, 0] for p in members}
    for p in members:
        if p:
            totals[p[:-1]][0] += 1
    for p in members:
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            totals[p[:d]][1] += totals[p][0] == 0
            totals[p[:d]][2] += saved
    out = {}
    for p, convs in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        out[min(convs), len(p)] = (parent, len(convs), *totals[p], hashlib.sha256(ids.encode()).hexdigest())
    assert len(out) == len(members)
    return out


def found(df):
    rows = df.collect()
    out = {
        (r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows
    }
    assert len(out) == len(rows)
    return out


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rnd = random.Random(5)
    texts = ["", None, "ja", "né", "x" * 40, "漢字"]
    rows = []
    for conv in range(-9, 60):
        if conv % 7 == 3:
            continue  # some bases are absent
        for turn in rnd.sample(range(-3, 40), rnd.choice([1, 2, 5, 9, 14])):
            rows.append((conv, turn, rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts)))
        if rnd.random() < 0.3:
            rows.append((conv, None, "user", "first"))
    rows.append((None, 1, "user", "of no conversation"))
    rnd.shuffle(rows)
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(9))) == brute(rows)


def test_long_and_common_conversations(spark, monkeypatch):
    """One conversation of thousands of turns, many that are all alike, and many that part after a common turn."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    monkeypatch.setattr(prefix_trie, "IDS", 50)
    rows = [(4, t, "user", f"turn {t}") for t in range(1500)]
    for conv in range(1000, 1300):
        rows += [(conv, t, "user", f"the same {t}") for t in range(10)]
    for conv in range(2000, 2300):
        rows += [(conv, 0, "user", "hello")] + [(conv, t, "assistant", f"{conv} {t}") for t in range(1, 12)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(11))) == brute(rows)


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (10, 1, "user", "a"), (10, 1, "user", "a"), (10, 1, "user", "b")]
    names = "node parent depth pos part bytes digest chunk k only cut base h taken n_convs".split()
    wide = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    got = found(prefix_trie.prefix_trie(wide))
    # equal turns stand in one order whatever the order of rows, so both conversations are the same
    assert sorted(got) == [(5, d) for d in range(4)] and all(v[1] == 2 for v in got.values())
    assert found(prefix_trie.prefix_trie(wide.orderBy("text"))) == got


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    conv = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(conv, 0, "user", "gone: before the first h turns, and there is no base")]
    got = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and list(got) == [(conv, 0)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar"])
def test_contraction(spark, shape, tmp_path):
    rnd, n = random.Random(shape), 300
    parent = {"path": lambda k: k - 1, "star": lambda k: 0, "random": lambda k: rnd.randrange(k), "caterpillar": lambda k: k - 2 if k % 2 and k > 1 else k - 1}[shape]
    above = {k: max(0, parent(k)) for k in range(1, n)}
    value = {k: rnd.randrange(1000) for k in range(n)}
    total, kids = dict(value), dict.fromkeys(range(n), 0)
    for k in range(n - 1, 0, -1):
        total[above[k]] += total[k]
        kids[above[k]] += 1
    # a node's name is (number, 0): the depth takes no part in the method
    rows = [(k, 0, above.get(k), 0 if k else None, kids[k], value[k]) for k in range(n)]
    nodes = spark.createDataFrame(rows, "conv_id long, depth long, p_conv long, p_depth long, n_children long, v long")
    made = []

    class Counted(Rounds):
        def keep(self, df, name):
            made.append(name)
            return super().keep(df, name)

    got = prefix_trie.subtree_totals(nodes, ["v"], Counted(spark, "contraction")).collect()
    assert {r["conv_id"]: r["v"] for r in got} == total and len(got) == n
    assert sum(m.startswith("active") for m in made) <= 30  # far from the 300 levels of the path


def test_query_over_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert found(queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.001")) == brute(rows)
