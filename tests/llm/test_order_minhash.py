"""Order MinHash against all pairs, alignment against the textbook table, and components against union-find."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import order_minhash as O
from postsift.session import Rounds


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (x == y))
    return table[-1][-1]


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_alignment():
    rnd = random.Random(3)
    for n in range(400):
        letters = rnd.choice([2, 6, 40])
        a = [rnd.randint(0, letters) for _ in range(rnd.randint(0, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 2)] = [rnd.randint(0, letters) for _ in range(rnd.randint(0, 2))]
        x, y, best = np.array(a, np.uint64), np.array(b, np.uint64), plain_common(a, b)
        similar, apart = O.align(x, y)
        true = len(a) + len(b) - 2 * best
        assert similar == (best > 0 and 5 * best >= 4 * (len(a) + len(b) - best))
        assert apart == true if similar else apart <= true
        if a and b:
            assert O._common(x, y, 99) == O._common_dense(x, y, 99) == best
            if similar:  # the band holds every alignment that is good enough
                assert O._common_dense(x, y, O._most_apart(len(a), len(b))) == best


def test_labels_tell_occurrences_apart():
    x = np.array([5, 5, 9, 5, 9], np.uint64)
    assert len(set(O.labelled(x).tolist())) == 5
    assert set(O.labelled(x[::-1].copy()).tolist()) == set(O.labelled(x).tolist())


def test_picks_keep_text_order(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    turned = O.bands(O.picks(x[::-1].copy()))
    assert not set(O.bands(O.picks(x)).tolist()) & set(turned.tolist())  # the same shingles in another order
    whole = O.picks(x)
    monkeypatch.setattr(O, "SLICE", 7)
    assert np.array_equal(O.picks(x), whole)
    assert len(O.bands(O.picks(x[:1]))) == O.BANDS and len(O.bands(O.picks(x[:0]))) == 0


def test_bands_find_similar_texts():
    """At similarity 0.8 exactly, 24 bands miss few pairs in a million; unlike texts rarely meet."""
    rng = np.random.default_rng(2)
    missed = met = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 62, 180, dtype=np.uint64)
        y = np.concatenate([x[20:], rng.integers(0, 1 << 62, 20, dtype=np.uint64)])  # 160 of 200 shared
        missed += not set(O.bands(O.picks(x)).tolist()) & set(O.bands(O.picks(y)).tolist())
        z = np.concatenate([x[:30], rng.integers(0, 1 << 62, 150, dtype=np.uint64)])
        met += bool(set(O.bands(O.picks(x)).tolist()) & set(O.bands(O.picks(z)).tolist()))
    assert missed == 0 and met < 8


def test_minima_of_similar_texts_agree(monkeypatch):
    """At similarity 0.8 exactly no pair falls under the bound; at 0.6 hardly one reaches it."""
    rng = np.random.default_rng(4)
    near, far = [], []
    for n in (9, 180, 180, 180, 900) * 12:
        x = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for out, moved in ((near, n // 9), (far, n // 4)):
            y = np.concatenate([x[moved:], rng.integers(0, 1 << 62, moved, dtype=np.uint64)])
            one, two = (np.frombuffer(O.minima(v), np.uint8) for v in (x, y))
            out.append(((one == two).sum(), (one == two)[: O.FIRST].sum()))
    assert min(near)[0] >= O.AGREE and min(k for _, k in near) >= O.FIRST_AGREE and max(far)[0] < O.AGREE
    whole = O.minima(x)
    monkeypatch.setattr(O, "SLICE", 40)
    assert O.minima(x) == whole and len(O.minima(x[:0])) == O.MINIMA


@pytest.mark.parametrize("seed", range(4))
def test_likely_pairs(seed, monkeypatch):
    """In blocks and at once the same pairs; with enough tries, all pairs that may be similar."""
    monkeypatch.setattr(O, "AGREE", 200)
    monkeypatch.setattr(O, "FIRST_AGREE", 0)
    rng = np.random.default_rng(seed)
    size = 90
    signs, roots, n = rng.integers(0, 2, (size, O.MINIMA), dtype=np.uint8), rng.integers(0, 5, size), rng.integers(80, 120, size)
    roots[rng.random(size) < 0.5] = 2
    largest = np.bincount(roots).argmax()
    want = {
        (i, j) for i in range(size) for j in range(i + 1, size)
        if roots[i] != roots[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and (signs[i] == signs[j]).sum() >= 200
    }
    pairs = lambda *args: {(min(p), max(p)) for p in zip(*(x.tolist() for x in O.likely_pairs(*args)[:2]))}
    assert pairs(signs, roots, n, np.zeros(size), 10**6) == want and len(want) > 50
    blocks = np.arange(size) % 2
    across = pairs(signs, roots, n, blocks, 10**6)
    assert across == {(i, j) for i, j in want if blocks[i] != blocks[j]}
    left, right, more = O.likely_pairs(signs, roots, n, np.zeros(size), 2)
    kinds = [tuple(sorted((roots[i], roots[j]))) for i, j in zip(left, right)]
    assert more and max(kinds.count(k) for k in kinds) == 2 and {tuple(sorted((roots[i], roots[j]))) for i, j in want} == set(kinds)


def test_a_pair_comes_out_of_its_first_common_band_only(monkeypatch):
    """Over all bands, and over the turns of a round without a link, each likely pair comes once."""
    monkeypatch.setattr(O, "AGREE", 200)
    monkeypatch.setattr(O, "FIRST_AGREE", 0)
    rng = np.random.default_rng(7)
    size = 60
    signs, roots, n = rng.integers(0, 2, (size, O.MINIMA), dtype=np.uint8), rng.integers(0, 4, size), np.full(size, 100)
    keys = rng.integers(0, 3, (size, O.BANDS)).astype(np.int32)
    found = []
    for band in range(O.BANDS):
        for key in range(3):  # a bucket
            own = np.flatnonzero(keys[:, band] == key)
            for least, most in ((0, 2), (2, 10**6)):
                if len(own):
                    left, right, _ = O.likely_pairs(signs[own], roots[own], n[own], np.zeros(len(own)), most, least, keys[own], band)
                    found += [(min(p), max(p)) for p in zip(own[left].tolist(), own[right].tolist())]
    # of a bucket's largest component no two rows meet, and they are in one component anyway
    want = {
        (i, j) for i in range(size) for j in range(i + 1, size)
        if roots[i] != roots[j] and (keys[i] == keys[j]).any() and (signs[i] == signs[j]).sum() >= 200
    }
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def plain_classes(rows):
    """class id of each row, from all pairs."""
    sh = O.Shingler()
    own = [sh.shingles((t or "").encode()) for _, t in rows]
    sets = [set(s.tolist()) for s in own]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if (rows[i][1] or "") == (rows[j][1] or "") or sets[i] & sets[j] and O.align(own[i], own[j])[0]
    ]
    root = roots(range(len(rows)), edges)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        ids.setdefault(root[k], []).append(doc)
    least = {r: min((d for d in docs if d is not None), default=None) for r, docs in ids.items()}
    return [(rows[k][0], least[root[k]], len(ids[root[k]])) for k in range(len(rows))]


def near_copies(seed):
    """Chains and stars of edited texts, shared passages, short texts, exact copies."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(60), []
    for k in range(12):
        base = text(rnd.choice([4, 12, 80, 200]))
        rows.append(base)
        for step in range(8):
            edited = list(rows[-1] if k % 2 else base)
            for _ in range(rnd.randint(0, max(1, len(edited) // 40))):
                edited[rnd.randrange(len(edited))] = word()
            rows.append(edited)
        rows.append(text(30) + passage + text(40))
    rows = [" ".join(r) for r in rows]
    rows += rows[:5] + [rows[3].upper() + "!", "", "", None, "?!", "?!", "one two", "One, two"]
    return [(k if k % 17 else None, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("text_id", "root", "bucket", "n", "a", "b")})
    got = [(r.doc_id, r.class_id, r.class_size) for r in O.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_classes(rows)))
    kept = O.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in plain_classes(rows) if c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_texts_that_fail_meet_all_others(spark):
    """A chain in one bucket: the ends fail against the first text, and are linked through the middle."""
    rnd = random.Random(9)
    base = [f"w{rnd.random()}" for _ in range(300)]
    rows = []
    for step in range(14):  # each shares 0.85 or so with the next, and the bucket by chance
        rows.append((step, " ".join(base[4 * step : 4 * step + 200])))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.class_size) for r in O.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(plain_classes(rows)) and {c for _, c, _ in got} == {0}


def test_large_group_makes_no_square(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(1500):
        text = list(base)
        text[rnd.randrange(100)] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(k, rows[0][1]) for k in range(1500, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    rounds = Rounds(spark, "test")
    sketched = rounds.keep(O._sketched(docs, "doc_id", "text"), "sketched")
    compared = []
    verified = O._verified
    monkeypatch.setattr(O, "_verified", lambda pairs, texts: compared.append(pairs.count()) or verified(pairs, texts))
    O.near_roots(sketched, docs, "text", rounds).count()
    assert sum(compared) < 2 * 1500
    assert {r.class_id for r in O.near_duplicates(docs).collect()} == {0}


def test_borderline_group(spark, monkeypatch):
    """Copies that are near their base, and mostly not near each other: all belong together."""
    monkeypatch.setattr(O, "BLOCK", 8)
    monkeypatch.setattr(O, "TRIED", 1)
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        text = list(base)
        for at in rnd.sample(range(150), 3 if k % 3 else 2):
            text[at] = f"x{rnd.random()}"
        rows.append((k, " ".join(text)))
    other = [f"v{k}" for k in range(150)]
    rows += [(100 + k, " ".join(base[: 120 - k] + other[: 30 + k])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.class_size) for r in O.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(plain_classes(rows))


def test_components(spark):
    rnd = random.Random(6)
    names = [bytes([rnd.randrange(256) for _ in range(4)]) for _ in range(120)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(90)] + list(zip(names[:30], names[1:31]))
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r.text_id): bytes(r.root) for r in O.components(frame, Rounds(spark, "test")).collect()}
    linked = {n for e in edges for n in e}
    want = roots(linked, edges)
    assert {n: got.get(n, n) for n in linked} == want


def test_odd_rows_and_empty_table(spark, odd_documents):
    rows = O.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r.class_id for r in rows}
    assert by_id[6] == 5 and by_id[1] == 1
    kept = O.keep_one(odd_documents)
    assert kept.schema == odd_documents.schema
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 7").count() == 2
    assert O.near_duplicates(odd_documents.limit(0)).count() == 0 and O.keep_one(odd_documents.limit(0)).count() == 0
