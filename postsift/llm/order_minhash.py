"""Near-duplicates by order MinHash, verified by banded alignment.

Shingles of five words are labelled with their occurrence number.  A hash function picks a text's two smallest labelled
shingles and keeps them in text order; texts with many equal picks share most shingles in one order.  Pairs of picks
form band keys, texts with a band key in common are candidates, and an alignment decides: the similarity of two texts is
the longest common subsequence of their shingles over all shingles of both, LCS / (n1 + n2 - LCS).

Candidates in a bucket are not paired with each other.  First all texts meet the heaviest one of their bucket; a group
of copies is one component after that, and its buckets are closed.  A bucket stays open as long as its texts are in
different components.  Texts of an open bucket that are outside its largest component are held against all others by
512 minima, in blocks, within a task: the share of equal minima estimates that of shared shingles, so only pairs that may be
similar come out, the likeliest of any two components first.  They are aligned, components are joined, and the next
round takes more pairs of the components still apart, until none is left that was not aligned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import small_batches, unused, utf8, words
from postsift.session import Rounds

SHINGLE = 5
#: Two texts are near copies from this similarity on, as a fraction: 4/5.
SIMILAR = (4, 5)
#: At similarity 0.8 a pick agrees with chance 0.64, a band of three picks with 0.26: 40 bands miss 6 pairs in a million.
#: Texts that share a third of their shingles, by a common passage, meet in a band with chance 0.04.
BANDS, PICKS = 40, 3
#: Texts of open buckets also get plain minima of so many hash functions, a byte of each.  Similar texts share 0.8 of
#: all labelled shingles or more, so each minimum agrees with that chance: under 360 of 512 is five and a half
#: deviations below, rarer than a pair that shares no band.  The first of them rule most pairs out alone.
MINIMA, AGREE, FIRST, FIRST_AGREE = 512, 360, 64, 30
#: Texts of a bucket that one task holds against each other (two blocks); pairs of two components tried in the
#: first round, and so many times more in each later one.
BLOCK, TRIED, MORE = 1024, 4, 16
#: The bits of a band's key that tell it from a text's other bands.
KEY = (1 << 31) - 1
#: Shingles hashed at once; words whose hashes a task remembers; shingles of texts that it holds while it aligns.
SLICE, KNOWN, HELD = 1 << 14, 300_000, 1_000_000

_RNG = np.random.default_rng(20_240_229)
SEEDS = _RNG.integers(0, 1 << 32, BANDS * PICKS, dtype=np.uint32)
FACTORS = _RNG.integers(0, 1 << 32, BANDS * PICKS, dtype=np.uint32) | np.uint32(1)
MIN_SEEDS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
MIN_FACTORS = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle hashes of texts; remembers word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, data: bytes | None) -> np.ndarray:
        """One hash per shingle, in text order.  A text of one to four words is one shingle; without words, none."""
        text = words(data)
        if len(self.known) > KNOWN:
            self.known.clear()
        for word in set(text).difference(self.known):
            self.known[word] = zlib.crc32(word) | zlib.crc32(b"\0" + word[::-1]) << 32
        own = _mix(np.fromiter(map(self.known.__getitem__, text), np.uint64, len(text)))
        if 0 < len(own) < SHINGLE:
            return _mix((own * _POWERS[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
        size = max(0, len(own) - SHINGLE + 1)
        total = np.zeros(size, np.uint64)
        for k in range(SHINGLE):
            total += own[k : k + size] * _POWERS[k]
        return _mix(total)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence number): all different."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    number = np.empty(len(s), np.uint64)
    number[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return np.where(number > 0, _mix(shingles + number * _MIX), shingles)


def picks(shingles: np.ndarray) -> np.ndarray:
    """Of each hash function the pair of a text's two smallest labelled shingles in text order; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    x = labelled(shingles)
    high = (x >> np.uint64(32)).astype(np.uint32)
    n, last = len(SEEDS), np.iinfo(np.uint32).max
    rows = np.arange(n)
    value = np.full((n, 4), last, np.uint32)
    place = np.full((n, 4), -1, np.int64)
    for at in range(0, len(x), SLICE):
        v = (high[None, at : at + SLICE] ^ SEEDS[:, None]) * FACTORS[:, None]
        for k in range(min(2, v.shape[1])):
            best = v.argmin(axis=1)
            value[:, 2 + k], place[:, 2 + k] = v[rows, best], at + best
            v[rows, best] = last
        order = np.argsort(value, axis=1, kind="stable")
        value, place = np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)
        value[:, 2:], place[:, 2:] = last, -1
    two = np.sort(place[:, :2], axis=1)  # in text order; -1 where the text has one shingle
    first, second = np.where(two[:, 0] >= 0, x[two[:, 0]], np.uint64(0)), x[two[:, 1]]
    return _mix(first * _MIX + second)


def bands(pick: np.ndarray) -> np.ndarray:
    """The band keys of a text's picks."""
    if not len(pick):
        return np.zeros(0, np.int64)
    pick, key = pick.reshape(BANDS, PICKS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(PICKS):
        key = _mix(key * _POWERS[k] + pick[:, k])
    return key.astype(np.int64)


def minima(shingles: np.ndarray) -> bytes:
    """One byte of the shingle that is least by each of MINIMA hash functions; a text without shingles has its own."""
    x = labelled(shingles)
    high = (x >> np.uint64(32)).astype(np.uint32)
    least, which = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32), np.zeros(MINIMA, np.uint8)
    for at in range(0, len(x), SLICE // 4):
        v = (high[None, at : at + SLICE // 4] ^ MIN_SEEDS[:, None]) * MIN_FACTORS[:, None]
        best = v.argmin(axis=1)
        own = v[np.arange(MINIMA), best]
        less = own < least
        least[less], which[less] = own[less], x[at + best[less]].astype(np.uint8)
    return which.tobytes()


def links(n1: int, n2: int, common: int) -> bool:
    """True if *common* of n1 and n2 shingles make the texts similar."""
    part, whole = SIMILAR
    return common * whole >= part * (n1 + n2 - common) and common > 0


def _most_apart(n1: int, n2: int) -> int:
    """The largest n1 + n2 - 2 LCS of similar texts."""
    part, whole = SIMILAR
    return (n1 + n2) * (whole - part) // (whole + part)


def align(a: np.ndarray, b: np.ndarray) -> tuple[bool, int]:
    """(similar, distance): the distance n1 + n2 - 2 LCS if similar, else a lower bound of it."""
    n1, n2 = len(a), len(b)
    shared = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if not links(n1, n2, shared):
        return False, n1 + n2 - 2 * shared
    size = min(n1, n2)
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    differ = np.flatnonzero(a[n1 - size + head :][::-1] != b[n2 - size + head :][::-1])
    tail = int(differ[0]) if len(differ) else size - head
    common = head + tail + _common(a[head : n1 - tail], b[head : n2 - tail], _most_apart(n1, n2))
    distance = n1 + n2 - 2 * common
    return (True, distance) if links(n1, n2, common) else (False, max(n1 + n2 - 2 * shared, _most_apart(n1, n2) + 1))


def _common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence whose matches lie within *band* of the diagonal."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, list[int]] = {}
    for j, s in enumerate(b.tolist()):
        where.setdefault(s, []).append(j)
    own = a.tolist()
    if sum(len(where.get(s, ())) for s in own) > 20 * (len(a) + len(b)):
        return _common_dense(a, b, band)
    ends: list[int] = []  # ends[k]: the least place in b where a common subsequence of length k + 1 ends
    for i, s in enumerate(own):
        for j in reversed(where.get(s, ())):
            if -band <= i - j <= band:
                k = bisect_left(ends, j)
                ends[k : k + 1] = [j]
    return len(ends)


def _common_dense(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same row by row over the band, for texts with many repeated shingles."""
    row = np.zeros(len(b) + 1, np.int32)
    for i, s in enumerate(a):
        low, high = max(0, i - band), min(len(b), i + band + 1)
        if low >= high:
            continue
        found = np.maximum(row[low + 1 : high + 1], row[low:high] + (b[low:high] == s))
        np.maximum.accumulate(found, out=found)
        row[low + 1 : high + 1] = found
        if high < len(b):
            row[high + 1] = max(row[high + 1], row[high])  # the next row's band begins where this one ends
    return int(row.max())


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, n, bands): text_id is the MD5 digest of the text, n its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in small_batches(batches, 256):
            sizes, keys = [], []
            for data in batch.column(2).to_pylist():
                shingles = shingler.shingles(data)
                sizes.append(len(shingles))
                keys.append(bands(picks(shingles)))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], names=["doc_id", "text_id", "n", "bands"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(text_col).alias("text_id"), utf8(text_col).alias("data"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_id binary, n long, bands array<long>")


def _signed(texts: DataFrame) -> DataFrame:
    """(text_id, minima) of (text_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in small_batches(batches, 256):
            found = [minima(shingler.shingles(data)) for data in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["text_id"], pa.array(found, pa.binary())], names=["text_id", "minima"])

    return texts.mapInArrow(run, "text_id binary, minima binary")


def text_id(text_col: str) -> F.Column:
    """Names a text: equal texts have one name.  Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similar) of pairs (a, n_a, b, n_b) of text ids; *texts* is (text_id, data), each text once."""
    part, whole = SIMILAR
    # a text that is too short for the other is no near copy; the rest are aligned
    worth = F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part
    near = pairs.where(worth).select("a", "b")
    far = pairs.where(~worth).select("a", "b", F.lit(False).alias("similar"))
    named = near.select(F.col("a").alias("text_id")).union(near.select("b")).distinct()
    texts = texts.join(named, "text_id")
    sides = near.join(texts.select(F.col("text_id").alias("b"), F.col("data").alias("data_b")), "b").join(
        texts.select(F.col("text_id").alias("a"), F.col("data").alias("data_a")), "a"
    ).select("a", "b", "data_a", "data_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, held = Shingler(), {}, 0
        for batch in small_batches(batches, 64):
            found = []
            for a, b, data_a, data_b in zip(*(batch[n].to_pylist() for n in ("a", "b", "data_a", "data_b"))):
                for name, data in ((a, data_a), (b, data_b)):
                    if name not in known:
                        if held > HELD:
                            known, held = {}, 0
                        known[name] = shingler.shingles(data)
                        held += len(known[name])
                found.append(align(known[a] if a in known else shingler.shingles(data_a), known[b])[0])
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.bool_())], names=["a", "b", "similar"])

    return sides.mapInArrow(run, "a binary, b binary, similar boolean").unionByName(far)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) with the lesser text first, each once."""
    turned = F.col("a") > F.col("b")
    other = {"a": "b", "b": "a", "n_a": "n_b", "n_b": "n_a"}
    return pairs.select(*[F.when(turned, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in other.items()]).groupBy("a", "b").agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every text with one of the heaviest texts of its buckets, the heaviest of them.  A text is heavy
    if its buckets hold many rows: the text that a group of copies stems from has the picks most of them kept.  Each
    pair comes once, so there are at most as many as texts.  *rows* is (bucket, text_id, n, size)."""
    weights = rows.groupBy("text_id").agg(F.sum("size").alias("weight"))
    heaviest = rows.join(weights, "text_id").groupBy("bucket").agg(F.max(F.struct("weight", "text_id", "n")).alias("lead"))
    met = rows.join(heaviest, "bucket").where(F.col("lead.text_id") != F.col("text_id"))
    met = met.groupBy("text_id").agg(F.first("n").alias("n"), F.max("lead").alias("lead"))
    return _ordered(met.select(F.col("lead.text_id").alias("a"), F.col("lead.n").alias("n_a"), F.col("text_id").alias("b"), F.col("n").alias("n_b")))


def likely_pairs(
    signs: np.ndarray, roots: np.ndarray, n: np.ndarray, blocks: np.ndarray, most: int, least: int = 0, keys: np.ndarray | None = None, band: int = 0,
) -> tuple[np.ndarray, np.ndarray, bool]:
    """(first, second, more): rows of different components whose minima and sizes allow a link, the *most* likeliest of
    any two components but for the *least* likeliest, which had their turn; and whether there are more.  Rows of the
    largest component are not held against each other.  Where the rows are of two blocks, only pairs across them count.
    With *keys*, the band keys of the rows, a pair counts only if *band* is the first one that the two have in common."""
    part, whole = SIMILAR
    largest = np.bincount(roots).argmax()
    outside = np.flatnonzero(roots != largest)
    left, right, agree = [], [], []
    for at in range(0, len(outside), 64):
        own = outside[at : at + 64]
        some = (signs[own][:, None, :FIRST] == signs[None, :, :FIRST]).sum(axis=2, dtype=np.int16)
        small, large = np.minimum(n[own][:, None], n[None, :]), np.maximum(n[own][:, None], n[None, :])
        good = (some >= FIRST_AGREE) & (small * whole >= large * part) & (roots[own][:, None] != roots[None, :])
        # two rows outside meet once
        good &= (roots[None, :] == largest) | (own[:, None] < np.arange(len(n))[None, :])
        if blocks[0] != blocks[-1] or (blocks != blocks[0]).any():
            good &= blocks[own][:, None] != blocks[None, :]
        i, j = np.nonzero(good)
        for start in range(0, len(i), 20_000):
            x, y = own[i[start : start + 20_000]], j[start : start + 20_000]
            if keys is not None:
                here = (keys[x] == keys[y]).argmax(axis=1) == band
                x, y = x[here], y[here]
            equal = (signs[x] == signs[y]).sum(axis=1)
            left.append(x[equal >= AGREE])
            right.append(y[equal >= AGREE])
            agree.append(equal[equal >= AGREE])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    left, right, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
    key = np.minimum(roots[left], roots[right]) * np.int64(len(n)) + np.maximum(roots[left], roots[right])
    order = np.lexsort((right, left, -agree, key))
    key = key[order]
    begins = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    place = np.arange(len(key)) - np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
    chosen = order[(place >= least) & (place < most)]
    return left[chosen], right[chosen], bool((place >= most).any())


def _candidates(rows: DataFrame, signed: DataFrame, most: int, least: int) -> DataFrame:
    """(a, b, n_a, n_b, more) from open buckets, each pair once: *rows* is (bucket, text_id, n, root, size), *signed*
    (text_id, minima, keys).

    A bucket is held in blocks; a block meets itself and each other one in a group of its own, so no task holds more than
    two blocks of a bucket.  Texts that share several buckets are a pair in the one of their first common band only: it
    is open as well, as it holds two components.  Bands are told apart by 31 bits of their keys here.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("text_id"), blocks).cast("int"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meets = meets.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "text_id", "n", "root"
    ).join(signed, "text_id")
    names = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len({h[5] for h in held}) > 1:
                numbers: dict[bytes, int] = {}
                roots = np.array([numbers.setdefault(h[5], len(numbers)) for h in held])
                found = np.stack([np.frombuffer(h[6], np.uint8) for h in held])
                n, blocks, keys = np.array([h[4] for h in held]), np.array([h[1] for h in held]), np.stack([h[8] for h in held])
                band = int((keys == held[0][0] & KEY).all(axis=0).argmax())
                left, right, more = likely_pairs(found, roots, n, blocks, most, least, keys, band)
                out.extend((held[x][3], held[x][4], held[y][3], held[y][4], more) for x, y in zip(left.tolist(), right.tolist()))
            held.clear()

        def emit() -> pa.RecordBatch:
            types = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["a", "n_a", "b", "n_b", "more"])
            out.clear()
            return batch

        last = None
        for batch in batches:
            keys = batch["keys"].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
            for row in zip(*(batch[c].to_pylist() for c in ("bucket", "block", "i", "text_id", "n", "root", "minima", "j")), keys):
                if (group := (row[0], row[2], row[7])) != last:
                    close()
                    last = group
                    if len(out) > 10_000:
                        yield emit()
                held.append(row)
        close()
        if out:
            yield emit()

    dealt = meets.repartition(*names).sortWithinPartitions(*names, "text_id")
    found = dealt.mapInArrow(run, "a binary, n_a long, b binary, n_b long, more boolean")
    turned = F.col("a") > F.col("b")
    other = {"a": "b", "b": "a", "n_a": "n_b", "n_b": "n_a"}
    return found.select(*[F.when(turned, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in other.items()], "more")


def near_roots(sketched: DataFrame, docs: DataFrame, text_col: str, rounds: Rounds) -> DataFrame:
    """(text_id, root) of all texts that share a bucket with another text; without a near copy the root is the text."""
    texts = sketched.groupBy("text_id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = texts.select(F.explode("bands").alias("bucket"), "text_id", "n")
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rounds.keep(rows.join(crowded, "bucket"), "open")
    stars = rounds.keep(_stars(rows), "stars")
    roots = rounds.keep(rows.select("text_id").distinct().withColumn("root", F.col("text_id")), "roots")
    # only texts that meet others are moved and stored, once
    bodies = docs.select(text_id(text_col).alias("text_id"), utf8(text_col).alias("data"))
    bodies = bodies.join(roots.select("text_id"), "text_id", "left_semi").groupBy("text_id").agg(F.first("data").alias("data"))
    bodies = rounds.keep(bodies, "texts")
    fresh, tested, signed, least, most = stars, stars.select("a", "b"), None, 0, TRIED
    while True:
        checked = rounds.keep(_verified(fresh, bodies), "checked")
        linked = checked.where("similar")
        if signed is None or not linked.isEmpty():
            roots = rounds.keep(_renamed(roots, "root", components(_between(linked, roots), rounds)), "roots")
            # what is closed is read no more
            current = rows.select("bucket", "text_id", "n", "size").join(roots, "text_id")
            several = current.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
            rows = rounds.keep(current.join(several, "bucket", "left_semi"), "open")
            least = 0  # what are the likeliest pairs of two components is another question now
        while True:
            if rows.isEmpty():
                rounds.drop("open", "stars", "texts", "checked", "signed", "candidates", "fresh", "tested")
                return roots
            if signed is None:
                keys = texts.select("text_id", F.transform("bands", lambda k: k.bitwiseAND(F.lit(KEY)).cast("int")).alias("keys"))
                signed = _signed(bodies.join(rows.select("text_id").distinct(), "text_id", "left_semi"))
                signed = rounds.keep(signed.join(keys, "text_id"), "signed")
            found = rounds.keep(_candidates(rows, signed, most, least), "candidates")
            fresh = rounds.keep(found.join(tested, ["a", "b"], "left_anti"), "fresh")
            more = not found.where("more").isEmpty()
            least, most = most, most * MORE
            if not fresh.isEmpty():
                break
            if not more:
                rows = rows.limit(0)
        tested = rounds.keep(tested.unionByName(found.select("a", "b")).distinct(), "tested")


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """*rows* with the values of a column replaced by their roots in *names* (text_id, root), where they have one."""
    names = names.select(F.col("text_id").alias(column), F.col("root").alias("_root"))
    return rows.join(names, column, "left").withColumn(column, F.coalesce("_root", column)).select(*rows.columns)


def _between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links as pairs of different roots, each once."""
    return _renamed(_renamed(links.select("a", "b"), "a", roots), "b", roots).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def components(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(text_id, root) of every text with a link: root is the least text of its connected component.

    Each round ties every text to its least neighbour, if that is less than itself, follows these ties to their ends by
    doubling, and replaces the texts of the links by these ends; links within what has become one text are gone.
    """
    edges, roots = rounds.keep(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        both = edges.select(F.col("a").alias("text_id"), "b").union(edges.select("b", "a"))
        least = both.groupBy("text_id").agg(F.min("b").alias("root"))
        ties = rounds.keep(least.withColumn("root", F.least("root", "text_id")), "ties")
        while True:
            up = ties.where("root <> text_id").select(F.col("text_id").alias("root"), F.col("root").alias("next"))
            moved = ties.join(up, "root", "left").select("text_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            moved = rounds.keep(moved, "moved")
            ties = moved.select("text_id", "root")
            if moved.where("moved").isEmpty():
                break
        roots = rounds.keep(ties if roots is None else _renamed(roots, "root", ties), "components")
        edges = rounds.keep(_between(edges, ties), "edges")
        if edges.isEmpty():
            rounds.drop("edges", "ties", "moved")
            return roots


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the least id of its class), class_size (rows), kept (it has the least id).

    A class is a connected component of equal texts and of texts of similarity 0.8 or more.  Words are lower-cased runs
    of ASCII letters and digits and of characters beyond ASCII.  A text of under five words is one shingle; texts
    without words are alike only if equal; null counts as empty.  Null ids are passed over as class ids, unless a class
    has no other.  Repeated rows are members of one class.  Other columns are ignored.
    """
    rounds = Rounds(docs.sparkSession, "near-duplicates")
    members = _classes(docs, id_col, text_col, rounds)
    classes = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return members.join(classes, "root").select(
        F.col("doc_id").alias(id_col), "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, rounds: Rounds) -> DataFrame:
    """(doc_id, text_id, root) of every document."""
    sketched = rounds.keep(_sketched(docs, id_col, text_col), "sketched")
    roots = near_roots(sketched, docs, text_col, rounds)
    members = rounds.keep(sketched.select("doc_id", "text_id"), "members")
    rounds.drop("sketched", "components")
    return members.join(roots, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id (nulls last, then by text), with all its columns as they
    are.  Of rows that repeat both id and text, one stays."""
    rounds = Rounds(docs.sparkSession, "near-duplicates")
    members = _classes(docs, id_col, text_col, rounds)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("first")
    # a struct with a null in it equals its like, so one key deals the rows for both steps and texts move once
    key = unused(docs, "text_id")
    chosen = members.groupBy("root").agg(first).select(F.struct("first.doc_id", "first.text_id").alias(key))
    rows = docs.withColumn(key, F.struct(F.col(id_col).alias("doc_id"), text_id(text_col).alias("text_id")))
    return rows.dropDuplicates([key]).join(chosen, key, "left_semi").drop(key)
