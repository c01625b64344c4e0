"""Toxicity: a convolutional text classifier with hashed word embeddings, trained on all labelled rows.

A word's embedding is the sum of the vectors its hashed parts select: the word and its beginnings.  Filters of several
widths slide over the words of the whole text; each filter's largest response (max pooling) enters a logistic output.
Thresholds are calibrated by language, which is told from the text's most frequent small words; a score is the logistic
function of the distance to the threshold, so 0.5 is the threshold for every language.

Labelled rows are dealt over shards of bounded size.  The first shard is learnt alone, in several epochs; from this
common start each shard then learns its own rows, in tasks, and what the shards have changed is averaged, in rounds.
Thresholds come from counts of the scores of all rows that were set aside for them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postsift.llm.common import per_worker, small_batches, utf8, words
from postsift.session import Rounds

#: Bytes of text in a shard, about; rounds in which all shards learn, after the first one's epochs.
SHARD_BYTES, ROUNDS = 16_000_000, 2
#: Slots for each labelled row, and at most, in the bitmap that keeps texts without a label from being moved.
SLOTS, MOST_SLOTS = 16, 1 << 28
#: Numbers of a model that are averaged together; parts of a score's unit that are told apart for a threshold.
BLOCK, PARTS = 1 << 14, 256

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
#: Beginnings (in bytes) that are hashed beside the whole word.
BEGINNINGS = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.06, 1e-4
#: Words convolved at once, and words whose responses a Python worker remembers.
SLICE, KNOWN = 40_000, 120_000

# Frequent small words by which a language is told.
SMALL_WORDS = {
    "en": "the of and to in is that for it with as was on are by this from or an at",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "le les et des du une dans qui que est sur pas par au plus pour avec ce il sont",
    "es": "el los las del se por un para con una su al lo como más pero sus es y",
}
LANGUAGES = (*SMALL_WORDS, "other")
_LANGUAGE_OF = {
    w.encode(): n for n, text in enumerate(SMALL_WORDS.values()) for w in text.split()
    if sum(w in t.split() for t in SMALL_WORDS.values()) == 1
}


def language(text: list[bytes]) -> int:
    """The place in LANGUAGES of the language most of whose small words occur; "other" without any."""
    votes = np.bincount([_LANGUAGE_OF[w] for w in text if w in _LANGUAGE_OF], minlength=1)
    return int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1


def parts(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings; 0 is left for padding."""
    seen = [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]
    own = [zlib.crc32(p) % (BUCKETS - 1) + 1 for p in seen]
    return own + [0] * (1 + len(BEGINNINGS) - len(own))


@dataclass
class Model:
    """Vectors by bucket, filters by width and place, output weights, and a threshold for each language."""

    vectors: np.ndarray
    filters: list[np.ndarray]
    shifts: np.ndarray
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray

    def responses(self, buckets: np.ndarray) -> np.ndarray:
        """Of words (rows of buckets): what each adds to each filter at each of its places."""
        own = self.vectors[buckets].sum(axis=1)
        return np.concatenate([own @ place for f in self.filters for place in f], axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shifts, 0) @ self.weights + self.bias


def _places() -> list[tuple[int, int]]:
    """(width, place) of each block of FILTERS columns of `responses`."""
    return [(w, j) for w in WIDTHS for j in range(w)]


PAD = max(WIDTHS) - 1


def _windows(by_word: np.ndarray) -> list[np.ndarray]:
    """Filter responses at each window, from the responses of padded words; one array for each width."""
    out, at = [], 0
    for w in WIDTHS:
        size = len(by_word) - PAD
        total = by_word[:size, at : at + FILTERS].copy()
        for j in range(1, w):
            total += by_word[j : j + size, at + j * FILTERS : at + (j + 1) * FILTERS]
        out.append(total)
        at += w * FILTERS
    return out


def _begin(seed: int = 7) -> np.ndarray:
    """An untrained model and its Adagrad memory as one array; `_state` tells its parts."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.15, (BUCKETS, DIM))
    vectors[0] = 0
    filters = [rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    values = np.concatenate([vectors.ravel(), *map(np.ravel, filters), np.zeros(n), rng.normal(0, 0.3, n), [0.0]])
    return np.concatenate([values, np.full(len(values), 1e-3)]).astype(np.float32)


def _state(flat: np.ndarray) -> tuple[Model, dict]:
    """The model and the Adagrad memory in an array, as views of it but for the biases."""

    def parts(values: np.ndarray) -> list:
        out, at = [], 0
        for shape in ((BUCKETS, DIM), *((w, DIM, FILTERS) for w in WIDTHS), *[(FILTERS * len(WIDTHS),)] * 2):
            out.append(values[at : at + np.prod(shape)].reshape(shape))
            at += np.prod(shape)
        return [out[0], out[1:-2], *out[-2:], float(values[at])]

    half = len(flat) // 2
    seen = dict(zip(("vectors", "filters", "shifts", "weights", "bias"), parts(flat[half:])))
    return Model(*parts(flat[:half]), np.zeros(len(LANGUAGES))), seen


def train(flat: np.ndarray, texts: list[bytes], labels: np.ndarray, seed: int, epochs: int) -> np.ndarray:
    """Adagrad on the logistic loss, from the state *flat* on, which stays as it is; the state reached."""
    flat, rng = flat.copy(), np.random.default_rng(seed)
    model, seen = _state(flat)
    vocabulary: dict[bytes, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], dtype=np.int32) for t in texts]
    buckets = np.array([[0] * (1 + len(BEGINNINGS)), *map(parts, vocabulary)], dtype=np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            _learn(model, seen, buckets, [rows[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]])
    flat[len(flat) // 2 - 1], flat[-1] = model.bias, seen["bias"]
    return flat


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after the other with padding between them, and where the windows of each begin and end.

    Windows begin at a word, and so reach into no other document; those beyond SLICE are the next slice's.
    """
    pad = np.zeros(PAD, np.int64)
    starts = np.cumsum([0, *(max(1, len(r)) + PAD for r in rows)])[:-1]
    ends = starts + [max(1, min(len(r), SLICE)) for r in rows]
    return np.concatenate([*(x for r in rows for x in (r if len(r) else np.zeros(1, np.int64), pad)), pad]), starts, ends


def _pool(model: Model, buckets: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return _chosen(model, buckets, rows)[0]


def _chosen(model: Model, buckets: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest response in each text, and by width the words of that window (text, place, filter).

    Long texts go in slices that overlap by a window; short ones share a slice.
    """
    pooled = np.full((len(rows), len(WIDTHS), FILTERS), -np.inf, np.float32)
    found = [np.zeros((len(rows), w, FILTERS), np.int64) for w in WIDTHS]

    def look(part: list[np.ndarray], owner: list[int]) -> None:
        text, starts, ends = _padded(part)
        used, inverse = np.unique(text, return_inverse=True)
        for k, h in enumerate(_windows(model.responses(buckets[used])[inverse])):
            for d, a, b in zip(owner, starts, ends):
                best = h[a:b].argmax(axis=0)
                value = h[a + best, np.arange(FILTERS)]
                up = value > pooled[d, k]
                pooled[d, k, up] = value[up]
                for j in range(WIDTHS[k]):
                    found[k][d, j, up] = text[a + best[up] + j]

    part, owner, size = [], [], 0
    for n, row in enumerate(rows):
        for at in range(0, max(1, len(row)), SLICE):
            part.append(row[at : at + SLICE + PAD])
            owner.append(n)
            size += len(part[-1])
            if size >= SLICE:
                look(part, owner)
                part, owner, size = [], [], 0
    if part:
        look(part, owner)
    return pooled.reshape(len(rows), -1), found


def _learn(model: Model, seen: dict, buckets: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> None:
    n = len(rows)
    pooled, found = _chosen(model, buckets, rows)
    used = np.unique(np.concatenate([f.ravel() for f in found]))
    own = model.vectors[buckets[used]].sum(axis=1)
    columns = np.arange(FILTERS)
    active = np.maximum(pooled + model.shifts, 0)
    error = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30))) - labels
    error = (error / n).astype(np.float32)

    def move(name, value, change, k=None):
        memory = seen[name] if k is None else seen[name][k]
        memory += change * change
        value -= RATE * change / np.sqrt(memory)

    back = error[:, None] * model.weights * (active > 0)
    move("weights", model.weights, error @ active + DECAY * model.weights)
    move("shifts", model.shifts, back.sum(axis=0))
    seen["bias"] += float(error.sum()) ** 2
    model.bias -= RATE * float(error.sum()) / np.sqrt(seen["bias"])
    to_words = np.zeros_like(own)
    changes = []
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS].ravel()
        column = np.tile(columns, n)
        change = DECAY * model.filters[k]
        for j in range(w):
            word = np.searchsorted(used, found[k][:, j].ravel())
            np.add.at(to_words, word, g[:, None] * model.filters[k][j].T[column])
            np.add.at(change[j].T, column, g[:, None] * own[word])
        changes.append(change)
    for k, change in enumerate(changes):
        move("filters", model.filters[k], change, k)
    touched = np.flatnonzero(np.abs(to_words).sum(axis=1))
    slots = buckets[used[touched]]
    flat, place = np.unique(slots, return_inverse=True)
    change = np.zeros((len(flat), DIM), np.float32)
    np.add.at(change, place.ravel(), np.repeat(to_words[touched], slots.shape[1], axis=0))
    change[flat == 0] = 0  # padding stays zero
    seen["vectors"][flat] += change * change
    model.vectors[flat] -= RATE * change / np.sqrt(seen["vectors"][flat])


def _best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The middle of the widest gap among thresholds with the least errors, a row weighing one over the root of its class's
    size: midway between equal rows, which pass over a rare class, and equal classes, where a few wrong labels of a rare
    class move the threshold far.  With *counts*, a score stands for so many rows.
    """
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    c = np.ones(len(s)) if counts is None else counts[order]
    up, down = (w / max(1, w.sum()) ** 0.5 for w in (c * y, c * (1 - y)))
    # errors when everything from place i on is called toxic
    errors = np.concatenate([[0], np.cumsum(up)]) + np.concatenate([np.cumsum(down[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gaps = edges[1:] - edges[:-1]
    good = np.flatnonzero(errors <= errors.min() + 1e-9)
    i = good[gaps[good].argmax()]
    return float((edges[i] + edges[i + 1]) / 2)


def _thresholds(scores: np.ndarray, labels: np.ndarray, languages: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """A threshold for each language; one with under 20 rows of either class takes that of all rows."""
    counts = np.ones(len(scores)) if counts is None else counts
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(len(LANGUAGES))
    out = np.full(len(LANGUAGES), _best_threshold(scores, labels, counts))
    for n in range(len(LANGUAGES)):
        own = languages == n
        if min((counts * labels)[own].sum(), (counts * (1 - labels))[own].sum()) >= 20:
            out[n] = _best_threshold(scores[own], labels[own], counts[own])
    return out


class Scorer:
    """Scores whole texts; remembers the filter responses of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((4096, len(_places()) * FILTERS), np.float32)

    def _rows(self, text: list[bytes]) -> np.ndarray:
        fresh = [w for w in set(text) if w not in self.row]
        if fresh:
            first = len(self.row) + 1
            if first + len(fresh) > len(self.table):
                grown = np.zeros((2 * (first + len(fresh)), self.table.shape[1]), np.float32)
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[first : first + len(fresh)] = self.model.responses(np.array([parts(w) for w in fresh]))
            self.row.update(zip(fresh, range(first, first + len(fresh))))
        return np.fromiter(map(self.row.__getitem__, text), np.int64, len(text))

    def _pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.row) > KNOWN:
            self._forget()
        padded, starts, ends = _padded([self._rows(t) for t in texts])
        places = np.column_stack([starts, ends]).ravel()
        return np.concatenate([np.maximum.reduceat(h, places)[::2] for h in _windows(self.table[padded])], axis=1)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """One score per text, from 0 to 1."""
        limits = self.model.thresholds[[language(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - limits, -700, 700)))

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """One value per text, without thresholds.  Long texts go in slices that overlap by a window; short ones share a slice."""
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        part, owner, size = [], [], 0
        for n, text in enumerate(texts):
            for at in range(0, max(1, len(text)), SLICE):
                part.append(text[at : at + SLICE + PAD])
                owner.append(n)
                size += len(part[-1])
                if size >= SLICE:
                    np.maximum.at(pooled, owner, self._pooled(part))
                    part, owner, size = [], [], 0
        if part:
            np.maximum.at(pooled, owner, self._pooled(part))
        return self.model.logits(pooled)


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that is never learnt from; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Train on all labelled documents that are not held out, whole texts; a fifth of them, by a hash, sets the thresholds.

    Null ids, labels and texts are left out.  Without rows of both classes the model is untrained and gives every text
    the same side of the threshold as its weights happen to; callers decide whether that is an error.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        ~held_out("id") & F.col("label").isin(0, 1)
    ).distinct()
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data")).where(~held_out("id") & F.col("data").isNotNull())
    texts = _may_be_in(texts, usable, min(MOST_SLOTS, SLOTS * labels.count()))
    sizes = docs.select(F.col(id_col).alias("id"), F.octet_length(text_col).alias("size"))
    shards = -(-(sizes.join(usable, "id").agg(F.sum("size")).first()[0] or 1) // SHARD_BYTES)
    rounds = Rounds(docs.sparkSession, "toxicity")
    # a shard is a partition of the join, so texts are shuffled once; a join of more partitions makes no more shards
    named = texts.repartition(shards, "id").join(usable.repartition(shards, "id"), "id").coalesce(shards)
    named = named.withColumn("hash", F.xxhash64("id", "data"))
    check = F.pmod("hash", F.lit(5)) == 0
    rows = named.select(F.spark_partition_id().alias("shard"), check.alias("check"), "label", "hash", "data")
    rows = rounds.keep(rows.sortWithinPartitions("hash", "data", "label"), "rows")
    learnt = rows.where("NOT check")
    flat = _round(learnt.where("shard = 0"), _begin(), EPOCHS)
    for _ in range(0 if learnt.where("shard > 0").isEmpty() else ROUNDS):
        flat = _round(learnt, flat, 1)
    model = _state(flat)[0]
    found = _counts(rows.where("check"), model)
    if found[3].sum() < 50:
        found = _counts(rows, model)
    model.thresholds = _thresholds(*found)
    rounds.drop("rows")
    return model


def _may_be_in(rows: DataFrame, ids: DataFrame, slots: int) -> DataFrame:
    """The *rows* whose id is in *ids*, and a few more, without a shuffle of the rows.

    Ids are hashed to slots of a bitmap, which is sent to the rows in pieces of 4 KB, its size bounded by *slots*.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(max(1, slots)))

    bits = ids.groupBy(F.bitmap_bucket_number(slot()).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("_bits"))
    place = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(slot())).join(F.broadcast(bits), "_bucket")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def _round(rows: DataFrame, flat: np.ndarray, epochs: int) -> np.ndarray:
    """The state after each shard of *rows* (shard, label, data) has learnt its rows from the state *flat* on.

    A number of the model is the mean over the shards that changed it, weighted by their rows, so words that few shards
    have move as far as the others.
    """
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, labels, size = -1, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal texts, labels, size
            if texts:
                reached, n = train(shared.value, texts, np.array(labels, np.float32), shard, epochs), len(texts)
                cells = [(at // BLOCK, shard, n, reached[at : at + BLOCK].tobytes()) for at in range(0, len(reached), BLOCK)]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names=["block", "shard", "n", "reached"])
            texts, labels, size = [], [], 0

        for batch in small_batches(batches):
            for owner, label, data in zip(*(batch[c].to_pylist() for c in ("shard", "label", "data"))):
                # many copies of a row may make a shard large
                if owner != shard or size > 2 * SHARD_BYTES:
                    yield from close()
                    shard = owner
                texts.append(data)
                labels.append(label)
                size += len(data)
        yield from close()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = start = moved = weight = None

        def close() -> Iterator[pa.RecordBatch]:
            if block is not None:
                now = (start + moved / np.maximum(weight, 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([now.tobytes()], pa.binary())], names=["block", "reached"])

        for batch in batches:
            for owner, n, reached in zip(*(batch[c].to_pylist() for c in ("block", "n", "reached"))):
                if owner != block:
                    yield from close()
                    block, start = owner, shared.value[owner * BLOCK : (owner + 1) * BLOCK].astype(np.float64)
                    moved, weight = np.zeros(len(start)), np.zeros(len(start))
                change = np.frombuffer(reached, np.float32) - start
                moved += n * change
                weight += n * (change != 0)
        yield from close()

    found = rows.select("shard", "label", "data").mapInArrow(learn, "block int, shard int, n long, reached binary")
    dealt = found.repartition("block").sortWithinPartitions("block", "shard", "n", "reached")
    out = flat.copy()
    for block, reached in dealt.mapInArrow(mean, "block int, reached binary").collect():  # one model
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(reached, np.float32)
    return out


def _counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores without thresholds to the nearest of PARTS a unit, labels, languages, and how many rows have them."""
    shared, key = rows.sparkSession.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"toxicity:{key}", lambda: Scorer(Model(**shared.value))) as scorer:
            for batch in small_batches(batches, 256):
                texts = [words(t) for t in batch["data"].to_pylist()]
                place = np.rint(np.clip(scorer.logits(texts), -700, 700) * PARTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place), batch["label"], pa.array(map(language, texts), pa.int32())], names=["place", "label", "language"])

    counted = rows.select("label", "data").mapInArrow(run, "place long, label int, language int").groupBy("place", "label", "language").count()
    found = np.array(counted.orderBy("place", "label", "language").collect(), np.float64).reshape(-1, 4)
    return found[:, 0] / PARTS, found[:, 1], found[:, 2], found[:, 3]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score from 0 to 1, predicted (1 from 0.5 on).

    Every text is read whole; null and empty ones are scored as a text without words.  A null id is never held out.
    Repeated documents give repeated rows; other columns are ignored.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"toxicity:{key}", lambda: Scorer(Model(**shared.value))) as scorer:
            for batch in small_batches(batches, 256):
                found = scorer.scores([words(t) for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), utf8(text_col).alias("data"))
    scored = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The documents that score below *at*, with all their columns as they are."""
    shared, key, place = docs.sparkSession.sparkContext.broadcast(vars(model)), uuid.uuid4().hex, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"toxicity:{key}", lambda: Scorer(Model(**shared.value))) as scorer:
            for batch in small_batches(batches, 256):
                found = scorer.scores([words(t) for t in batch.column(place).cast(pa.binary()).to_pylist()])
                yield batch.filter(pa.array(found < at))

    return docs.mapInArrow(run, docs.schema)
