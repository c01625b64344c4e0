"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of the raw corpus, give every document the
weight log p_target(text) - log p_raw(text).  Adding Gumbel noise and keeping the k largest keys draws k documents
without replacement with probabilities in proportion to their weights.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import per_worker, small_batches, utf8
from postsift.session import cut_lineage

#: Hash buckets of the n-grams: all that the models keep, whatever the corpus.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents that the target model is made from, at most.  The raw model counts all documents.
TARGET_ROWS = 20_000
#: Words whose hashes a Python worker remembers; words hashed at once.
KNOWN, SLICE = 300_000, 200_000
_MIX, _DOWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKET_BITS)


class Hasher:
    """Buckets of the single words and the pairs of neighbours of a text.  Words are runs of non-space bytes, as they
    stand: marks and case tell junk from prose."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def buckets(self, data: bytes | None) -> Iterator[np.ndarray]:
        words = data.split() if data else []
        if len(self.known) > KNOWN:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = zlib.crc32(word)
        for at in range(0, len(words), SLICE):
            part = words[at : at + SLICE + 1]  # one word more: the pair across the border
            own = np.fromiter(map(self.known.__getitem__, part), np.uint64, len(part))
            pairs = (own[:-1] * _MIX + own[1:]) * _MIX
            yield (own[:SLICE] * _MIX >> _DOWN).astype(np.int64)
            yield (pairs >> _DOWN).astype(np.int64)


def _counts(docs: DataFrame, data: str) -> DataFrame:
    """(bucket, n): summed per task first, so a task sends BUCKETS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hasher = np.zeros(BUCKETS, np.int64), Hasher()
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                for found in hasher.buckets(text):
                    total += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return docs.select(data).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _model(docs: DataFrame, data: str) -> np.ndarray:
    """Log probabilities of the buckets, with one added to every count.  The driver gets BUCKETS rows at most."""
    counts = np.ones(BUCKETS)
    for bucket, n in _counts(docs, data).collect():
        counts[bucket] += n
    return np.log(counts / counts.sum())


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, log_weight, n_grams, and sample_key = log_weight + Gumbel noise.

    The models count all texts of *docs* and of *target*, whole.  The noise is a function of the id, so runs agree.  A
    text without words has weight 0; a null id draws the noise of the empty id.
    """
    raw = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    ratio = _model(target.select(utf8(text_col).alias("data")), "data") - _model(raw, "data")
    shared, key = docs.sparkSession.sparkContext.broadcast(ratio), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"resampling:{key}", lambda: (Hasher(), shared.value)) as (hasher, ratio):
            for batch in small_batches(batches):
                weights, sizes, keys = [], [], []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    weight, size = 0.0, 0
                    for found in hasher.buckets(text):
                        weight += float(ratio[found].sum())
                        size += len(found)
                    weights.append(weight)
                    sizes.append(size)
                    keys.append(weight + gumbel(name))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(weights, pa.float64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.float64())],
                    names=["id", "log_weight", "n_grams", "sample_key"],
                )

    return raw.mapInArrow(run, f"id {dict(raw.dtypes)['id']}, log_weight double, n_grams long, sample_key double")


def target_sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", rows: int = TARGET_ROWS,
) -> DataFrame:
    """The documents labelled 1, at most *rows* ids of them, chosen by a hash of the id.  The texts are not shuffled: the
    number of ids that travel to them is bounded.  Null ids and labels are left out."""
    ids = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    chosen = ids.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(chosen), id_col, "left_semi")


def gumbel(name: object) -> float:
    """Standard Gumbel noise from a hash of an id."""
    text = b"" if name is None else str(name).encode()
    uniform = ((int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 12) + 0.5) / 2.0**52
    return float(-np.log(-np.log(uniform)))


def largest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows with the k largest keys, and all rows that tie with the last of them.

    The k-th key is found by counting: each pass splits the interval that holds it into 1000 parts.  A pass is one
    aggregate of 1000 rows; when the interval cannot be split any more, its end is the k-th key.
    """
    if k <= 0:
        return rows.limit(0)
    low, high, total = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if total <= k:
        return rows
    parts, above = 1000, 0
    while True:
        width = (high - low) / parts
        if not low < low + width < high:
            break
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(parts - 1))
        counts = rows.where(F.col(key).between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for row in sorted(counts, key=lambda r: -r["part"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        if low == high:
            break
    return rows.where(F.col(key) >= low)


def resample(
    docs: DataFrame, target: DataFrame, *, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The drawn documents: id, log_weight, n_grams, sample_key.  Give their number *k*, or their *share* of all rows.

    Repeated rows have equal keys and are drawn together; ties with the last row drawn are drawn too.  An empty target
    or corpus has uniform models: then the draw is uniform, or empty.
    """
    weighed = cut_lineage(weigh(docs, target, id_col=id_col, text_col=text_col), "resampling")
    if k is None:
        k = round(share * weighed.count())
    return largest(weighed, "sample_key", k).withColumnRenamed("id", id_col)
