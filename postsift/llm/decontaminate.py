"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

Words stand for the letters of the usual algorithm: a shift table over blocks of two words skips positions where no
window can end, the last block of a window selects a bucket of test strings, its first block a part of the bucket, and
a direct comparison confirms an occurrence.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import per_worker, small_batches, utf8, words
from postsift.session import Rounds

WINDOW = 10
#: Benchmark words whose tables a Python worker holds at once (about 150 bytes each).
BLOCK_WORDS = 500_000

FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class WuManber:
    """Finds all windows of one length in a list of words."""

    def __init__(self, length: int, pieces: list[tuple[str | None, list[bytes]]]):
        self.length = length
        self.block = block = min(2, length)
        self.far = length - block + 1
        self.shift: dict[object, int] = {}
        # last block -> first block -> windows as (piece, offset)
        self.buckets: dict[object, dict[object, list[tuple[int, int]]]] = {}
        self.pieces = pieces
        for number, (_, text) in enumerate(pieces):
            keys = text if block == 1 else list(zip(text, text[1:]))
            for at, key in enumerate(keys):
                # the distance from this block to the end of the earliest-ending window that holds it
                near = max(0, length - block - at)
                if near < self.shift.get(key, self.far):
                    self.shift[key] = near
                if at >= length - block:
                    start = at - (length - block)
                    self.buckets.setdefault(key, {}).setdefault(keys[start], []).append((number, start))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, piece) of each occurrence; starts ascend."""
        length, pair, far, shift = self.length, self.block == 2, self.far, self.shift.get
        end, size = length - 1, len(text)
        while end < size:
            key = (text[end - 1], text[end]) if pair else text[end]
            skip = shift(key, far)
            if skip:
                end += skip
                continue
            start = end - length + 1
            first = (text[start], text[start + 1]) if pair else text[start]
            window = None
            for piece, offset in self.buckets[key].get(first, ()):
                window = window or text[start : end + 1]
                if self.pieces[piece][1][offset : offset + length] == window:
                    yield start, piece
            end += 1


class Searcher:
    """Wu-Manber tables for each window length of a block of items."""

    def __init__(self, block: list[tuple[str | None, bytes]], window: int):
        by_length: dict[int, list[tuple[str | None, list[bytes]]]] = {}
        for item, text in block:
            split = text.split()
            by_length.setdefault(min(window, len(split)), []).append((item, split))
        self.tables = [WuManber(n, pieces) for n, pieces in sorted(by_length.items())]

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) spans of hit words, and the ids of the items found."""
        raw, items = [], set()
        for t in self.tables:
            for start, piece in t.find(text):
                raw.append((start, start + t.length))
                items.add(t.pieces[piece][0])
        return merge(raw), items - {None}

    def hits(self, text: list[bytes]) -> bool:
        return any(True for t in self.tables for _ in t.find(text))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as ascending spans that do not touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def item_blocks(
    benchmark: DataFrame, item: str, text: str, window: int, block_words: int
) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size, each small enough to broadcast.

    A long item is cut into pieces that overlap by window - 1 words, so each window is in exactly one piece.
    """
    block, size, step = [], 0, max(1, block_words // 4)
    for name, data in benchmark.select(F.col(item).cast("string"), utf8(text)).toLocalIterator():
        split = words(bytes(data) if data is not None else None)
        for start in range(0, max(1, len(split) - window + 1) if split else 0, step):
            piece = split[start : start + step + window - 1]
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((name, b" ".join(piece)))
            size += len(piece)
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: its id, n_words, the merged spans of hit words [start, end), the ids of the items found.

    An item of fewer than *window* words is one window; one without words has none.  Null and empty texts have no
    words.  A null item id marks words but is not listed; a repeated one is listed once.  Repeated documents give
    repeated rows.  Other columns are ignored.  An empty benchmark finds nothing.

    The benchmark is a query set: it is searched in blocks of at most *block_words* words.  One block needs one pass
    over the documents and no shuffle; each further block is a pass over the stored state of the last.
    """
    spark = docs.sparkSession
    state = docs.select(
        F.col(id_col).alias("id"), utf8(text_col).alias("data"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    schema = state.schema
    rounds, last = None, None
    for block in item_blocks(benchmark, item_col, item_text_col, window, block_words):
        if last is not None:
            rounds = rounds or Rounds(spark, "decontaminate")
            state = rounds.keep(_search(state, last, window, schema), "state")
        last = block
    found = _search(state, last or [], window, schema, count=True)
    return found.withColumnRenamed("id", id_col)


def _search(state: DataFrame, block: list, window: int, schema, count: bool = False) -> DataFrame:
    patterns, name = state.sparkSession.sparkContext.broadcast(block), f"decontaminate:{uuid.uuid4().hex}"
    out = state.schema if not count else state.select(
        "id", F.lit(0).cast("long").alias("n_words"), "spans", "items").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(name, lambda: Searcher(patterns.value, window)) as search:
            names = pa.schema([(f.name, _arrow(f.name)) for f in out.fields if f.name != "id"])
            for batch in small_batches(batches):
                sizes, spans, items = [], [], []
                for data, old, had in zip(batch["data"].to_pylist(), batch["spans"].to_pylist(), batch["items"].to_pylist()):
                    text = words(data)
                    new, found = search.find(text)
                    old = [(s["start"], s["end"]) for s in old or ()]
                    sizes.append(len(text))
                    spans.append([{"start": a, "end": b} for a, b in (merge(old + new) if old else new)])
                    items.append(sorted(found | set(had or ())))
                columns = {"n_words": sizes, "data": batch["data"], "spans": spans, "items": items}
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], *(columns[f.name] if f.name == "data" else pa.array(columns[f.name], f.type) for f in names)],
                    names=["id", *names.names],
                )

    return state.mapInArrow(run, out)


def _arrow(name: str) -> pa.DataType:
    return {
        "n_words": pa.int64(), "data": pa.binary(), "items": pa.list_(pa.string()),
        "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    }[name]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns as they are.

    Null and empty texts stay.  Each block of the benchmark is one filtering pass without a shuffle.
    """
    spark, rounds = docs.sparkSession, None
    for block in item_blocks(benchmark, item_col, item_text_col, window, block_words):
        patterns = spark.sparkContext.broadcast(block)
        if rounds is not None:
            docs = rounds.keep(docs, "rest")
        rounds = rounds or Rounds(spark, "decontaminate")
        docs = docs.mapInArrow(_clean_rows(patterns, docs.columns.index(text_col), window), docs.schema)
    return docs


def _clean_rows(patterns, at: int, window: int):
    name = f"decontaminate:{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(name, lambda: Searcher(patterns.value, window)) as search:
            for batch in small_batches(batches):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not search.hits(words(t)) for t in texts], pa.bool_()))

    return run
