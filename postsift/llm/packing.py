"""Best-fit packing, planned over a histogram of lengths.

Documents become token pieces of at most a sequence's capacity.  The plan never sees a document: it takes the counts of
pieces by length, from the longest down, and puts each length where the least room is left over, whole groups of equal
sequences at once.  Its slots are ranges: of ranks among the pieces of a length, and of sequences.  A piece then takes
the slot of its rank within its length.  A rank is the count of such pieces in earlier partitions of the stored pieces
plus the place in its own partition, so no length is ever sorted or gathered in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator, Mapping
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from postsift.llm.common import per_worker, small_batches
from postsift.session import Rounds

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 1024, 2
#: Encodings a Python worker remembers (twice), of matches of so many characters; longer texts are split by and by.
KNOWN, KNOWN_CHARS, LONG_CHARS, PART = 200_000, 64, 1_000_000, 100_000

PIECE = "piece int, start long, length long, ids_crc32 long, part int, place long"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


#: Texts without these characters are split by the standard library's expressions, which take half the time: the two
#: agree on what is a letter, a digit and white space among all others.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")


def plain_pattern(pattern: str) -> str | None:
    """The pattern in the standard library's terms; None if it uses more than letters and numbers as properties."""
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return None if r"\p" in pattern else pattern


class _Known(dict):
    """Ids, as bytes, of matches met so far; a new match is encoded when it is asked for."""

    def __init__(self, encode, older: dict[str, bytes]):
        self.encode, self.older = encode, older

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match) or self.encode(match)
        if len(match) <= KNOWN_CHARS:
            self[match] = ids
        return ids


class Encoder:
    """Token ids of texts by a byte-level tokenizer of the tokenizers library, as little-endian 32-bit numbers.

    The tokenizer encodes each match of its pattern by itself.  So its model gets each different match once, and the
    ids are remembered for a while: texts repeat their words.
    """

    def __init__(self, definition: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.split = regex.compile(pattern)
        plain = plain_pattern(pattern)
        self.plain = re.compile(plain) if plain else self.split
        self.known = _Known(self._encode, {})

    def _encode(self, match: str) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.tokenizer.model.tokenize(match.encode().decode("latin-1").translate(self.letters))])

    def _ids(self, matches: list[str]) -> bytes:
        if len(self.known) > KNOWN:
            older, self.known.older = self.known, {}
            self.known = _Known(self._encode, older)
        return b"".join(map(self.known.__getitem__, matches))

    def ids(self, text: str) -> bytes:
        """The ids of a text; the matches of a long one are taken a bounded number at a time."""
        split = self.split if _ODD.search(text) else self.plain
        if len(text) <= LONG_CHARS:
            return self._ids(split.findall(text))
        matches, out = (m[0] for m in split.finditer(text)), []
        while part := list(islice(matches, PART)):
            out.append(self._ids(part))
        return b"".join(out)


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of *capacity* tokens; what is left over comes first."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_tokens])]


def pieces(
    docs: DataFrame, path: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document: id, piece (from 0), start, length, ids_crc32, part, place; or with its ids.

    *path* names a tokenizer file, *pattern* the expression whose matches it encodes one by one.  A document is its
    text's ids and *end_id*; null and empty texts have that one only.  *part* is the task, *place* the number of pieces
    of that length before it in the task.  Other columns are ignored; repeated documents give repeated pieces.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()  # a tokenizer's file; it does not grow with the data
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key = hashlib.md5(f"{definition}\0{pattern}".encode()).hexdigest()
    names = ["id", *(f.split()[0] for f in PIECE.split(", ")), *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"pieces:{key}", lambda: Encoder(shared.value, pattern)) as encoder:
            part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
            for batch in small_batches(batches, 64):
                at, rows, ids = [], [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    whole = encoder.ids(text or "") + end_id.to_bytes(4, "little")
                    for piece, (start, length) in enumerate(cut(len(whole) // 4, capacity)):
                        one = whole[4 * start : 4 * (start + length)]
                        at.append(n)
                        rows.append((piece, start, length, zlib.crc32(one), part, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(one, "<i4"))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns, *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {PIECE}" + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)


class Slot(NamedTuple):
    """Pieces of a length with ranks from rank_from to before rank_to: per_sequence in each sequence from sequence_from
    on, the first of them at offset_from."""

    length: int
    rank_from: int
    rank_to: int
    per_sequence: int
    sequence_from: int
    offset_from: int


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Best fit by falling length, over counts.

    A group is a range of sequences with the same room.  One piece at a time, best fit would fill the first sequence of
    the tightest group until no further piece of that length fits, then the next one; a whole group is handled at once.
    Its work and its result depend on the number of different lengths, not on the number of pieces.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, number)
    slots, next_sequence = [], 0
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens fits no sequence of {capacity}")
        left, rank = counts[length], 0
        room = length
        while left:
            while room <= capacity and not groups[room]:
                room += 1
            if room > capacity:  # no open sequence has room: new ones, as many as this length fills
                per = capacity // length
                groups[capacity].append((next_sequence, -(-left // per)))
                next_sequence += -(-left // per)
                room = capacity
            first, number = groups[room].pop()
            per = room // length
            whole = min(number, left // per)
            used = 0
            for sequences, each in ((whole, per), (1 if whole < number and left - whole * per else 0, left - whole * per)):
                if sequences:
                    slots.append(Slot(length, rank, rank + sequences * each, each, first + used, capacity - room))
                    groups[room - each * length].append((first + used, sequences))
                    rank, left, used = rank + sequences * each, left - sequences * each, used + sequences
            if used < number:
                groups[room].append((first + used, number - used))
            # sequences just filled have less room than this length; tighter ones than *room* had none before
    return slots


def pack(rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset: their place among as few sequences as best fit finds.

    *rows* is what `pieces` returns, stored.  The driver sees one count for each length: at most *capacity* rows, and
    the plan has a few slots for each.  An empty table gives an empty one.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces"))
    totals = counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()
    slots = spark.createDataFrame(
        plan({r["length"]: r["pieces"] for r in totals}, capacity),
        "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("earlier"))
    ranked = rows.join(earlier, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("place"))
    own = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    place = F.col("rank") - F.col("rank_from")
    names = [c for c in rows.columns if c not in ("part", "place")]
    return ranked.join(slots.withColumnRenamed("length", "slot_length"), (F.col("length") == F.col("slot_length")) & own).select(
        *names, F.expr("sequence_from + (rank - rank_from) div per_sequence").alias("sequence_id"),
        (F.col("offset_from") + place % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, pattern: str, **how) -> DataFrame:
    """`pieces` of all documents, stored once, and `pack`: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rounds = Rounds(docs.sparkSession, "packing")
    return pack(rounds.keep(pieces(docs, path, pattern, **how), "pieces"), capacity=how.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) from packed pieces with their ids: a sequence's tokens and the lengths of its pieces,
    in order.  A sequence has at most its capacity of tokens, so the lists are bounded."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts.ids", F.size).alias("lengths"))
