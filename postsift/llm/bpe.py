"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A sequence of tokens is the BPE encoding of its bytes exactly when each two neighbours are: when no merge across their
border comes before the merges that made them.  So a nondeterministic transducer accepts one token sequence for each
input: its configurations are (tokens not yet written, last token, bytes read of the token after it).  Determinised, a
state is the set of configurations that the bytes read so far allow; tokens on which all of them agree are written, and
a configuration ends when no token continues it, so a token is written after a lookahead bounded by the longest token.
States are built when first reached, and all are dropped when they become many.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import per_worker, small_batches

#: Bounds on what a Python worker keeps: transducer states, checked token pairs, and encodings of pieces (twice) of at
#: most so many characters.  Together they stay under about 260 MB (measured).
MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_PIECE_CHARS = 200_000, 50_000, 60_000, 64
#: Longer texts are split into pieces by and by, to bound the pieces alive at once.
LONG_CHARS, PART = 1_000_000, 100_000
#: A node of the trie with at most so many tokens below it is searched for one that can follow.
FEW_TOKENS = 16
_NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: one line each, the token in base 64 and its id, which is its merge's rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merges:
    """The merge rules that the ranks stand for, and a trie of the tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # node 0 is the root; (node * 256 + byte) to node, and the token that ends at a node
        self.trie: dict[int, int] = {}
        self.token_at = [-1]  # a list, so that all encodings share one number object for each token
        # the tokens below a node are a range of all in byte order
        self.sorted = array("i", [rank for _, rank in sorted(ranks.items())])
        self.first, self.end = array("i", [0]), array("i", [len(ranks)])
        for place, rank in enumerate(self.sorted):
            node = 0
            for byte in self.tokens[rank]:
                node = self.trie.setdefault(node * 256 + byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.first.append(place)
                    self.end.append(place)
                self.end[node] = place + 1
            self.token_at[node] = ranks[self.tokens[rank]]
        self._ends: dict[int, tuple[list, list]] = {}
        # by the first number times 2 ** 32 plus the second
        self._pairs: dict[int, bool] = {}
        self._open: dict[int, bool] = {}

    def parts(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merge the pair of lowest rank, the first of equals, until *until* parts or no pair is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _sides(self, token: int) -> tuple[list, list]:
        """The parts a token is made of along its right and its left edge, each with the rank of the merge that ends it."""
        if token not in self._ends:
            right, left = [], []
            for side, out in ((-1, right), (0, left)):
                part, until = self.tokens[token], _NEVER
                while True:
                    out.append((part, until))
                    two = self.parts(part, 2) if len(part) > 1 else ()
                    if len(two) != 2:
                        break
                    until = self.ranks[part]
                    part = two[side]
            self._ends[token] = (right, left)
        return self._ends[token]

    def adjacent(self, a: int, b: int) -> bool:
        """True if the encoding of the bytes of a and b is a, b."""
        known = self._pairs.get(a << 32 | b)
        if known is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[a << 32 | b] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        rank, right = self.ranks.get, self._sides(b)[1]
        for x, before in self._sides(a)[0]:
            for y, after in right:
                # a merge across the border wins against the merge on its left if earlier, on its right also if equal
                r = rank(x + y)
                if r is not None and r < before and r <= after:
                    return False
        return True

    def may_follow(self, last: int, node: int) -> bool:
        """False if no token below the node can follow *last*.  Nodes with many tokens are not searched."""
        known = self._open.get(last << 32 | node)
        if known is None:
            if len(self._open) > MAX_PAIRS:
                self._open.clear()
            first, end = self.first[node], self.end[node]
            known = end - first > FEW_TOKENS or any(self.adjacent(last, t) for t in self.sorted[first:end])
            self._open[last << 32 | node] = known
        return known


class Transducer:
    """Encodes pieces of bytes.  A step is (the next state's steps by byte, tokens written, its configurations)."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self._reset()

    def _reset(self) -> None:
        self.known: dict[tuple, tuple[dict, tuple, tuple]] = {}
        self.start = self._silent((((), -1, 0),))

    def _silent(self, configurations) -> tuple[dict, tuple, tuple]:
        """The step into a state that writes nothing; all such steps are one object.

        Configurations are (tokens not yet written, last token, trie node), the longest read part first.  A state keeps
        them as one flat tuple, in which the number of tokens comes first.
        """
        flat: list[int] = []
        for written, last, node in configurations:
            flat += (len(written), *written, last, node)
        key = tuple(flat)
        step = self.known.get(key)
        if step is None:
            step = self.known[key] = ({}, (), key)
        return step

    @staticmethod
    def _end(flat: tuple) -> tuple[int, ...]:
        """The tokens still to write where a piece ends: those of the last configuration, which has just ended a token."""
        at, end = 0, 0
        while end < len(flat):
            at, end = end, end + flat[end] + 3
        if flat[-1]:
            raise ValueError("no token sequence: the ranks lack a byte")
        return flat[at + 1 : end - 2]

    def _step(self, here: tuple[dict, tuple, tuple], byte: int) -> tuple[dict, tuple, tuple]:
        """Follow all configurations over one byte."""
        trie, token_at, adjacent = self.merges.trie.get, self.merges.token_at, self.merges.adjacent
        known, may_follow = self.merges._open.get, self.merges.may_follow
        after, closed = [], None
        flat, at = here[2], 0
        while at < len(flat):
            start, at = at + 1, at + flat[at] + 3
            written, last, node = flat[start : at - 2], flat[at - 2], trie(flat[at - 1] * 256 + byte)
            if node is None or last >= 0 and not ((go := known(last << 32 | node)) or go is None and may_follow(last, node)):
                continue
            after.append((written, last, node))
            # as encodings are unique, at most one configuration ends a token here
            if closed is None and (token := token_at[node]) >= 0 and (last < 0 or adjacent(last, token)):
                closed = ((*written, token), token, 0)
        if closed:
            after.append(closed)
        if not after:
            raise ValueError("no token sequence: the ranks lack a byte")
        # the tokens on which all agree
        agreed = after[0][0]
        if agreed:
            for written, _, _ in after:
                while written[: len(agreed)] != agreed:
                    agreed = agreed[:-1]
            after = [(written[len(agreed) :], last, node) for written, last, node in after]
        step = self._silent(after)
        step = here[0][byte] = (step[0], agreed, step[2]) if agreed else step
        return step

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.known) > self.max_states:
            self._reset()
        out: list[int] = []
        here = self.start
        for byte in piece:
            step = here[0].get(byte)
            if step is None:
                if len(self.known) > self.max_states:  # within a piece of any length; the state at hand goes on
                    self._reset()
                step = self._step(here, byte)
            here = step
            if here[1]:
                out += here[1]
        return (*out, *self._end(here[2]))


class Encoder:
    """Splits texts by a pattern and encodes each match; remembers the encodings of frequent pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern)
        self.transducer = Transducer(Merges(ranks))
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _lookup(self, pieces: list[str]) -> Iterator[int]:
        if len(self.pieces) > MAX_PIECES:
            self.pieces, self.older = {}, self.pieces
        known, older, encode = self.pieces, self.older.get, self.transducer.encode
        long = {}
        for piece in set(pieces).difference(known):
            (known if len(piece) <= MAX_PIECE_CHARS else long)[piece] = older(piece) or encode(piece.encode())
        if long:
            return chain.from_iterable(known[p] if p in known else long[p] for p in pieces)
        return chain.from_iterable(map(known.__getitem__, pieces))

    def encode(self, text: str) -> array:
        """The ids of a text."""
        if len(text) <= LONG_CHARS:
            return array("i", self._lookup(self.split.findall(text)))
        out = array("i")
        matches = (m[0] for m in self.split.finditer(text))
        while part := list(islice(matches, PART)):
            out.extend(self._lookup(part))
        return out


def _utf8_machine() -> list[list[int]]:
    """State and byte to the next state; state 0 is between characters, -1 is no UTF-8.

    The other states are (continuation bytes to come, lowest and highest next byte).
    """
    states = [None, (1, 0x80, 0xBF), (2, 0x80, 0xBF), (3, 0x80, 0xBF), (2, 0xA0, 0xBF), (2, 0x80, 0x9F), (3, 0x90, 0xBF), (3, 0x80, 0x8F)]
    lead = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7} | dict.fromkeys(range(0xC2, 0xE0), 1)
    lead = dict.fromkeys(range(0xE1, 0xF0), 2) | dict.fromkeys(range(0xF1, 0xF4), 3) | dict.fromkeys(range(0x80), 0) | lead
    table = [[lead.get(b, -1) for b in range(256)]]
    for left, low, high in states[1:]:
        table.append([left - 1 if low <= b <= high else -1 for b in range(256)])
    return table


class Utf8Decoder:
    """Decodes a stream of tokens.  Bytes that are no UTF-8 become U+FFFD, one for each maximal broken part."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.machine = tokens, _utf8_machine()
        # tokens that are whole characters, and the steps of the others
        self.whole = {i: text for i, data in tokens.items() if (text := self._step(b"", data))[1] == b"" and "�" not in text[0]}
        self.whole = {i: text for i, (text, _) in self.whole.items()}
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def _step(self, open_bytes: bytes, data: bytes) -> tuple[str, bytes]:
        """(text, bytes of an unfinished character) after more bytes."""
        machine, state = self.machine, 0
        for b in open_bytes:
            state = machine[state][b]
        out, part = [], open_bytes
        for b in data:
            reached = machine[state][b]
            if reached < 0 and state:
                out.append("�")
                part, state = b"", 0
                reached = machine[0][b]
            if reached < 0:
                out.append("�")
                part, state = b"", 0
            elif reached:
                part, state = part + bytes((b,)), reached
            else:
                out.append((part + bytes((b,))).decode())
                part, state = b"", 0
        return "".join(out), part

    def decode(self, ids, open_bytes: bytes = b"") -> tuple[str, bytes]:
        """(text, bytes left open) of the next ids of a stream."""
        if not open_bytes:
            try:
                return "".join(map(self.whole.__getitem__, ids)), b""
            except KeyError:
                pass
        out = []
        for i in ids:
            if not open_bytes and i in self.whole:
                out.append(self.whole[i])
                continue
            step = self.steps.get((open_bytes, i))
            if step is None:
                step = self.steps[open_bytes, i] = self._step(open_bytes, self.tokens[i])
            out.append(step[0])
            open_bytes = step[1]
        return "".join(out), open_bytes

    def text(self, ids) -> str:
        """The whole text, fed part by part."""
        out, left = [], b""
        for start in range(0, len(ids), PART):
            text, left = self.decode(ids[start : start + PART], left)
            out.append(text)
        return "".join(out) + ("�" if left else "")

    def data(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _ranks(df: DataFrame, path: str):
    """The rank file, read once by the driver; its size does not grow with the data.

    Its digest names what workers keep, so that later jobs of a session go on with the states that earlier ones found.
    """
    with open(path, "rb") as file:
        data = file.read()
    return df.sparkSession.sparkContext.broadcast(data), hashlib.md5(data).hexdigest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> tuple[list[array], pa.ListArray]:
    """The ids of a batch's texts, also as one column."""
    found = [encoder.encode(text or "") for text in batch.column(1).to_pylist()]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    values = np.concatenate([np.frombuffer(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
    return found, pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the ids of its tokens.

    *path* is a rank file, *pattern* the regular expression whose matches are encoded one by one.  Null and empty texts
    have no tokens.  Special tokens are ordinary text.  Repeated documents give repeated rows; other columns are
    ignored.  Nothing is shuffled.
    """
    ranks, key = _ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"encoder:{key}{pattern}", lambda: Encoder(read_ranks(ranks.value), pattern)) as encoder:
            for batch in small_batches(batches, 64):
                yield pa.RecordBatch.from_arrays([batch.column(0), _encoded(encoder, batch)[1]], names=["id", "ids"])

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: its id, the text of its token ids, and the tokens' bytes.  Null ids count as none."""
    ranks, key = _ranks(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"decoder:{key}", lambda: Utf8Decoder({i: t for t, i in read_ranks(ranks.value).items()})) as decoder:
            for batch in small_batches(batches, 64):
                lists = [ids or [] for ids in batch.column(1).to_pylist()]
                texts = pa.array(map(decoder.text, lists), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(map(decoder.data, lists), pa.binary())], names=["id", "text", "data"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string, data binary").withColumnRenamed("id", id_col)


def round_trip(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Encode each text as `encode` does, then decode its ids as `decode` does, in one pass.

    One row per document: its id, n_tokens, and SHA-256 digests of the ids in decimal, joined by spaces, and of the
    decoded bytes; with *keep_ids* also the ids.
    """
    from hashlib import sha256

    ranks, key = _ranks(docs, path)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def build() -> tuple[Encoder, Utf8Decoder]:
        table = read_ranks(ranks.value)
        return Encoder(table, pattern), Utf8Decoder({i: t for t, i in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"round-trip:{key}{pattern}", build) as (encoder, decoder):
            for batch in small_batches(batches, 64):
                found, lists = _encoded(encoder, batch)
                said = pa.array([sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in found], pa.string())
                back = pa.array([sha256(decoder.text(ids).encode()).hexdigest() for ids in found], pa.string())
                sizes = pa.array(map(len, found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, said, back, *[lists] * keep_ids], names=names)

    rows = _texts(docs, id_col, text_col)
    out = f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
