"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

`whole_examples` writes every example with its whole context, a conversation of n turns n/2 times; `read_examples` reads
them back.  `prefix_examples` is the form to store: an example holds the turns since the example before it (`text`), and
where this part begins (`start`); its whole text is the texts of all rows of its conversation up to its own, joined.
`expand` joins them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ASSISTANT = "assistant"
#: The template's marks.  Every one begins with `<|`, which no escaped text contains.
TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: A row that grows beyond this many characters is closed early (trainable false); nothing is cut off.
PART_CHARS = 1_000_000

#: Control strings of this and other chat templates begin at `<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)

EXAMPLE = (
    "conv_id {id}, example long, trainable boolean, text string, start long, loss_start long, loss_end long, "
    "n_turns long"
)
WHOLE = "conv_id {id}, example long, part long, trainable boolean, text string, loss_start long, loss_end long"
DIGEST = (
    "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long, stored_chars long"
)


def escape(text: str) -> str:
    """A text without control strings: a backslash breaks each, and backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _ordered(turns: DataFrame, *keys: str) -> DataFrame:
    """Rows of a conversation together and in order.  The sort spills; nothing gathers a conversation in memory."""
    return turns.repartition(keys[0]).sortWithinPartitions(*keys)


def prefix_examples(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per assistant turn, in order within a partition.

    example counts the rows of a conversation from 0; text is what the example adds to the one before it, beginning at
    character start of the whole text; [loss_start, loss_end) is the reply (escaped) in the whole text; n_turns counts
    the turns in text.  Turns after the last reply, and parts beyond PART_CHARS, are rows with trainable false.

    Null roles and texts count as empty; a null conversation id is a conversation of its own, null turns come first;
    turns with one number are ordered by role and text.  Other columns are ignored.  An empty table gives no rows.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(_format, EXAMPLE.format(id=dict(rows.dtypes)["conv_id"]))


def whole_examples(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Every assistant turn with all turns before it, written out; in order within a partition.

    An example's text is that of its rows joined, by part from 0: a row holds at most PART_CHARS characters.
    [loss_start, loss_end) is the reply (escaped) in the whole text; example counts from 0.  Turns after the last reply
    make one more example with trainable false, the whole conversation.  Nulls and ties are as in prefix_examples.

    Memory holds one conversation's text; what is written is not shuffled.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(lambda batches: _whole(_format(batches)), WHOLE.format(id=dict(rows.dtypes)["conv_id"]))


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    return _ordered(rows, "conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _emitter(names: list[str], kind: pa.DataType):
    types = {
        "conv_id": kind, "trainable": pa.bool_(), **dict.fromkeys(("text", "turns_sha256", "loss_sha256", "reply"), pa.string()),
    }
    schema = pa.schema([(n, types.get(n, pa.int64())) for n in names])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return emit


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    emit, out, size = None, [], 0
    conv: object = _format  # equal to no id
    parts: list[str] = []
    number = start = chars = turns = 0

    def close(trainable: bool, loss: tuple[int, int]) -> None:
        nonlocal number, start, chars, turns, parts, size
        if parts:
            out.append((conv, number, trainable, "".join(parts), start, *loss, turns))
            number, start, size = number + 1, start + chars, size + chars
            parts, chars, turns = [], 0, 0

    for batch in batches:
        emit = emit or _emitter(EXAMPLE_NAMES, batch.schema.field("conv_id").type)
        for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != conv:
                close(False, (start + chars,) * 2)
                conv, number, start = key, 0, 0
            head, body = f"{TURN}{escape(role)}{SAY}", escape(text)
            parts += (head, body, END)
            loss = start + chars + len(head)
            chars += len(head) + len(body) + len(END)
            turns += 1
            if role == ASSISTANT:
                close(True, (loss, loss + len(body)))
            elif chars > PART_CHARS:
                close(False, (start + chars,) * 2)
            if size > PART_CHARS:
                yield emit(out)
                out.clear()
                size = 0
    close(False, (start + chars,) * 2)
    if out:
        yield emit(out)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of prefix_examples as whole examples."""
    emit, out, size = None, [], 0
    conv: object = _whole  # equal to no id
    whole, number, said = "", 0, 0  # said: the characters up to the last reply's end

    def write(trainable: bool, loss: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for part, at in enumerate(range(0, len(whole), PART_CHARS)):
            out.append((conv, number, part, trainable, whole[at : at + PART_CHARS], *loss))
            size += len(out[-1][4])
            if size >= PART_CHARS:
                yield emit(out)
                out.clear()
                size = 0
        number += 1

    for batch in batches:
        emit = emit or _emitter(WHOLE_NAMES, batch.schema.field("conv_id").type)
        columns = (batch[n].to_pylist() for n in ("conv_id", "trainable", "text", "loss_start", "loss_end"))
        for key, trainable, text, *loss in zip(*columns):
            if key != conv:
                if said < len(whole):
                    yield from write(False, (len(whole),) * 2)
                conv, whole, number, said = key, "", 0, 0
            whole += text
            if trainable:
                yield from write(True, loss)
                said = len(whole)
    if said < len(whole):
        yield from write(False, (len(whole),) * 2)
    if out:
        yield emit(out)


EXAMPLE_NAMES = [c.split()[0] for c in EXAMPLE.split(", ")]
WHOLE_NAMES = [c.split()[0] for c in WHOLE.split(", ")]
DIGEST_NAMES = [c.split()[0] for c in DIGEST.split(", ")]


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """(role, text, place of the escaped text) of each turn of a formatted text from place *at* on."""
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError("no turn mark where a turn begins")
        say = text.index(SAY, at)
        end = text.index(END, say)
        yield unescape(text[at + len(TURN) : say]), unescape(text[say + len(SAY) : end]), say + len(SAY)
        at = end + len(END)


def digests(examples: DataFrame) -> DataFrame:
    """Read the examples back: one row per conversation with digests of its turns and of the text under the loss mask.

    *examples* is the ordered result of prefix_examples.  formatted_chars sums the whole texts of the examples, as a
    trainer reads them; stored_chars counts each turn once.
    """
    kind = dict(examples.dtypes)["conv_id"]
    return examples.mapInArrow(_read_back, DIGEST.format(id=kind))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    emit, out, conv = None, [], _read_back
    turns = loss_chars = formatted = made = stored = 0
    said, loss = sha256(), sha256()

    def close() -> None:
        if conv is not _read_back:
            out.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), formatted, made, stored))

    for batch in batches:
        emit = emit or _emitter(DIGEST_NAMES, batch.schema.field("conv_id").type)
        columns = (batch[n].to_pylist() for n in ("conv_id", "trainable", "text", "start", "loss_start", "loss_end"))
        for key, trainable, text, start, begin, end in zip(*columns):
            if key != conv:
                close()
                conv, turns, loss_chars, formatted, made, stored = key, 0, 0, 0, 0, 0
                said, loss = sha256(), sha256()
            for role, body, _ in parse(text):
                turns += 1
                said.update(f"{role}\n{body}\n".encode())
            stored += len(text)
            if trainable:
                reply = unescape(text[begin - start : end - start])
                loss.update(reply.encode())
                loss_chars += len(reply)
                formatted += start + len(text)
                made += 1
        if len(out) > 10_000:
            yield emit(out)
            out.clear()
    close()
    if out:
        yield emit(out)


def read_examples(examples: DataFrame) -> DataFrame:
    """Read whole examples back, with the result that `digests` has.  *examples* is the ordered result of whole_examples.

    Each example has to begin with the one before it, character by character; the turns after that are parsed, and the
    loss is read from the example's own mask.
    """
    return examples.mapInArrow(_read_whole, DIGEST.format(id=dict(examples.dtypes)["conv_id"]))


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    emit, out, conv = None, [], _read_whole
    turns = loss_chars = formatted = made = 0
    said, loss, before = sha256(), sha256(), ""
    parts: list[str] = []
    trainable, begin, end = False, 0, 0

    def read() -> None:
        """An example whose parts are all there."""
        nonlocal turns, loss_chars, formatted, made, before
        if not parts:
            return
        whole = "".join(parts)
        parts.clear()
        if not whole.startswith(before):
            raise ValueError("an example does not begin with the one before it")
        for role, body, _ in parse(whole, len(before)):
            turns += 1
            said.update(f"{role}\n{body}\n".encode())
        if trainable:
            reply = unescape(whole[begin:end])
            loss.update(reply.encode())
            loss_chars += len(reply)
            formatted += len(whole)
            made += 1
        before = whole

    def close() -> None:
        if conv is not _read_whole:
            out.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), formatted, made, len(before)))

    for batch in batches:
        emit = emit or _emitter(DIGEST_NAMES, batch.schema.field("conv_id").type)
        columns = (batch[n].to_pylist() for n in ("conv_id", "part", "trainable", "text", "loss_start", "loss_end"))
        for key, part, learnt, text, first, last in zip(*columns):
            if part == 0:
                read()
                trainable, begin, end = learnt, first, last
            if key != conv:
                close()
                conv, turns, loss_chars, formatted, made = key, 0, 0, 0, 0
                said, loss, before = sha256(), sha256(), ""
            parts.append(text)
        if len(out) > 10_000:
            yield emit(out)
            out.clear()
    read()
    close()
    if out:
        yield emit(out)


def expand(examples: DataFrame) -> DataFrame:
    """Whole texts: (conv_id, example, text, reply) per assistant turn, for conversations of bounded length.

    Writes a conversation of n turns about n/2 times; memory holds one conversation's text.
    """
    kind = dict(examples.dtypes)["conv_id"]
    rows = _ordered(examples, "conv_id", "example")
    return rows.mapInArrow(_expander(), f"conv_id {kind}, example long, text string, reply string")


def _expander() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, whole, emit = run, "", None
        for batch in batches:
            emit = emit or _emitter(["conv_id", "example", "text", "reply"], batch.schema.field("conv_id").type)
            columns = (batch[n].to_pylist() for n in ("conv_id", "example", "trainable", "text", "loss_start", "loss_end"))
            for key, number, trainable, text, begin, end in zip(*columns):
                whole = (whole if key == conv else "") + text
                conv = key
                if trainable:
                    yield emit([(key, number, whole, unescape(whole[begin:end]))])

    return run
