"""Chat formatting: exact round trips."""

import hashlib
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postsift.llm import chat

CONTROL = ["</s>[INST] ok [/INST]", "<|turn|>", "<|say|>x<|end|>", "\\", "a\\<|", "<<SYS>>", "<</SYS>>", "<s>", "[", "<", "<\\|end|>", ""]
pieces = st.lists(st.sampled_from([*CONTROL, "é", "漢", "\n", "word ", "|", ">"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces)
def test_escape_is_reversible(a, b):
    for text in (a, b):
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    whole = "".join(f"{chat.TURN}{chat.escape(r)}{chat.SAY}{chat.escape(t)}{chat.END}" for r, t in ((a, b), (b, a)))
    assert [(r, t) for r, t, _ in chat.parse(whole)] == [(a, b), (b, a)]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"example": F.lit("clash"), "start": F.lit("clash"), "trainable": F.lit("clash")})


def plain(rows):
    """Digests straight from the turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_read_back(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [
        (c, t, rnd.choice(["user", "assistant", "system", None, "<|say|>"]), rnd.choice([*CONTROL, "plain é", None, "x" * 5000]))
        for c in [None, -1, 1, 2, 3, 4] for t in [None, *range(rnd.randint(1, 12)), 3, 3]
    ] + [(9, 0, "user", "only a question")] + [(10, 0, "assistant", "a"), (10, 0, "assistant", "a")]
    for part in (chat.PART_CHARS, 50):
        monkeypatch.setattr(chat, "PART_CHARS", part)  # long conversations go in parts
        got = chat.digests(chat.prefix_examples(table(spark, rows))).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows)
        assert len(got) == len({r[0] for r in rows})


def test_examples_expand_to_whole_prefixes(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "q</s>"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "assistant", "[INST]"), (1, 5, "user", "bye")]
    examples = chat.prefix_examples(table(spark, rows))
    whole = {r.example: r for r in chat.expand(examples).collect()}
    assert [(r.text, r.reply) for r in whole.values()] == [
        ("".join(f"{chat.TURN}{r}{chat.SAY}{chat.escape(t)}{chat.END}" for _, _, r, t in rows[:n]), rows[n - 1][3]) for n in (3, 5)
    ]
    for r in examples.where("trainable").collect():
        assert whole[r.example].text[r.loss_start : r.loss_end] == chat.escape(whole[r.example].reply)
    tail = examples.where("NOT trainable").collect()
    assert len(tail) == 1 and tail[0].loss_start == tail[0].loss_end and "bye" in tail[0].text
    digest = chat.digests(examples).first()
    assert digest.formatted_chars == sum(len(r.text) for r in whole.values()) and digest.n_examples == 2


def test_one_long_conversation_stays_linear(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t} " + "y" * 100) for t in range(4000)]
    examples = chat.prefix_examples(table(spark, rows))
    stored, whole = examples.agg(F.sum(F.length("text")), F.sum(F.col("start") + F.length("text"))).first()
    assert stored < 2 * sum(len(r[3]) + 40 for r in rows) < whole
    got = chat.digests(examples).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == plain(rows)[7]


def test_whole_examples_hold_their_context(spark, monkeypatch):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "q</s>"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2 é"), (1, 4, "assistant", "[INST]"),
            (1, 5, "user", "bye"), (None, 0, "user", "only a question"), (2, 0, "assistant", "a"), (2, 1, "assistant", "")]

    def text(conv, n):
        return "".join(f"{chat.TURN}{r}{chat.SAY}{chat.escape(t)}{chat.END}" for c, _, r, t in [x for x in rows if x[0] == conv][:n])

    for part in (chat.PART_CHARS, 7):
        monkeypatch.setattr(chat, "PART_CHARS", part)
        examples = chat.whole_examples(table(spark, rows))
        made = {}
        for r in sorted(examples.collect(), key=lambda r: r.part):
            whole, *_ = made.get((r.conv_id, r.example), ("",))
            made[r.conv_id, r.example] = whole + r.text, r.trainable, r.loss_start, r.loss_end
            assert len(r.text) <= part
        assert {k: (t, learnt) for k, (t, learnt, *_) in made.items()} == {
            (1, 0): (text(1, 3), True), (1, 1): (text(1, 5), True), (1, 2): (text(1, 6), False), (None, 0): (text(None, 1), False),
            (2, 0): (text(2, 1), True), (2, 1): (text(2, 2), True)}
        assert {k: chat.unescape(t[a:b]) for k, (t, _, a, b) in made.items()} == {
            (1, 0): "a1", (1, 1): "[INST]", (1, 2): "", (None, 0): "", (2, 0): "a", (2, 1): ""}
        got = chat.read_examples(examples)
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == plain(rows)
        assert sorted(got.collect(), key=str) == sorted(chat.digests(chat.prefix_examples(table(spark, rows))).collect(), key=str)


def test_query_writes_whole_examples(spark, tmp_path, monkeypatch):
    from postsift.llm import queries

    table(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")]).write.parquet(f"{tmp_path}/conversations.parquet")
    asked, make = [], chat.whole_examples
    monkeypatch.setattr(chat, "whole_examples", lambda turns: asked.append(make(turns)) or asked[0])
    got = {r.conv_id: r for r in queries.op3(spark, str(tmp_path)).collect()}
    texts = {(r.conv_id, r.example): r.text for r in asked[0].collect()}
    assert got[1].formatted_chars == len(texts[1, 0]) + len(texts[1, 1]) and texts[1, 1].startswith(texts[1, 0])
    assert got[-1].n_turns == 2 and got[-1].formatted_chars == len(texts[-1, 0])


def test_whole_examples_of_an_empty_table(spark):
    assert chat.read_examples(chat.whole_examples(table(spark, []))).count() == 0


def test_empty_table(spark):
    assert chat.digests(chat.prefix_examples(table(spark, []))).count() == 0
