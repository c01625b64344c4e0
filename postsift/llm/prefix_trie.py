"""Conversation prefix trie, with the totals of all subtrees by parallel tree contraction.

A node is a distinct sequence of first turns.  It is named by its depth and the sum, over its turns, of a digest of each
turn and its place: sums need no order, so a conversation of any length is summed in parts.  Within the results a node
is (least member, depth), which is unique as well.

Contraction takes the tree away in rounds of joins.  Rake: every leaf hands its totals to its parent.  Compress: of a
chain of nodes with one child each, a node that ranks (by a hash of the round) before both neighbours is cut out; its
child takes its place and carries its totals.  A bushy tree goes by rakes, a path by compresses, so the number of rounds
grows with the logarithm of the number of nodes.  Then the rounds are played back: a node cut out has its child's total
and what was carried over it, so every node gets the total of its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postsift.session import Rounds

#: Rebuilt turns of a conversation summed in one task; member ids joined to one text.
CHUNK, IDS = 4096, 10_000
#: Own turns replaced are those before the crc32 of the id, modulo this; at most one less.
HEADS = 9
_LIMBS = tuple(f"s{k}" for k in range(4))


def numbered_turns(turns: DataFrame, rounds: Rounds) -> DataFrame:
    """(conv_id, pos, digest, bytes) of turns in order: by turn, null first, then by digest; pos counts from 1.

    The rows are sorted in ranges of (conversation, turn, digest).  A turn's place is its place in the range and the
    number of the conversation's turns in earlier ranges, so that no conversation has to fit a task.
    """
    key = lambda c: F.md5(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"))
    short = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(key("role"), key("text"))).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")
    )
    ranged = rounds.keep(
        short.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest").withColumn("part", F.spark_partition_id()), "ranged"
    )
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest", "bytes"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"))
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("earlier"))
    return ranged.withColumn("own", own).join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("own") + F.col("earlier")).alias("pos"), "digest", "bytes"
    )


def head_length(conv_id: str = "conv_id") -> Column:
    return (F.crc32(F.col(conv_id).cast("string")) % HEADS).cast("long")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, bytes) of rebuilt conversations, and (conv_id) of all of them, turnless ones too.

    *turns* is (conv_id, pos, digest, bytes).  A conversation c begins with the first h turns of conversation c - c % 5
    and goes on with its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), head_length().alias("h"))
    # conversations with one base are few: five, or nine around zero; each takes HEADS - 1 turns at most
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    convs = convs.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken"))
    heads = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    first = convs.where("taken > 0").join(heads, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "bytes")
    rest = turns.where(F.col("pos") > head_length()).join(convs.select("conv_id", "h", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return first.unionByName(rest), convs.select("conv_id")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes): the names of each prefix and of the one a turn shorter.

    A conversation's sums go on from chunk to chunk, so that a long one is summed in as many tasks as it has chunks.
    """
    place = F.md5(F.concat_ws(",", "depth", "digest"))
    limbs = [F.conv(F.substring(place, 8 * k + 1, 8), 16, 10).cast("long").alias(f"g{k}") for k in range(4)]
    rows = rebuilt.select("conv_id", "depth", "bytes", F.expr(f"(depth - 1) div {CHUNK}").alias("chunk"), *limbs)
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("*", *[F.sum(f"g{k}").over(within).alias(s) for k, s in enumerate(_LIMBS)])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(*[F.sum(f"g{k}").alias(f"c{k}") for k in range(4)])
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(f"c{k}").over(before), F.lit(0)).alias(f"c{k}") for k in range(4)])
    both = sums.join(chunks, ["conv_id", "chunk"])
    name = lambda depth, values: F.unhex(F.md5(F.concat_ws(",", depth, *values)))
    upto = [F.col(s) + F.col(f"c{k}") for k, s in enumerate(_LIMBS)]
    return both.select(
        "conv_id", "depth", name(F.col("depth"), upto).alias("node"),
        name(F.col("depth") - 1, [u - F.col(f"g{k}") for k, u in enumerate(upto)]).alias("parent"), "bytes",
    )


def member_digests(ends: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, ends_sha256): of (node, conv_id) rows, SHA-256 of a node's ids in decimal, ascending, joined by commas.

    The ids are sorted and joined in ranges, so a node that many conversations end at is spread.  The digest itself
    reads a node's texts one after the other; they are streamed, at most one is held.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"]
            )

        for batch in batches:
            for one, conv in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist()):
                if ids and (one != node or len(ids) >= IDS):
                    yield emit()
                    ids = []
                node = one
                ids.append(conv)
        if ids:
            yield emit()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for one, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
                if one == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = one, hashlib.sha256()
                digest.update(ids.encode())
            if len(done) >= IDS:
                yield emit()
        if node is not None:
            done.append((node, digest.hexdigest()))
        if done:
            yield emit()

    sorted_ids = ends.select("node", F.col("conv_id").cast("long")).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = rounds.keep(sorted_ids.mapInArrow(texts, "node binary, first long, ids string"), "member-ids")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str], rounds: Rounds) -> DataFrame:
    """(id..., values...): of each node the sums of *values* over its subtree, itself included.

    *nodes* is (conv_id, depth, p_conv, p_depth, n_children, values...): a node is (conv_id, depth), the root's parent is
    null.  Rounds shrink, so all of them together move a few times as many rows as the tree has nodes.
    """
    ids, up = ["conv_id", "depth"], [f"up_{v}" for v in values]
    name = F.struct(*ids)
    # own and handed-up totals of a node; what its place above it carries; the node whose place it took this round, and
    # what lay between the two
    active = rounds.keep(nodes.select(
        *ids, "p_conv", "p_depth", F.col("n_children").alias("k"), *values, *[F.lit(0).cast("long").alias(u) for u in up],
        *[F.lit(None).cast("long").alias(c) for c in ("v_conv", "v_depth", *(f"v_{v}" for v in values))],
    ), "active-0")
    turn = 0
    while not active.isEmpty():
        leaf = F.col("k") == 0
        # one aggregate: what leaves hand up (hot parents meet it summed by task), and who is left
        kids = active.where("p_depth IS NOT NULL").groupBy(F.col("p_conv").alias("conv_id"), F.col("p_depth").alias("depth")).agg(
            F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, name)).alias("only"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(u)).otherwise(0)).alias(f"got_{v}") for v, u in zip(values, up)],
        )
        rank = lambda node: F.xxhash64(F.lit(turn), *node)
        own, above, below = rank(map(F.col, ids)), rank((F.col("p_conv"), F.col("p_depth"))), rank((F.col("only.conv_id"), F.col("only.depth")))
        rest = rounds.keep(active.where(~leaf).join(kids, ids).select(
            *ids, "p_conv", "p_depth", F.col("left").alias("k"), "only", *[(F.col(v) + F.col(f"got_{v}")).alias(v) for v in values], *up,
            ((F.col("left") == 1) & F.col("p_depth").isNotNull() & (own > above) & (own > below)).alias("cut"),
        ), "rest")
        moved = rest.where("cut").select(
            F.col("only.conv_id").alias("conv_id"), F.col("only.depth").alias("depth"), F.col("conv_id").alias("v_conv"), F.col("depth").alias("v_depth"),
            F.col("p_conv").alias("n_conv"), F.col("p_depth").alias("n_depth"), *[F.col(v).alias(f"v_{v}") for v in values], *[F.col(u).alias(f"n_{u}") for u in up],
        )
        is_new = F.col("v_depth").isNotNull()
        turn += 1
        active = rounds.keep(rest.where("NOT cut").drop("only", "cut").join(moved, ids, "left").select(
            *ids, F.when(is_new, F.col("n_conv")).otherwise(F.col("p_conv")).alias("p_conv"),
            F.when(is_new, F.col("n_depth")).otherwise(F.col("p_depth")).alias("p_depth"), "k", *values,
            *[F.when(is_new, F.col(u) + F.col(f"v_{v}") + F.col(f"n_{u}")).otherwise(F.col(u)).alias(u) for v, u in zip(values, up)],
            "v_conv", "v_depth", *[(F.col(f"v_{v}") + F.col(u)).alias(f"v_{v}") for v, u in zip(values, up)],
        ), f"active-{turn}")
    rounds.drop("rest")
    schema = nodes.select(*ids, *values).schema
    totals = nodes.sparkSession.createDataFrame([], schema)
    for at in range(turn, 0, -1):
        before, after = (nodes.sparkSession.read.schema(active.schema).parquet(rounds.path(f"active-{n}")) for n in (at - 1, at))
        # in a node's place stood, before, the one that was cut out above it
        cut = after.where("v_depth IS NOT NULL").join(totals, ids).select(
            F.col("v_conv").alias("conv_id"), F.col("v_depth").alias("depth"), *[(totals[v] + F.col(f"v_{v}")).alias(v) for v in values]
        )
        raked = before.where("k = 0").select(*ids, *values)
        totals = rounds.keep(totals.unionByName(raked).unionByName(cut), "totals")
        rounds.drop(f"active-{at}")
    return totals


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    *conversations* is (conv_id, turn, role, text); other columns are ignored.  Turns are ordered by turn, null first;
    equal turns by a digest of role and text.  Null roles and texts count as empty.  Rows without a conv_id belong to no
    conversation.  Repeated rows are repeated turns.  The root has every rebuilt conversation, also turnless ones; an
    empty table has no conversation and gives no row.
    """
    rounds = Rounds(conversations.sparkSession, "prefix-trie")
    turns = rounds.keep(numbered_turns(conversations, rounds), "turns")
    rebuilt, convs = rebuild(turns)
    convs = rounds.keep(convs, "conversations")
    rows = rounds.keep(prefixes(rebuilt), "prefixes")
    rounds.drop("ranged", "turns")
    root = F.unhex(F.md5(F.lit("0,0,0,0,0")))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes")
    )
    nodes = rows.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes")
    )
    nodes = rounds.keep(nodes.unionByName(top), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = rounds.keep(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    # children of one node may be very many: all but those of the root are in a join that is split where it is skewed
    parents = counted.where("depth > 0 AND n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("inner_conv"))
    least = counted.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("root_conv"))
    linked = counted.join(parents, "parent", "left").join(F.broadcast(least), "depth", "left").withColumn("p_conv", F.coalesce("inner_conv", "root_conv"))
    linked = rounds.keep(linked.select(
        "node", "conv_id", "depth", "p_conv", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("p_depth"), "n_convs", "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    ), "linked")
    rounds.drop("nodes", "counted")
    values = ["n_leaves", "saved_tokens"]
    totals = subtree_totals(linked.drop("node", "n_convs"), values, rounds)
    # a conversation ends at its longest prefix; one without turns, at the root
    longest = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end"))
    ends = convs.join(longest, "conv_id", "left").select("conv_id", F.coalesce("end.node", root).alias("node"))
    digests = member_digests(ends, rounds)
    return linked.drop(*values).join(totals, ["conv_id", "depth"]).join(digests, "node", "left").select(
        "conv_id", "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
