"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table; the shards take turns, and each claims
its most preferred free slot until the table is full.  A key's slot then names its shard in constant time.  Shares
differ by at most one slot, and when a shard joins or leaves, few other slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from postsift.llm.common import unused

#: The table's size; a prime far above the number of shards.  It bounds what is broadcast.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot.  Depends on the names of the shards, not on their order."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime and at least the number of shards")
    names = sorted(shards)
    # a shard prefers offset, offset + skip, offset + 2 skip, ...: all slots once, as their number is prime
    at, skip = [], []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        skip.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1 if slots > 2 else 1)
    owner: list[str | None] = [None] * slots
    free = slots
    while free:
        for k, name in enumerate(names):
            while owner[at[k]] is not None:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = name
            free -= 1
            if not free:
                break
    return owner


def slot_column(key: str, slots: int = SLOTS) -> F.Column:
    """A key's slot: its MD5 digest's first 32 bits modulo the table's size.  A null key counts as empty text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("long")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill_table(shards, slots))), "slot long, shard string")


def place(
    df: DataFrame, shards: Sequence[str], *, key_col: str = "doc_id", slots: int = SLOTS, slot_as: str = "slot", shard_as: str = "shard",
) -> DataFrame:
    """All rows with two more columns, *slot_as* and *shard_as*; older columns of these names are replaced.

    Equal keys go to one shard; a null key goes where empty text goes.  The rows do not move: the broadcast table has
    exactly *slots* rows, whatever the data.  An empty table gives no rows.
    """
    lookup = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias(slot_as), F.col("shard").alias(shard_as))
    rows = df.withColumn(slot_as, slot_column(key_col, slots)).drop(shard_as)
    return rows.join(F.broadcast(lookup), slot_as)


def write_shards(
    df: DataFrame, path: str, shards: Sequence[str], *, key_col: str = "doc_id", slots: int = SLOTS, files: int = 1,
    max_records: int = 1_000_000,
) -> None:
    """Write one folder `shard=name` per shard, of *files* files or more; a column named shard is replaced.

    The rows of a shard are dealt over *files* tasks by a hash of the whole row, so a key with a third of the rows does
    not fill one task, and a rerun task deals the same way.
    """
    slot, part = unused(df, "slot"), unused(df, "part")
    placed = place(df, shards, key_col=key_col, slots=slots, slot_as=slot, shard_as="shard")
    dealt = placed.withColumn(part, F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files)))
    (
        dealt.repartition(len(shards) * files, "shard", part).drop(slot, part)
        .write.option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)
    )
