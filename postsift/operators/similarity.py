"""Similarity deduplication: a row is dropped when an earlier kept row is near to it.

The rule is sequential (rows in order, each compared with the rows kept so far).
Neither form below compares all pairs:

* ``exact`` reads the undecided rows in chunks of *chunk* rows.  The head of the
  order is settled in one bounded task, then every remaining row is compared, where
  it lies, with the few new leaders.  Cost: rows x leaders, no shuffle of the rows.
* ``lsh`` gives rows block keys from random planes and settles all blocks at once.
  In each round a row may become a leader when it is among the first *prefix*
  undecided rows in all its blocks and no earlier one of those is near.  Rows then
  meet only the new leaders of their blocks, in chunks of bounded size, so a block
  that holds a third of the data costs rows x leaders and not rows squared.  Within the blocks the result is
  that of the sequential rule; *recall* sets how many blocks a row gets.  Most rows that meet in a block do so by
  chance: a block keeps the rows whose sketches (signs by more planes) allow a near row in it, before any vector moves.

Rows with equal vectors always share their fate, so they are collapsed first.
Vectors that are missing or without length match nothing and are kept.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from postsift.config import SIMILARITY
from postsift.functions.vector import bands_for, has_length, most_signs_apart, planes, unit_rows
from postsift.session import Rounds, cut_lineage, new_path

#: Planes per block key.  Unrelated rows (at a right angle) share a block with chance 2 ** -BITS.
BITS = 16
#: Planes of a row's sketch, 64 to a word, and the chance that it hides a near pair, as a part of the chance that blocks do.
SKETCH, SKETCH_MISS = 256, 1e-3
#: Rows whose block keys are computed at once.
KEYED = 1024


def _vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vec"))


def _checked(stored: DataFrame, id_col: str) -> DataFrame:
    """The rows (id, vec) that can match, out of stored ones."""
    if not stored.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"{id_col} is not unique")
    return stored.where(F.col("id").isNotNull() & has_length("vec"))


def _same(vec: str) -> list:
    """Keys under which equal vectors meet, so that the vectors themselves need not move: two hashes of the numbers
    (0.0 and -0.0 hash alike, as do all NaN) and one of the places of NULLs, which the other two pass over."""
    places = F.transform(vec, lambda x: x.isNull())
    return [F.xxhash64(vec).alias("_h1"), F.xxhash64(F.lit(1), vec).alias("_h2"), F.xxhash64(places).alias("_h3")]


def _copies(rows: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, head): rows with the vector of an earlier row, and the first one that has it."""
    keyed = rounds.keep(rows.select("id", *_same("vec")), "same")
    keys = ["_h1", "_h2", "_h3"]
    heads = keyed.groupBy(*keys).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # one head per vector; a vector that many rows share is split by the adaptive skew join
    copies = rounds.keep(keyed.join(heads, keys).where(F.col("id") != F.col("head")).select("id", "head"), "copies")
    rounds.drop("same")
    return copies


def _leaders_of(
    rows: DataFrame, tau: float = SIMILARITY, blocking: str = "lsh", chunk: int = 2048, recall: float = 0.999,
    bits: int = BITS, prefix: int = 1024, seed: int = 7,
) -> DataFrame:
    """(id, leader) of the rows that have a leader; *rows* have distinct vectors."""
    if not 0.0 < tau < 1.0:
        raise ValueError("tau has to lie between 0 and 1")
    if blocking == "exact":
        fate = _scan_leaders(cut_lineage(rows, "distinct"), tau, chunk)
    elif blocking == "lsh":
        fate = _block_leaders(rows, tau, recall, bits, prefix, 4 * chunk, seed)
    else:
        raise ValueError(f"unknown blocking {blocking!r}")
    return fate.where(F.col("leader").isNotNull())


def _links(rows: DataFrame, **how) -> DataFrame:
    """(id, kept_id) of the stored *rows* (id, vec): each copy goes where the first row with its vector goes."""
    copies = _copies(rows, Rounds(rows.sparkSession, "copies"))
    fate = _leaders_of(rows.join(copies, "id", "left_anti"), **how)
    copied = copies.join(fate.withColumnsRenamed({"id": "head"}), "head", "left")
    return fate.select("id", F.col("leader").alias("kept_id")).unionByName(copied.select("id", F.coalesce("leader", "head").alias("kept_id")))


# -- exact --------------------------------------------------------------------
def _settle_head(tau: float):
    def run(batches):
        parts = [batch for batch in batches if not batch.empty]  # at most one chunk of rows in all
        if not parts:
            return
        head = pd.concat(parts, ignore_index=True)
        head = head.sort_values("id", ignore_index=True)
        near = unit_rows(head["vec"])
        near = near @ near.T >= tau
        leader = np.full(len(head), -1)
        kept: list[int] = []
        for i in range(len(head)):
            hits = near[i, kept] if kept else np.zeros(0, bool)
            if hits.any():
                leader[i] = kept[int(hits.argmax())]
            else:
                kept.append(i)
        ids = head["id"].to_numpy()
        head["leader"] = pd.array([None if k < 0 else ids[k] for k in leader], dtype="Int64")
        yield head[["id", "vec", "leader"]]

    return run


def _match_head(ids: np.ndarray, matrix: np.ndarray, tau: float):
    def run(batches):
        for batch in batches:
            if batch.empty:
                continue
            near = unit_rows(batch["vec"]) @ matrix.T >= tau
            leader = pd.Series(ids[near.argmax(axis=1)], dtype="Int64", index=batch.index)
            batch["leader"] = leader.where(near.any(axis=1))
            yield batch[["id", "vec", "leader"]]

    return run


def _scan_leaders(rows: DataFrame, tau: float, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    schema = "id BIGINT, vec " + dict(rows.dtypes)["vec"] + ", leader BIGINT"
    done, rounds = new_path(spark, "leaders"), Rounds(spark, "scan")
    rest = rows
    while True:
        head = rounds.keep(rest.orderBy("id").limit(chunk).mapInPandas(_settle_head(tau), schema), "head")
        last = head.agg(F.max("id")).first()[0]
        if last is None:
            break
        head.select("id", "leader").write.mode("append").parquet(done)
        # at most *chunk* vectors travel with the closure
        new = head.where(F.col("leader").isNull()).orderBy("id").select("id", "vec").toPandas()
        probe = _match_head(new["id"].to_numpy(), unit_rows(new["vec"]), tau)
        probed = rounds.keep(rest.where(F.col("id") > last).mapInPandas(probe, schema), "probed")
        probed.where(F.col("leader").isNotNull()).select("id", "leader").write.mode("append").parquet(done)
        rest = probed.where(F.col("leader").isNull()).select("id", "vec")
    rounds.drop("head", "probed")
    if rows.isEmpty():
        return rows.select("id", F.lit(None).cast("bigint").alias("leader"))
    return spark.read.schema("id BIGINT, leader BIGINT").parquet(done)


# -- blocks -------------------------------------------------------------------
def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as rows of length one."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy())
    if len(set(np.diff(ends, prepend=0))) != 1:
        raise ValueError("vectors differ in length")
    return unit_rows(flat.astype(np.float64).reshape(len(vectors), -1))


def _block_keys(bands: int, bits: int, seed: int, sketches: bool):
    """(block, id) of each row and band, with the row's sketch.  A block is the number of its band and the signs by its planes."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, KEYED):
                batch = whole.slice(at, KEYED)
                matrix = _matrix(batch["vec"])
                dim, n = matrix.shape[1], len(matrix)
                if dim not in drawn:
                    drawn[dim] = planes(dim, bands * bits, seed), planes(dim, SKETCH, seed + 1)
                side = (matrix @ drawn[dim][0] > 0).reshape(n, bands, bits)
                block = side @ weights + (np.arange(bands, dtype=np.int64) << bits)
                cells = [pa.array(block.reshape(-1)), pa.array(np.repeat(batch["id"].to_numpy(), bands))]
                if sketches:
                    sketch = np.packbits(matrix @ drawn[dim][1] > 0, axis=1).view(np.int64)
                    flat = pa.array(np.repeat(sketch, bands, axis=0).reshape(-1))
                    cells.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sketch.shape[1], dtype=np.int32)), flat))
                yield pa.RecordBatch.from_arrays(cells, names=["block", "id", "sketch"][:len(cells)])

    return run


def _in_company(apart: int):
    """(block, id) of the rows that differ from another one of their block in at most *apart* signs of their sketches.

    Batches are ordered by block; a task holds one batch and the block at its end.
    """

    def near(block: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        found, at, lag = np.zeros(len(block), bool), np.arange(len(block)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(block)]
            at = at[block[at] == block[at + lag]]
            hit = at[np.bitwise_count(sketch[at] ^ sketch[at + lag]).sum(axis=1) <= apart]
            found[hit] = found[hit + lag] = True
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sketch = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SKETCH // 64), np.uint64)

        def emit(end: int) -> pa.RecordBatch:
            some = near(block[:end], sketch[:end])
            return pa.RecordBatch.from_arrays([pa.array(block[:end][some]), pa.array(ids[:end][some])], names=["block", "id"])

        for batch in batches:
            block = np.concatenate([block, batch["block"].to_numpy()])
            ids = np.concatenate([ids, batch["id"].to_numpy()])
            sketch = np.concatenate([sketch, batch["sketch"].flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)])
            end = int(np.searchsorted(block, block[-1])) if len(block) else 0
            yield emit(end)
            block, ids, sketch = block[end:], ids[end:], sketch[end:]
        yield emit(len(block))

    return run


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values in sorted arrays."""
    edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *edges], [*edges, len(keys[0])]))


def _waiting(tau: float):
    """Rows that have an earlier near row in the front of one of their blocks.

    One call handles a pack of several blocks: a call per block would cost more than
    its arithmetic.
    """

    def run(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(["block", "id"], ignore_index=True)
        matrix, waits = unit_rows(pack["vec"]), np.zeros(len(pack), bool)
        for start, end in _runs(pack["block"].to_numpy()):
            part = matrix[start:end]
            waits[start:end] = np.tril(part @ part.T >= tau, k=-1).any(axis=1)
        return pack.loc[waits & pack["covered"].to_numpy(), ["id"]]

    return run


def _meet(tau: float):
    """The first new leader that each row is near to, over a pack of block chunks."""

    def run(rows: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        ids, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(rows) and len(lead):
            rows = rows.sort_values(["block", "chunk"], ignore_index=True)
            lead = lead.sort_values(["l_block", "l_chunk", "l_id"], ignore_index=True)
            left, right = unit_rows(rows["vec"]), unit_rows(lead["l_vec"])
            lead_ids, before = lead["l_id"].to_numpy(), rows["before"].to_numpy()
            block, chunk = rows["block"].to_numpy(), rows["chunk"].to_numpy()
            l_block, l_chunk = lead["l_block"].to_numpy(), lead["l_chunk"].to_numpy()
            where = {(l_block[a], l_chunk[a]): (a, b) for a, b in _runs(l_block, l_chunk)}
            for start, end in _runs(block, chunk):
                at = where.get((block[start], chunk[start]))
                if at is None:
                    continue
                heads = lead_ids[at[0]:at[1]]
                near = (left[start:end] @ right[at[0]:at[1]].T >= tau) & (heads[None, :] < before[start:end, None])
                hit = near.any(axis=1)
                ids.append(rows["id"].to_numpy()[start:end][hit])
                found.append(heads[near.argmax(axis=1)[hit]])
        return pd.DataFrame({"id": np.concatenate(ids), "found": np.concatenate(found)})

    return run


def _pack(packs: int, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(packs))


def _blocks(rows: DataFrame, tau: float, recall: float, bits: int, seed: int, chunk: int, rounds: Rounds) -> DataFrame:
    """(block, id, chunk, chunks) for all blocks of two rows or more that may be near to another one.

    A block with more than *chunk* rows is spread over several chunks, so no task ever
    holds more of it than that; such blocks keep all their rows.
    """
    apart = most_signs_apart(tau, SKETCH, SKETCH_MISS * (1 - recall))
    told = apart < SKETCH // 2  # else unrelated rows look near as well
    keys = _block_keys(bands_for(tau, bits, recall), bits, seed, told)
    keyed = rounds.keep(rows.select("id", "vec").mapInArrow(keys, "block BIGINT, id BIGINT" + ", sketch ARRAY<BIGINT>" * told), "keys")
    if told:
        hot = keyed.groupBy("block").count().where(F.col("count") > chunk).select("block")
        cold = keyed.join(hot, "block", "left_anti").select("block", "id", "sketch")
        some = cold.repartition("block").sortWithinPartitions("block").mapInArrow(_in_company(apart), "block BIGINT, id BIGINT")
        keyed = rounds.keep(some.unionByName(keyed.join(hot, "block", "left_semi").select("block", "id")), "company")
    sizes = keyed.groupBy("block").count().where("count > 1")
    sizes = sizes.select("block", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    sized = keyed.join(sizes, "block")
    blocks = rounds.keep(sized.select("block", "id", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "chunks"), "blocks")
    rounds.drop("keys", "company")
    return blocks


def _block_leaders(
    rows: DataFrame, tau: float, recall: float, bits: int, prefix: int, chunk: int, seed: int
) -> DataFrame:
    """(id, leader) of the rows that meet others in their blocks; all other rows are kept."""
    rounds = Rounds(rows.sparkSession, "blocks")
    blocks = _blocks(rows, tau, recall, bits, seed, chunk, rounds)
    packs = max(1, blocks.count() // chunk)
    needed = rounds.keep(blocks.groupBy("id").agg(F.count(F.lit(1)).alias("needed")), "needed")
    # the rounds read the vectors of these rows only
    rows = rounds.keep(rows.join(needed.select("id"), "id", "left_semi"), "rows")
    state = rounds.keep(needed.select("id", F.lit(None).cast("bigint").alias("leader"), F.lit(False).alias("kept")), "state")
    left = None
    order = Window.partitionBy("block").orderBy("id")
    while True:
        open_rows = state.where(F.col("leader").isNull() & ~F.col("kept")).select("id")
        before, left = left, open_rows.count()
        if not left:
            break
        if left == before:
            raise RuntimeError("a round settled no row")
        # the first undecided rows of every block; the limit runs before the shuffle
        front = blocks.select("block", "id").join(open_rows, "id", "left_semi")
        front = rounds.keep(front.withColumn("place", F.row_number().over(order)).where(F.col("place") <= prefix).drop("place"), "front")
        covered = front.groupBy("id").count().join(needed, "id").where(F.col("count") == F.col("needed")).select("id")
        ahead = front.join(covered.withColumn("covered", F.lit(True)), "id", "left").join(rows, "id")
        ahead = ahead.select("block", "id", "vec", F.coalesce("covered", F.lit(False)).alias("covered"))
        waits = ahead.groupBy(_pack(packs, "block")).applyInPandas(_waiting(tau), "id BIGINT").distinct()
        leaders = rounds.keep(covered.join(waits, "id", "left_anti"), "new")
        # every row meets the new leaders of its blocks; the earliest near one wins
        lead = blocks.join(leaders, "id", "left_semi")
        spread = lead.select("block", "id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(rows, "id")
        # new names for the same columns: both sides of the cogroup come from one table
        spread = spread.toDF(*[f"l_{c}" for c in spread.columns])
        others = state.where(~F.col("kept")).join(leaders, "id", "left_anti")
        others = others.select("id", F.least("id", "leader").alias("before"))
        met = blocks.select("block", "id", "chunk").join(lead.select("block").distinct(), "block", "left_semi")
        met = met.join(others, "id").join(rows, "id").select("block", "chunk", "id", "before", "vec")
        found = (
            met.groupBy(_pack(packs, "block", "chunk")).cogroup(spread.groupBy(_pack(packs, "l_block", "l_chunk")))
            .applyInPandas(_meet(tau), "id BIGINT, found BIGINT").groupBy("id").agg(F.min("found").alias("found"))
        )
        state = rounds.keep(
            state.join(found, "id", "left").join(leaders.select("id", F.lit(True).alias("new")), "id", "left").select(
                "id", F.least("leader", "found").alias("leader"), (F.col("kept") | F.col("new").isNotNull()).alias("kept")
            ),
            "state",
        )
    rounds.drop("blocks", "needed", "rows", "front", "new")
    return state.select("id", "leader")


# -- results ------------------------------------------------------------------
def similar_pairs(df: DataFrame, id_col: str, vector: str, tau: float = SIMILARITY, **how) -> DataFrame:
    """(id, kept_id): every row that is near to a row kept before it, with the first such row.

    *id_col* is a BIGINT that is unique and gives the order.  Options in *how*: blocking
    "lsh" or "exact"; chunk, the rows one task compares at a time; and for blocks recall
    (the chance that a pair at *tau* meets), bits per key, prefix and seed.  None of them depends
    on the number of rows, so adding unrelated rows changes no link.

    Copies of one vector yield one row each, never all their pairs.
    """
    # stored, because a vector column is often the result of costly functions and is read several times
    return _links(_checked(cut_lineage(_vectors(df, id_col, vector), "vectors"), id_col), tau=tau, **how)


def dedup_semantic(
    df: DataFrame, id_col: str, vector: str, tau: float = SIMILARITY, *, salary: str = "salary",
    **how,
) -> DataFrame:
    """The kept rows.  A kept row without salary takes the known values of the first
    row it absorbed that has one.  Ids have to be unique; repeated ones are an error.
    """
    df = cut_lineage(df, "similar")  # read several times below
    names = [c for c in df.columns if c != id_col]
    links = _links(_checked(_vectors(df, id_col, vector), id_col), tau=tau, **how)
    paid = df.where(F.col(salary).isNotNull()).select(F.col(id_col).alias("id"))
    donors = links.join(paid, "id").groupBy("kept_id").agg(F.min("id").alias("_donor"))
    kept = (
        df.join(links.select(F.col("id").alias(id_col)), id_col, "left_anti")
        .join(donors.withColumnRenamed("kept_id", id_col), id_col, "left")
        .withColumn("_donor", F.when(F.col(salary).isNull(), F.col("_donor")))
    )
    given = df.select(F.col(id_col).alias("_donor"), F.struct(*names).alias("_given"))
    given = given.join(kept.where(F.col("_donor").isNotNull()).select("_donor"), "_donor", "left_semi")
    return kept.join(given, "_donor", "left").select(
        id_col, *[F.coalesce(F.col(f"_given.{c}"), F.col(c)).alias(c) for c in names]
    )
