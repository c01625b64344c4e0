"""Keyed upserts and partial updates over snapshots.

Built-in file tables take no MERGE, so each operator returns the next snapshot; the
caller writes it under a new version (see :func:`write_snapshot`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postsift import schema as S


def blank_key_rows(batch: DataFrame, key: str) -> DataFrame:
    """The rows an upsert with blank_key="reject" sets aside."""
    return batch.where(F.coalesce(F.col(key), F.lit("")) == "")


def collapse_batch(batch: DataFrame, key: str, first: Sequence[str], last: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: *first* columns of its first row, *last* columns of its last row."""
    order = F.struct(*order_by)
    aggs = []
    if first:
        aggs.append(F.min_by(F.struct(*first), order).alias("_first"))
    aggs.append(F.max_by(F.struct(*last), order).alias("_last"))
    return batch.groupBy(key).agg(*aggs)


def upsert(
    target: DataFrame, batch: DataFrame, key: str, order_by: Sequence[str], *, insert_only: Sequence[str] = (),
    updated: Sequence[str], defaults: Mapping[str, object] = S.USER_STATE, id_col: str | None = "id",
    blank_key: str = "reject",
) -> DataFrame:
    """Next snapshot of *target*.

    On a key match only *updated* columns change.  A new key takes *insert_only* from its
    first batch row, *updated* from its last, *defaults* (values or columns) for user state
    and a hash of the key as id.  blank_key="collide" lets all empty keys meet on one row.
    """
    if blank_key == "reject":
        batch = batch.where(F.coalesce(F.col(key), F.lit("")) != "")
    elif blank_key == "collide":
        batch = batch.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    else:
        raise ValueError(f"unknown blank_key {blank_key!r}")
    new = collapse_batch(batch, key, insert_only, updated, order_by).withColumn("_in_batch", F.lit(True))
    old = target.withColumn("_in_target", F.lit(True))
    joined = old.alias("t").join(new.alias("b"), F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    is_old, has_new = F.col("_in_target").isNotNull(), F.col("_in_batch").isNotNull()

    def pick(name: str) -> Column:
        current = F.col(f"t.{name}")
        if name == key:
            return F.coalesce(current, F.col(f"b.{key}"))
        if name in updated:
            return F.when(has_new, F.col(f"_last.{name}")).otherwise(current)
        if name == id_col:
            return F.when(is_old, current).otherwise(F.xxhash64(F.col(f"b.{key}")))
        if name in insert_only:
            return F.when(is_old, current).otherwise(F.col(f"_first.{name}"))
        return F.when(is_old, current).otherwise(F.lit(defaults.get(name)))

    return joined.select(*[pick(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def upsert_metadata(target: DataFrame, batch: DataFrame, order_by: Sequence[str], **how) -> DataFrame:
    """Refresh what the feeds report; title, dates and user state stay as first seen."""
    have = set(target.columns) & set(batch.columns)
    return upsert(
        target, batch, "url", order_by, insert_only=[c for c in S.METADATA_INSERT_ONLY if c in have],
        updated=[c for c in S.METADATA_UPDATED if c in have], **how,
    )


def upsert_overwrite(
    target: DataFrame, batch: DataFrame, order_by: Sequence[str], key: str = "url",
    columns: Sequence[str] = S.OVERWRITE_POSTING, as_of: Column | None = None, **how,
) -> DataFrame:
    """Every supplied column comes from the batch; columns it does not supply stay.

    A new row was first seen at *as_of*, by default the time of the run.
    """
    have = set(target.columns) & set(batch.columns)
    defaults = S.USER_STATE | {"scraped_at": F.localtimestamp() if as_of is None else as_of}
    return upsert(target, batch, key, order_by, updated=[c for c in columns if c in have], defaults=defaults, **how)


def upsert_counts(target: DataFrame, batch: DataFrame, key: str = "url") -> DataFrame:
    """One row: rows offered, keys inserted, keys updated."""
    keys = batch.groupBy(key).agg(F.count(F.lit(1)).alias("offered"))
    known = target.select(F.col(key), F.lit(True).alias("known"))
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return keys.join(known, key, "left").agg(
        F.coalesce(F.sum("offered"), F.lit(0)).alias("attempted"),
        F.count_if(F.col("known").isNull() & ~blank).alias("inserted"),
        F.count_if(F.col("known").isNotNull() & ~blank).alias("updated"),
    )


def upsert_feedback(current: DataFrame, rated: DataFrame, keys: Sequence[str] = ("job_id", "source_table")) -> DataFrame:
    """Last rating per key wins; equal times are settled by the liked flag."""
    both = current.select(*keys, "liked", "rated_at").unionByName(rated.select(*keys, "liked", "rated_at"))
    return both.groupBy(*keys).agg(F.max(F.struct("rated_at", "liked")).alias("_r")).select(
        *keys, F.col("_r.liked").alias("liked"), F.col("_r.rated_at").alias("rated_at")
    )


def mark_notified(target: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Set the flag for the ids given; *ids* is a table, of any size."""
    hit = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().withColumn("_hit", F.lit(True))
    out = target.join(hit, id_col, "left")
    return out.withColumn("notified", F.col("notified") | F.col("_hit").isNotNull()).select(*target.columns)


def apply_patches(target: DataFrame, patches: DataFrame, order_by: Sequence[str], id_col: str = "id") -> DataFrame:
    """Partial updates: a column changes only where a patch names it in *supplied*.

    NULL is a value; absence is not.  Later patches win column by column.
    """
    fields = [c for c in patches.columns if c not in {id_col, "supplied", *order_by}]
    order = F.struct(*order_by)
    last = patches.groupBy(id_col).agg(
        *[
            F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("supplied", c), order)).alias(f"_{c}")
            for c in fields
        ]
    )
    out = target.join(last, id_col, "left")
    return out.select(
        *[
            F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in target.columns
        ]
    )


def write_snapshot(df: DataFrame, path: str, version: int, sort_by: str = "score") -> str:
    """Write one version: a folder per role category, best scores first within files.

    Rows of one category are spread over many tasks, so a large category is no hot spot.
    """
    where = f"{path}/v={version}"
    df.sortWithinPartitions("role_category", F.desc(sort_by)).write.mode("overwrite").partitionBy("role_category").parquet(where)
    return where


def write_bucketed(df: DataFrame, table: str, path: str, *, buckets: int, key: str = "url") -> None:
    """Write a snapshot as a table bucketed by its key.

    An upsert into such a table shuffles the batch only; the stored rows are joined where
    they lie.  Choose *buckets* so that one bucket fits a task (a few hundred MB), and not
    below spark.sql.shuffle.partitions: with fewer, Spark shuffles both sides for more tasks.
    """
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
