"""Incremental runs over newly landed files, and stateful stream operators.

Every stream runs with availableNow: it handles what has landed since the last run and
stops.  Its checkpoint folder records what was read, so a second run adds nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postsift import config as C
from postsift.functions.parse import to_clock, to_instant
from postsift.operators.upsert import upsert_metadata

LATE = "48 hours"  # fixed value: age above which a row counts as late
RUN_EVERY = "6 hours"  # fixed value: one bucket per scheduled run


def read_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def run_available(df: DataFrame, checkpoint: str, *, sink: str | None = None, batch: Callable | None = None, mode: str = "append") -> StreamingQuery:
    """Process what is there, to a parquet folder or through a batch function, and wait."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch is not None else writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()
    return query


# -- committed versions -------------------------------------------------------
def _folder(root: str, kind: str, version: int) -> str:
    return os.path.join(root, kind, f"v={version:020d}")


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in (found or [])]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all its text at once; False if there is one of that name.

    The text is written beside it first.  Hadoop's rename without overwriting takes one of many writers; local files,
    where that is no single step, are linked.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = os.path.join(os.path.dirname(os.path.dirname(path)), "staged", uuid.uuid4().hex)
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    out = files.create(staged, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            os.link(staged.toUri().getPath(), target.toUri().getPath())
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, how)
    except FileExistsError:
        return False
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    finally:
        files.delete(staged, False)
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.rpartition("=")[2]) for n in _glob(spark, os.path.join(root, "commits", "v=*")))


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The last committed version; a write without its record does not count."""
    return max(_versions(spark, root), default=None)


@dataclass
class Commit:
    """What a version consists of: the last batch of every stream, and the data folder of each bucket."""

    version: int
    streams: dict[str, int]
    buckets: dict[str, int]


def _record(spark: SparkSession, root: str, version: int) -> Commit | None:
    """The record of a version; None if it has been dropped meanwhile."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(root, "commits", version))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Commit(**json.loads(text))


def last_commit(spark: SparkSession, root: str) -> Commit:
    while True:
        version = latest_version(spark, root)
        if version is None:
            return Commit(0, {}, {})
        if found := _record(spark, root, version):
            return found


def _commit(spark: SparkSession, root: str, done: Commit, keep: int) -> bool:
    """Record a version, unless another writer did; then drop records beyond the last *keep*, and data they left.

    Data that no record names may be a writer's at work.  Its number is larger than the version that the writer began
    from, so what is numbered up to the oldest record to keep belongs to nobody, or to a writer that has to start again.
    """
    if not _put_if_absent(spark, _folder(root, "commits", done.version), json.dumps(vars(done))):
        return False
    versions = _versions(spark, root)
    if done.version not in versions[-keep:]:
        return True
    for version in versions[:-keep]:
        _delete(spark, _folder(root, "commits", version))
    needed = {(v, int(b)) for n in versions[-keep:] if (rec := _record(spark, root, n)) for b, v in rec.buckets.items()}
    oldest = done.version - keep + 1
    for path in _glob(spark, os.path.join(root, "data", "v=*", f"{BUCKET}=*")):
        number, bucket = (int(part.partition("=")[2]) for part in path.split("/")[-2:])
        if number <= oldest and (number, bucket) not in needed:
            _delete(spark, path)
    for path in _glob(spark, os.path.join(root, "claims", "v=*")):
        if int(path.rpartition("=")[2]) <= oldest:
            _delete(spark, path)
    return True


def _claim(spark: SparkSession, root: str, after: int) -> int:
    """A number larger than *after* for a data folder that no other writer has or gets."""
    number = after + 1
    while _glob(spark, _folder(root, "data", number)) or not _put_if_absent(spark, _folder(root, "claims", number), ""):
        number += 1
    return number


# -- snapshots ----------------------------------------------------------------
BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _read_buckets(spark: SparkSession, root: str, schema: StructType, where: dict[str, int]) -> DataFrame:
    if not where:
        return spark.createDataFrame([], schema)
    paths = [os.path.join(_folder(root, "data", v), f"{BUCKET}={b}") for b, v in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths)


def read_snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The last committed snapshot."""
    return _read_buckets(spark, root, schema, last_commit(spark, root).buckets)


def write_upsert(
    batch: DataFrame, root: str, schema: StructType, order_by: Sequence[str], *, buckets: int, stream: str, batch_id: int,
    key: str = "url", keep: int = 3, upsert: Callable[..., DataFrame] = upsert_metadata,
) -> bool:
    """Upsert a batch into a stored snapshot; False if this batch of this stream is in it already.

    Rows lie in *buckets* by a hash of their key.  Only the buckets that the batch touches are read and written, into a
    data folder of a number of its own; the commit record names, for every bucket, the folder that holds it.  Nothing
    counts before its record is written, so a batch that failed midway is done again from the last committed version.
    Choose *buckets* so that one fits a few tasks, and keep it: a snapshot cannot change it.

    Several writers may share a root.  The record of a version is created by one of them.  Another one goes on: what it
    wrote stands, under the next version, if nobody else wrote its buckets; if somebody did, or if *keep* versions have
    gone by, it starts again from the last version.  All writers of a root use the same *keep*.
    """
    spark = batch.sparkSession
    if last_commit(spark, root).streams.get(stream, -1) >= batch_id:
        return False
    batch = batch.where(F.coalesce(F.col(key), F.lit("")) != "").persist()
    touched = [str(r[0]) for r in batch.select(bucket_of(key, buckets)).distinct().collect()]  # at most *buckets* rows
    try:
        while True:
            base = last = last_commit(spark, root)
            number = 0
            if touched:
                number = _claim(spark, root, base.version)
                try:
                    target = _read_buckets(spark, root, schema, {b: v for b, v in base.buckets.items() if b in touched})
                    rows = upsert(target, batch, order_by).withColumn(BUCKET, bucket_of(key, buckets))
                    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(_folder(root, "data", number))
                except (Py4JJavaError, PySparkException):
                    if _outdated(base, last_commit(spark, root), touched, keep):  # what it read from has been deleted
                        _delete(spark, _folder(root, "data", number))
                        continue
                    raise
            while last.streams.get(stream, -1) < batch_id and not _outdated(base, last, touched, keep):
                done = Commit(last.version + 1, last.streams | {stream: batch_id}, last.buckets | dict.fromkeys(touched, number))
                recorded = _commit(spark, root, done, keep)
                last = last_commit(spark, root)
                # a record that was put where one had been dropped long ago is no part of the last version
                if recorded and last.streams.get(stream, -1) >= batch_id:
                    return True
                if recorded:
                    _delete(spark, _folder(root, "commits", done.version))
            if touched:
                _delete(spark, _folder(root, "data", number))
            if last.streams.get(stream, -1) >= batch_id:
                return False
    finally:
        batch.unpersist()


def _outdated(base: Commit, last: Commit, touched: Sequence[str], keep: int) -> bool:
    """True if what was written from *base* cannot follow *last*."""
    return last.version - base.version >= keep or any(last.buckets.get(b) != base.buckets.get(b) for b in touched)


def upsert_batches(
    root: str, schema: StructType, order_by: Sequence[str], *, stream: str, buckets: int, keep: int = 3
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over `write_upsert`.

    *stream* names the stream by its checkpoint folder: batch numbers count within it, and a new checkpoint over an old
    root goes on from what is stored.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_upsert(batch, root, schema, order_by, buckets=buckets, stream=stream, batch_id=batch_id, keep=keep)

    return apply


def alert_once_batches(
    root: str, sink: str, *, stream: str, key: str = "url", at_least: int = C.ALERT_SCORE, keep: int = 3
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that emits each key once over all runs.

    The keys sent are a folder per committed version; a batch whose record is missing is sent again into the same
    folders.  *stream* is the checkpoint folder, as in `upsert_batches`.  One writer at a time.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = last_commit(spark, root)
        if last.streams.get(stream, -1) >= batch_id:
            return
        # one row per key before the join: a key that fills the batch costs it one row
        best = batch.where(F.col("score") >= at_least).groupBy(key).agg(F.max("score").alias("score"))
        if last.version:
            sent = spark.read.parquet(os.path.join(root, "sent")).where(F.col("v").cast("bigint") <= last.version)
            best = best.join(sent.select(key), key, "left_anti")
        version = last.version + 1
        out = os.path.join(sink, f"v={version:020d}")
        best.write.mode("overwrite").parquet(out)
        spark.read.schema(best.schema).parquet(out).select(key).write.mode("overwrite").parquet(_folder(root, "sent", version))
        if not _commit(spark, root, Commit(version, last.streams | {stream: batch_id}, {}), keep):
            raise RuntimeError(f"another writer recorded version {version} in {root}: alerts have one writer")

    return apply


# -- stateful operators -------------------------------------------------------
def dedup_stream(df: DataFrame, key: str, time: str, late: str = LATE, salts: int = 16) -> DataFrame:
    """First arrival per key; state older than the watermark is dropped.

    Stream dedup has no map-side step, so one hot key would fill one task.  A first pass
    per key and salt spreads it, and leaves at most one row per salt to the second pass.
    """
    names = df.columns
    salted = _timed(df, time, late).withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([key, "_salt"]).dropDuplicatesWithinWatermark([key]).select(*names)


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """Add *_at*, the event time with its watermark; a watermark needs a TIMESTAMP."""
    at = to_instant(time) if dict(df.dtypes)[time] == "timestamp_ntz" else F.col(time)
    return df.withColumn("_at", at).withWatermark("_at", late)


def counts_per_run(df: DataFrame, time: str, source: str, every: str = RUN_EVERY, late: str | None = None) -> DataFrame:
    """Rows per source and run bucket, as UTC clock readings: of a table, or with *late* of a stream."""
    clock = dict(df.dtypes)[time] == "timestamp_ntz"
    df = df.withColumn("_at", F.col(time) if clock else to_clock(time)) if late is None else _timed(df, time, late)
    start, end = F.col("w.start"), F.col("w.end")
    if late is not None:
        start, end = to_clock(start), to_clock(end)
    return (
        df.groupBy(F.window("_at", every).alias("w"), F.col(source).alias("source"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(start.alias("run_start"), end.alias("run_end"), "source", "rows")
    )
