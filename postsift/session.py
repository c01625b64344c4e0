"""Session helpers: settings the library relies on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SCAN_TASKS_CONF = "spark.postsift.scanTasks"


def build_session(app: str = "postsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; used by tests and the bench."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a session without the setting (tests, a laptop) gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="postsift-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def new_path(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder name inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, purpose: str = "round") -> DataFrame:
    """Write *df* to the shared folder and read it back."""
    return Rounds(df.sparkSession, purpose).keep(df, "rows")


class Rounds:
    """Stored intermediate tables of an iterative job, in the shared folder.

    The files outlive the executors that wrote them, so a lost executor costs a re-read
    and not a recomputation of all earlier rounds.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self._paths = spark, new_path(spark, purpose), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; the table it replaces is deleted afterwards."""
        old, number = self._paths.get(name, (None, 0))
        path = os.path.join(self.root, f"{name}-{number}")
        df.write.parquet(path)
        self._paths[name] = (path, number + 1)
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        """Where a kept table lies."""
        return self._paths[name][0]

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path, _ = self._paths.pop(name, (None, 0))
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan over the number of tasks that the session names, if it names one.

    For costly per-row work over few, large files that cannot be split.  Without the setting nothing is shuffled.
    """
    tasks = df.sparkSession.conf.get(SCAN_TASKS_CONF, None)
    return df.repartition(int(tasks), key) if tasks else df
