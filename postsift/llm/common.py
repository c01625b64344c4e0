"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space.  Bytes from 0x80 on belong to
#: characters beyond ASCII, which are word characters.
_FOLD = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

#: A Python worker without a task for so long gives back what it remembers.
IDLE_SECONDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> F.Column:
    """The bytes of a text column; null stays null."""
    return F.encode(F.col(column), "UTF-8")


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, on UTF-8 bytes; null has none."""
    return data.translate(_FOLD).split() if data else []


def _give_back() -> None:
    """Return what a worker freed to the system, where its allocators can; they would keep most of it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _let_go(store: dict) -> None:
    """Drop what a worker keeps, unless a task uses it."""
    with store["lock"]:
        if not store["users"]:
            store["kept"] = (None,)
            _give_back()


@contextmanager
def per_worker(key: str, build: Callable[[], object]) -> Iterator[object]:
    """A value that a Python worker keeps from task to task, as functions are unpickled anew for each.

    A worker keeps one value in all: one with another key, of whatever operator, takes the place of the one before it
    and frees its memory first.  A worker that no task uses for IDLE_SECONDS lets its value go: a stage may end with
    more workers than the next one needs, and what the idle ones remember would stay beside what the others build.
    Callers bound what their value may grow to.
    """
    store = sys.modules.setdefault("_postsift_worker_values", types.ModuleType("_postsift_worker_values")).__dict__
    with store.setdefault("lock", threading.Lock()):
        if "timer" in store:
            store.pop("timer").cancel()
        store["users"] = store.get("users", 0) + 1
        if store.get("kept", (None,))[0] != key:
            store["kept"] = (None,)
            _give_back()
            store["kept"] = (key, build())
        value = store["kept"][1]
    try:
        yield value
    finally:
        with store["lock"]:
            store["users"] -= 1
            timer = store["timer"] = threading.Timer(IDLE_SECONDS, _let_go, (store,))
            timer.daemon = True
            timer.start()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most *rows*, to bound the Python objects alive at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unused(df: DataFrame, name: str) -> str:
    """A column name that *df* does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
