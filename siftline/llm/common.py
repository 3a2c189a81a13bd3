"""Shared helpers: stable scratch tables, bounded lookups, text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.shared import hadoop_path, new_path

#: A table may be broadcast if it has at most so many rows and its files so many bytes.
#: Compressed files alone would not bound what a broadcast takes in memory.
BROADCAST_ROWS, BROADCAST_FILE_BYTES = 200_000, 8 << 20


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Batches of ``rows`` rows go to Python meanwhile; then what the session had holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind. Else they
    stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def scratch_table(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and
    every later use sees the same rows, whatever executors are lost. The table
    goes with ``drop_scratch`` or when the driver ends. ``batch_rows`` bounds
    what Python functions in ``df``, and the JVM beside them, hold at once."""
    path = new_path(df.sparkSession, label)
    with arrow_batches(df.sparkSession, batch_rows), shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for table in tables:
        path, files = hadoop_path(table.sparkSession, table._siftline_path)
        files.delete(path, True)


def scratch_bytes(table: DataFrame) -> int:
    """Size of a scratch table's files."""
    path, files = hadoop_path(table.sparkSession, table._siftline_path)
    return files.getContentSummary(path).getLength()


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS, file_bytes: int = BROADCAST_FILE_BYTES) -> DataFrame:
    """A scratch table, marked for broadcast if it is within both bounds. With
    ``rows=0`` it never is."""
    small = scratch_bytes(table) <= file_bytes and table.count() <= rows
    return F.broadcast(table) if small else table


def crowded_join(rows: DataFrame, table: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with a scratch table that has each ``key`` once and, as
    ``n``, how many rows have it. The table is broadcast if it is small. Else
    only its keys with most rows are, at most ``most``; what meets in a shuffle
    has fewer rows a key than each of those."""
    if table.count() <= most:
        return rows.join(broadcast_if_small(table, most), key).drop("n")
    least, total = 1 << 62, 0
    for digits, count in sorted(table.groupBy(F.length(F.bin("n"))).count().collect(), reverse=True):  # at most 64 rows
        total += count
        if total > most:
            break
        least = 1 << (digits - 1)
    crowded = scratch_table(table.filter(F.col("n") >= least), "crowded")
    some, few = broadcast_if_small(crowded, most), table.filter(F.col("n") < least)
    return rows.join(some, key).unionByName(rows.join(some, key, "left_anti").join(few, key)).drop("n")


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a table, a null text as the empty text. All other
    columns are left behind, so their names cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over a task's batches that gives freed memory back to the
    machine at its end. Python workers outlive tasks, and several wait beside
    those that work, so what each keeps counts."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


class BoundedTable:
    """A lookup table that computes many missing values at once and keeps the
    keys met last, ``2 * limit`` at most. Forgetting changes only speed."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.new: dict = {}
        self.old: dict = {}

    def look_up(self, lists: list[list]) -> list[list]:
        """The values of each list of keys. No value may be None."""
        found = [list(map(self.new.get, keys)) for keys in lists]
        gaps = [(got, keys) for got, keys in zip(found, lists) if None in got]
        if gaps:
            missed = dict.fromkeys(k for got, keys in gaps for k, v in zip(keys, got) if v is None)
            fresh = dict(zip(missed, map(self.old.get, missed)))
            unknown = [k for k, v in fresh.items() if v is None]
            fresh.update(zip(unknown, self.compute(unknown), strict=True))
            for got, keys in gaps:
                got[:] = [fresh[k] if v is None else v for k, v in zip(keys, got)]
            if len(self.new) + len(fresh) > self.limit:
                self.old, self.new = self.new, {}
            self.new.update(fresh)
        return found


def batches_of(items: Iterable, n: int) -> Iterator[list]:
    """Lists of at most ``n`` items."""
    items = iter(items)
    while held := list(islice(items, n)):
        yield held
