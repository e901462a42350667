"""Helpers shared by the corpus operators."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Unicode White_Space the way the word-size contract splits words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables; any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")), F.lit(0))


def sample_ids(rows: DataFrame, by: str, per_value: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_value`` ids for each value of ``by``: those with the
    smallest hashes, so the choice does not depend on the layout.  The ranking
    limit is applied before the shuffle as well, so a hot value stays small."""
    rows = rows.where(F.col(by).isNotNull() & F.col(id_col).isNotNull()) \
               .select(id_col, by).withColumn("_slice", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(64)))
    for keys in ([by, "_slice"], [by]):        # in slices first: one task gets at most 64 times the limit
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col)
        rows = rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= per_value).drop("_nth")
    return rows.drop("_slice")


def sample_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The whole texts of a bounded set of ids with the other columns of
    ``ids``; of the rows of a repeated id the one with the least text."""
    kept = [c for c in ids.columns if c != id_col]
    ids = ids.groupBy(id_col).agg(*[F.min(c).alias(c) for c in kept])
    texts = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    return texts.join(F.broadcast(ids), F.col("_id") == F.col(id_col)) \
                .groupBy(id_col, *kept).agg(F.min("_text").alias("text"))


# ------------------------------------------------------------------ memory of Python workers

#: Bytes of an Arrow batch that goes to a Python worker (one row at least).
BATCH_BYTES = 4 << 20
_state: dict = {}


def worker_state(key: str, build: Callable[[], object]):
    """What a worker keeps between tasks (a tokenizer): one object, so that a
    worker reused by another operator drops it."""
    if key not in _state:
        _state.clear()
        release()
        _state[key] = build()
    return _state[key]


def drop_state(but: str) -> None:
    if _state and but not in _state:
        _state.clear()


def release() -> None:
    """Gives freed memory back to the system; reused workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # not in every C library
    if trim:
        trim(0)


def lean_map(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
             state: str = "") -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes as well as rows.  At the
    end of a task freed memory is returned; kept state other than ``state`` is
    dropped when it begins."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_state(but=state)
        try:
            yield from run(batches)
        finally:
            release()
    return rows.mapInArrow(task, schema)


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column without copying rows
    (nulls count as empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at:at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def sum_rows(values: np.ndarray, offsets: np.ndarray, start: int, into: np.ndarray) -> None:
    """Adds per-byte ``values`` of the bytes ``start .. start + len(values)``
    to the rows they belong to."""
    stop = start + len(values)
    first = int(np.searchsorted(offsets, start, "right")) - 1
    last = int(np.searchsorted(offsets, stop, "left"))
    rows = np.arange(first, last)
    cuts = np.maximum(offsets[first:last], start) - start
    full = offsets[first + 1:last + 1] > offsets[first:last]        # reduceat has no empty runs
    if full.any():
        into[rows[full]] += np.add.reduceat(values, cuts[full], axis=0, dtype=into.dtype)
