"""Helpers that several corpus operators share: word splitting, bounded broadcasts, cut lineage, batches."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is sent to every executor only if it has at most so many rows; beyond it, the join is shuffled.
BROADCAST_ROWS = 200_000

#: What separates alphanumeric words: every ASCII character that is no digit and no lower-case letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lowered and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, in order."""
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def gram_hashes(words: str, n: int) -> Column:
    """64-bit hashes of all runs of n words of the array column, by position; empty where there are fewer words."""
    args = ", ".join(f"{words}[i + {k}]" for k in range(n))
    return F.expr(f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({args})) ELSE array() END")


def gram_texts(words: str, n: int) -> Column:
    """All runs of n words joined by a space, by position."""
    return F.expr(f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')) ELSE array() END")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where the session names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trajecta-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without their lineage; Spark removes them when nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Paths of tables made within collected(), if that is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder for a table that the application owns: it is deleted when the driver ends, since a
    lazy result may be read until then, or at the end of collected()."""
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def collected(spark: SparkSession) -> Iterator[None]:
    """Tables that are made meanwhile are deleted at the end: for a step whose result is written before that."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get() or []
        _MADE.reset(token)
        for path in made:
            delete(spark, path)
        swept(spark)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a columnar table of its own, for wide rows of which later steps read a few columns."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has the driver let go of what nothing refers to any more, so that the shuffle files of ended steps are deleted now
    and not whenever its memory happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """stored(), for tables that only what is computed meanwhile reads: they are deleted at the end."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(stored(df))
        swept(df.sparkSession)
        return kept[-1]

    try:
        yield keep
    finally:
        for df in kept:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                delete(df.sparkSession, folder)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at the end of a task, its worker gives free memory back to the system. Workers stay
    for later tasks, so what they keep would add up with the executor's own memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


#: Bytes of rows that a task hands to its Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on, tasks of this session hand rows to their Python workers in batches of about so many bytes (one row at
    least), so that neither side holds many long texts at once. A smaller bound of the session's own stays. The setting
    lasts, since results are computed after the operator returned; it changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < own <= most:
        spark.conf.set(name, str(most))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it was counted and has at most so many rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blocks(batches: Iterator[pa.RecordBatch], text_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text (one row at least), to bound what numpy holds at once."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for k, n in enumerate(lengths):
            if size and size + n > text_bytes:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one row after the other, and where each row begins; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def padded_rows(data: np.ndarray, offsets: np.ndarray, unit: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes followed by `extra` zeros at least, up to a multiple of unit (one unit at least).

    Returns the bytes as rows of `unit`, and how many of those each input row has.
    """
    lengths = np.diff(offsets)
    units = np.maximum(1, -(-(lengths + extra) // unit))
    starts = np.concatenate([[0], np.cumsum(units * unit)])
    out = np.zeros(starts[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] - offsets[:-1], lengths)] = data
    return out.reshape(-1, unit), units


def fold(column: str, k: int) -> Column:
    """crc32 of the id's text, modulo k; null without an id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def held_out(column: str, k: int, remainder: int) -> Column:
    """Whether a row is kept from learning: its fold is the remainder, or it has no id."""
    return F.coalesce(fold(column, k) == remainder, F.lit(True))


def bounded_sample(known: DataFrame, docs: DataFrame, by: str, each: int) -> tuple[DataFrame, dict]:
    """(rows, counts): rows of docs, with the value of `by`, for at most `each` documents of every value, for fitting
    only; and the number of known rows of every value.

    known: (doc_id, by), with few values. Two passes over known, whatever the number of values: one counts, one keeps
    the ids whose hashes lie under a share that lets about twice `each` of a value through, of which the smallest are
    taken. So few ids are ordered or sent to the driver, and only theirs are joined with the texts.
    """
    spark = known.sparkSession
    known = known.where(F.col(by).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", by)
    counts = {r[0]: r[1] for r in known.groupBy(by).count().collect()}
    if not counts:
        return docs.join(known.limit(0), "doc_id"), counts
    scale = 1 << 40
    limits = spark.createDataFrame([(v, min(scale, math.ceil(scale * (2 * each + 50) / n))) for v, n in counts.items()], f"{by} {known.schema[by].dataType.simpleString()}, below long")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    thin = known.withColumn("place", place).join(F.broadcast(limits), by).where(F.col("place") < F.col("below")).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("place", "doc_id"))
    ids = [tuple(r) for r in thin.withColumn("k", rank).where(F.col("k") <= each).select("doc_id", by).collect()]
    picked = spark.createDataFrame(sorted(ids), known.schema)
    return docs.join(F.broadcast(picked), "doc_id"), counts
