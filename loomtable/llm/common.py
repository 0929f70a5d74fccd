"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread

#: Bytes of text that a Python worker holds in one piece of a batch.
SLICE_BYTES = 4 << 20


#: Removes a query's shuffle files when it ends; what settle() writes needs them no longer.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a sieve at most (8 MB as a whole), and of one of its parts.
SIEVE_BITS, PART_BITS = 1 << 26, 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset and gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or os.path.join(tempfile.gettempdir(), "loomtable-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written as a table in the shared folder, so that a lost executor costs no recomputation.

    The shuffle files that it took to make them go at once; the table goes with discard().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if was is None else spark.conf.set(CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more; other frames stay as they are."""
    for df in tables:
        path = getattr(df, "_settled", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sifted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows whose key may be among the wanted keys (all that are, and few others), and the rest.

    The sieve is a bitmap of hashed keys, about eight bits a key and SIEVE_BITS at most, whatever the number of keys;
    a fuller one lets more rows pass. It spares the others a shuffle. Nulls are keys like others.
    """
    bits = min(SIEVE_BITS, max(PART_BITS, 1 << (8 * wanted.count()).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    marks = wanted.select(slot(wanted_key).alias("_slot")).groupBy(F.expr(f"_slot div {PART_BITS}").alias("_part")).agg(F.bitmap_construct_agg(F.col("_slot") % PART_BITS).alias("_marks"))
    keyed = df.withColumn("_slot", slot(key)).withColumn("_at", F.expr(f"_slot div {PART_BITS}"))
    marked = keyed.join(F.broadcast(marks), F.col("_at") == F.col("_part"), "left")  # SIEVE_BITS at most
    place = F.expr(f"CAST(_slot % {PART_BITS} AS INT)")
    byte = F.conv(F.hex(F.substring("_marks", F.expr(f"CAST(_slot % {PART_BITS} AS INT) div 8 + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("1").bitwiseAND(F.call_function("shiftright", byte, place % 8)) == 1, F.lit(False))
    extra = ("_slot", "_at", "_part", "_marks")
    return marked.filter(hit).drop(*extra), marked.filter(~hit).drop(*extra)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of a slice have `limit` bytes, or are a single row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)), dtype=np.int64)
        at = 0
        while at < len(col):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def byte_view(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of UTF-8 bytes, and the n + 1 offsets of the texts; null is empty."""
    col = pa.compute.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    col = pa.concat_arrays([col])
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose end a worker that waits for its next task gives freed memory back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_texts(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | dict], *, columns: tuple[str, ...] = ("doc_id", "text"), setup: Callable[[], Callable] | None = None) -> DataFrame:
    """mapInArrow over slices of bounded size. setup() runs once per task and returns the worker function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup else work
        for part in text_slices(batches):
            out = f(part)
            if isinstance(out, dict):
                out = pa.table(out)
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out

    return df.select(*columns).mapInArrow(tidy(run), schema)


def hash_part(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the folds that the contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
