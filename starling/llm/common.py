"""Shared plumbing: where intermediate tables go, Arrow batches, bounded bit sets."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import new_path

#: Rows a Python worker gets at once; with long texts a batch also stays under BATCH_BYTES where Spark has that limit.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, "starling")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give memory that is no longer used back to the system: workers live on and other stages share the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with bounded batches; fn takes and yields record batches."""
    small_batches(df.sparkSession)

    def mapped(batches):
        yield from fn(batches)
        release()

    return df.mapInArrow(mapped, schema)


def tidy(spark: SparkSession) -> None:
    """Let the driver forget plans that are no longer used, so that executors delete their shuffle files."""
    gc.collect()
    if jvm := getattr(spark.sparkContext, "_jvm", None):
        jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
    return x


#: Bits of a membership filter: 2^BITS / 8 bytes (2 MB), whatever the size of the corpus. Members never miss; others may pass.
BITS = 24


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bit array (uint64 words) of a column of evenly hashed longs; a grouped OR, so at most 2^(BITS-6) rows reach the driver."""
    words = keys.select(F.shiftrightunsigned(F.col(column), 64 - BITS).alias("s")).selectExpr("shiftrightunsigned(s, 6) AS w", "shiftleft(1L, CAST(s & 63 AS INT)) AS b")
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[row.w] = row.b & 0xFFFFFFFFFFFFFFFF
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the filter."""
    slot = keys >> np.uint64(64 - BITS)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


#: A key is heavy if it has more than this share of the rows, so at most its inverse are.
HEAVY = 1 / 1000


def heavy_keys(left: DataFrame, key: str) -> DataFrame:
    """The keys with more than HEAVY of the rows, at most 1 / HEAVY of them; counted where the rows are."""
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    least = max(1, int((left.count()) * HEAVY))
    return materialize(counts.where(F.col("n") > least).select(key))


def join_hot(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None = None) -> DataFrame:
    """left joined to right (unique, not null by key) on the key, inner: rows of heavy keys meet a broadcast of at most 1 / HEAVY rows, the others are shuffled."""
    heavy = F.broadcast(heavy_keys(left, key) if heavy is None else heavy)
    some = materialize(right.join(heavy, key, "left_semi"))
    rest = left.join(heavy, key, "left_anti").join(right.join(heavy, key, "left_anti"), key)
    return left.join(F.broadcast(some), key).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def before_each(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with, for each of `sums`, its sum over the rows before in this order (0 for the first row).

    Rows are dealt into ranges; only a row for each range meets the others.
    """
    part = fresh(df, "part")
    own = materialize(df.select("*", *(c.cast("long").alias(n) for n, c in sums.items())).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    ranges, inside = Window.orderBy(part), Window.partitionBy(part).orderBy(*order)
    totals = own.groupBy(part).agg(*(F.sum(n).alias(n) for n in sums)).select(part, *((F.sum(n).over(ranges) - F.col(n)).alias(f"_{n}") for n in sums))
    within = own.select("*", *((F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)).alias(f"__{n}") for n in sums))
    out = within.join(F.broadcast(totals), part)
    return out.select(*df.columns, *((F.col(f"_{n}") + F.col(f"__{n}")).alias(n) for n in sums))
