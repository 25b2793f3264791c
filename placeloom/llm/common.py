"""Shared plumbing: tables, sizes of buckets, and the library's shared folder, staged tables and components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import components, discard, shared_dir, staged
from .arrays import mix, release

__all__ = ["BATCH_BYTES", "TASK_BYTES", "asked", "components", "discard", "give_back", "n_buckets", "shared_dir", "small_batches", "staged", "table"]

#: Bytes of text that one Python task is meant to hold.
TASK_BYTES = 16 << 20
#: Bytes of one Arrow batch between an executor's JVM and Python.
BATCH_BYTES = 4 << 20
#: Bits of one slice of a Bloom filter, bits a key, and slices at most (64 MB; beyond, more rows pass that nobody asked for).
SLICE, KEY_BITS, MOST_SLICES = 1 << 15, 12, 1 << 14
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_buckets(df: DataFrame, size: str, most: int = TASK_BYTES) -> int:
    """Buckets of about ``most`` bytes each, and no fewer than the session's shuffle partitions."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``: both the executor's JVM and its Python workers hold whole batches."""
    now = spark.conf.get(_BATCH)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back(spark: SparkSession) -> None:
    """Lets the driver drop what it no longer refers to; executors then delete the shuffle files of staged results."""
    spark.sql("select 1").collect()  # the bus refers to the last plan it told of; this one holds nothing
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.sparkContext._jvm.System.gc()


def _places(keys: np.ndarray):
    """Four bits in its slice for each key."""
    h = mix(keys.view(np.uint64) + np.uint64(0x94D049BB133111EB))
    return [((h >> np.uint64(15 * i)) % np.uint64(SLICE)).astype(np.int64) for i in range(4)]


def _slice(table: pa.Table) -> pa.Table:
    bits = np.zeros(SLICE, np.uint8)
    for at in _places(table.column("key").to_numpy()):
        bits[at] = 1
    return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _passes(bits: np.ndarray):
    """Of the batches' rows, those whose first column may be among the keys of the filter."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            of, go = np.mod(keys, len(bits)), np.ones(len(keys), bool)
            for at in _places(keys):
                go &= (bits[of, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(go))
        release()

    return run


def asked(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose first column, a long hash without nulls, is among ``keys`` (one such column), and few others.

    A Bloom filter, made in slices by the executors: it loses no row, so a join with the keys after it is exact
    and shuffles only what was asked for.
    """
    keys = keys.toDF("key").distinct()
    n = min(MOST_SLICES, math.ceil(keys.count() * KEY_BITS / SLICE))
    if not n:
        return df.where("false")
    made = keys.withColumn("slice", F.pmod("key", F.lit(n)).cast("int")).groupBy("slice").applyInArrow(_slice, "slice int, bits binary")
    bits = np.zeros((n, SLICE // 8), np.uint8)
    for r in made.collect():
        bits[r.slice] = np.frombuffer(r.bits, np.uint8)
    return df.mapInArrow(_passes(bits), df.schema)
