"""Shared pieces: scratch tables, Arrow column access, vectorised hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a Python worker.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset and all runs on this machine, a folder of our own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.scratch.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a shared folder")
        given = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("tessera.scratch.dir", given)
    return given


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    drop() removes a table that is read no more; what a result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._quietly)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._tessera_path)

    def _quietly(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session is already gone; nothing to keep
            pass


#: Rows that Spark hands to a Python worker at a time, on top of its limit in bytes.
BATCH_ROWS = 1000


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches; a task's free memory goes back to the system when it ends, since
    the worker lives on and others need it."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return df.mapInArrow(lean, schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of `column` each (one row at least)."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(data), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array end to end, and the n + 1 offsets of its rows; nulls are empty."""
    array = pa.compute.fill_null(array.cast(pa.large_binary()), b"")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (in the manner of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a byte buffer, from prefix sums.

    Bytes are first replaced by random 64-bit values, so the hash of a span is a random odd polynomial in them.
    """

    _BASE = 0x9E3779B97F4A7C15 | 1
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self, seed: int = 1):
        self.values = np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self._BASE), ("down", self._INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def salted_rank(spark: SparkSession, df: DataFrame, keys: list[str], order: list[Column], salts: int, salt: Column, out: str) -> DataFrame:
    """Adds `out`: a gapless rank from 0 within `keys`, without sorting a key in one task.

    Rows are ranked within (keys, salt) and shifted by the counts of the smaller salts, so the order is by salt first;
    a salt that is monotone in the order makes it the order itself.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("__salt", salt.cast("int"))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    shifts = counts.withColumn("__before", F.sum("__n").over(before.orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)))
    inner = F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order)) - 1
    shifts = shifts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"), F.coalesce("__before", F.lit(0)).alias("__before"))
    same = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return salted.withColumn("__r", inner).join(shifts, same).withColumn(out, (F.col("__r") + F.col("__before")).cast("long")).drop("__salt", "__s", "__r", "__before", *[f"__k{i}" for i in range(len(keys))])


def ordered_rank(scratch: Scratch, df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the row's place (from 0) in the whole order, by a range partitioning and the sizes of its parts."""
    from pyspark.sql import Window as W

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.write(parts.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return placed.join(before, "__p").withColumn(out, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")
