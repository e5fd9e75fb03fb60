"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handed to one vectorised step hold about this many bytes together.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; without the setting a local master (a test) gets a local folder and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/plangrove-checkpoints"
    return folder.rstrip("/")


#: Whether Spark removes the shuffle files of a statement when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.  ``clean``: the shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plangrove/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        if clean:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text; null stays None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a text column of about ``limit`` bytes, one text at least."""
    if not len(column):
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield column.slice(start, stop - start)
        start = stop


def tidy() -> None:
    """Gives memory that a task has freed back to the system: workers live on and take turns at many stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, tidying up behind each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def text_column(make: Callable[[], Callable[[list], list[pa.Array]]], schema: str, names: list[str], as_bytes: bool = True):
    """A column function over whole texts: ``make()`` runs once a task and returns a step from texts to arrays.

    The result is a struct of ``names``; all other columns of a row stay in the JVM.
    """
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make()
        try:
            for batch in batches:
                parts = [step(byte_texts(x) if as_bytes else x.to_pylist()) for x in slices(batch)] or [step([])]
                yield pa.StructArray.from_arrays([pa.concat_arrays([p[k] for p in parts]) for k in range(len(names))], names)
        finally:
            del step
            tidy()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, schema)


#: Bytes of remembered results of one operator in one worker, and of the longest key that is remembered.
CACHE_BYTES = 128 << 20
CACHE_KEY = 64


class ByteCache:
    """Results by key in two generations that together stay within a number of bytes; long keys are not kept.

    ``new`` may be read directly; what it lacks is asked for with :meth:`get`.
    """

    def __init__(self, limit: int = CACHE_BYTES, longest: int = CACHE_KEY):
        self.limit, self.longest, self.held = limit // 2, longest, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        return self.old.get(key) if found is None else found

    def put(self, key, value, size: int = 0) -> None:
        """Keeps a value whose parts take about ``size`` bytes beside 200 of objects and tables."""
        if len(key) > self.longest or key in self.new:
            return
        self.held += 200 + len(key) + size
        if self.held > self.limit:
            self.old, self.new, self.held = self.new, {}, 200 + len(key) + size
        self.new[key] = value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def stream64(seed: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        k = np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix64(k)


def prefix_totals(df: DataFrame, key: str, order: list[str], count: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``count`` over the earlier rows of the same ``key`` (small tables only)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)))
