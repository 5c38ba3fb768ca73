"""What the training-data operators share: table access, folders and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table with only the columns asked for."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, since a text may be very long."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted with its ``scratch_scope``, or else when the driver's JVM ends."""
    found = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, found)
    fs.deleteOnExit(path)
    _made.append(found)
    return found


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made within; what is read from them must have been written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        discard(spark, *_made[before:])


def discard(spark: SparkSession, *names: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for name in names:
        path, fs = _path(spark, name)
        fs.delete(path, True)
        _made.remove(name)


def sampled(rows: DataFrame, most: int, n: int, *keys: str) -> DataFrame:
    """About ``most`` of the ``n`` rows, chosen by a hash of ``keys``: the same ones in every run.

    The bound is on 63 bits, so a share of one in a million millions still draws rows.
    """
    return rows.where(sample_test(most, n, *keys))


def sample_test(most: int, n: int, *keys: str) -> Column:
    if n <= most:
        return F.lit(True)
    return F.xxhash64(F.lit("sample"), *keys).bitwiseAND((1 << 63) - 1) < sample_bound(most, n)


def sample_bound(most: int, n: int) -> int:
    """The bound on a 63-bit hash below which ``most`` of ``n`` rows lie."""
    return min((1 << 63) - 1, (most << 63) // max(1, n))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo ``by``: the split into folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def tidy(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that hands back its freed memory when a task ends, since workers live on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            hand_back()

    return run


def hand_back() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` from batches that are sorted by it, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = b.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[start]
                held.append(b.slice(start, i - start))
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def clustered(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows of a key together and in order, for ``groups_of``."""
    df = df.repartition(parts, key) if parts else df.repartition(key)
    return df.sortWithinPartitions(key)


#: Words of 64 bits in a filter, at most (16 MB); there is none for more than an eighth as many keys as bits.
FILTER_WORDS = 1 << 21


def key_filter(rows: DataFrame, key: str) -> np.ndarray | None:
    """A bit set that holds the values of ``key`` and others by chance; None where it would be too large to send."""
    rows = rows.select(F.xxhash64(key).alias("r")).distinct()
    need = rows.count() * 8 // 64
    if need > FILTER_WORDS:
        return None
    words = 1 << max(10, need.bit_length())
    word, bit = F.pmod("r", F.lit(words)), F.pmod(F.shiftright("r", 32), F.lit(64)).cast("int")
    found = rows.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(words, np.uint64)
    t = found.toArrow()
    out[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def let_through(rows: DataFrame, key: str, bits: np.ndarray | None, held: bool = True) -> DataFrame:
    """The rows whose ``key`` a filter holds, and others by chance, so that a join moves no more than that; all of them without a filter.

    Not ``held``: the other rows instead, none without a filter.
    """
    if bits is None:
        return rows if held else rows.where(F.lit(False))
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column(0).to_numpy()
            word = shared.value[r % len(shared.value)]
            ok = (word >> ((r >> 32) % 64).astype(np.uint64)) & np.uint64(1)
            ok = ok.astype(bool) == held
            if ok.any():
                yield b.drop_columns(["_r"]).filter(pa.array(ok))

    return rows.select(F.xxhash64(key).alias("_r"), "*").mapInArrow(tidy(run), rows.schema)
