"""Joins: interval, as-of, scored, multiset and anti joins, and the checks built on them.

Interval joins explode intervals into buckets and join on (key, bucket), so
they are equi-joins; the comparison only filters within a bucket.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Every point with each interval of its key that holds it (ends included)."""
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(i, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def innermost(found: DataFrame, point: list[str], start: str, end: str) -> DataFrame:
    """The narrowest interval of each point; of equally narrow ones that which starts last."""
    w = Window.partitionBy(*point).orderBy(F.col(end) - F.col(start), F.desc(start))
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlapping(a: DataFrame, keys: list[str], item: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of a key's intervals (smaller item first) that share a point, once each: in the bucket where the later one starts."""
    cells = a.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    other = cells.select(*keys, "_b", F.col(item).alias("other"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    pairs = cells.join(other, [*keys, "_b"]).where((F.col(item) < F.col("other")) & (F.col(start) <= F.col("_e")) & (F.col("_s") <= F.col(end)))
    return pairs.where(F.col("_b") == F.floor(F.greatest(start, "_s") / bucket)).select(*keys, item, "other")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` no later than its time: a union and a running last, so one sort.

    At equal times right rows come first; ``tie`` orders rows of one time.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*keys, time, tie, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(time, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def scored_top(pairs: DataFrame, target: str, score: Column, distinct: str, order: str, most: int = 6, least: int = 1) -> DataFrame:
    """For each target the ``most`` best candidates with a score of at least ``least``, one for each value of ``distinct``."""
    rows = pairs.withColumn("score", score).where(F.col("score") >= least)
    first = Window.partitionBy(target, distinct).orderBy(F.desc("score"), order)
    best = Window.partitionBy(target).orderBy(F.desc("score"), order)
    once = rows.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Values whose counts differ, with both counts (one shuffle: signed counts in a single aggregation)."""
    counted = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(*columns, F.lit(0), F.lit(1)))
    return counted.groupBy(*columns).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right")).where("n_left <> n_right")


def fingerprint(rows: DataFrame, path: str) -> DataFrame:
    """CRC-32 and length of ``path:count`` of all rows, in order and joined by bars.

    Sorted ranges are read by one task each; their checksums are put together
    in order, so the list is in one place nowhere.
    """
    counted = rows.groupBy(F.col(path).cast("string").alias("p")).agg(F.count("*").alias("n")).select(F.concat_ws(":", "p", "n").alias("x"))
    dealt = counted.repartitionByRange("x").sortWithinPartitions("x")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crc = size = chars = 0
        for pdf in parts:
            for x in pdf["x"]:
                raw = (x + "|").encode()
                crc, size, chars = zlib.crc32(raw, crc), size + len(raw), chars + len(x) + 1
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "crc": [crc], "size": [size], "chars": [chars]})

    found = sorted(dealt.mapInPandas(read, "part int, crc bigint, size bigint, chars bigint").collect())  # one row a range
    crc = size = chars = 0
    for r in found:
        crc, size, chars = crc_combined(crc, r.crc, r.size), size + r.size, chars + r.chars
    if size:  # without the last bar
        crc, chars = crc_without_last(crc, b"|"), chars - 1
    return rows.sparkSession.createDataFrame([(f"{crc:x}-{chars}",)], "fingerprint string")


def fingerprint_by_key(lines: DataFrame, key: str, line: str) -> DataFrame:
    """CRC-32 and length, in hexadecimal, of each key's lines in order and joined by line feeds.

    Lines are dealt into sorted ranges whatever their key, so a key may hold
    most of a table; what is put together by key is one row a range.
    A null key is a key of its own and null lines are left out.
    """
    dealt = lines.select(F.col(key).alias("k"), F.col(line).alias("x")).where("x IS NOT NULL").repartitionByRange("k", "x").sortWithinPartitions("k", "x")
    of = lines.schema[key].dataType.simpleString()

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        now: list | None = None
        for b in parts:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = x.encode() + b"\n"
                if now and now[0] == k:
                    now[2:] = zlib.crc32(raw, now[2]), now[3] + len(raw)
                else:
                    if now:
                        yield row(now, b.schema.field(0).type)
                    now, kind = [k, at, zlib.crc32(raw), len(raw)], b.schema.field(0).type
        if now:
            yield row(now, kind)

    def row(x: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (kind, pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["k", "part", "crc", "size"])

    @F.pandas_udf("string")
    def whole(parts: pd.Series) -> pd.Series:
        def one(rows) -> str:
            crc = size = 0
            for r in rows:
                crc, size = crc_combined(crc, r["crc"], r["size"]), size + r["size"]
            return f"{crc_without_last(crc, b'\n'):08x}-{size - 1:x}"

        return parts.map(one)

    ranges = dealt.mapInArrow(read, f"k {of}, part int, crc bigint, size bigint")
    found = ranges.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "crc", "size"))).alias("parts"))
    return found.select(F.col("k").alias(key), whole("parts").alias("fingerprint"))


_POLY = 0xEDB88320


def crc_combined(a: int, b: int, size: int) -> int:
    """CRC-32 of two byte strings one after another, from theirs and the second's length."""
    # a matrix over GF(2) shifts a checksum by one zero bit; its powers of two make up the length
    shift = [_POLY] + [1 << i for i in range(31)]
    apply = lambda m, v: functools.reduce(operator.xor, (m[i] for i in range(32) if v >> i & 1), 0)
    bits = size * 8
    while bits:
        if bits & 1:
            a = apply(shift, a)
        shift = [apply(shift, x) for x in shift]
        bits >>= 1
    return a ^ b


def crc_without_last(crc: int, byte: bytes) -> int:
    """CRC-32 of a byte string, from that of the string with ``byte`` behind it."""
    state = crc ^ 0xFFFFFFFF
    steps = []
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ (_POLY if x & 1 else 0)
        steps.append(x)
    index = next(i for i in range(256) if steps[i] >> 24 == state >> 24)
    before = (state ^ steps[index]) << 8 & 0xFFFFFFFF | (index ^ byte[0])
    return before ^ 0xFFFFFFFF


def missing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids that are gone."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def dropped_counts(before: DataFrame, after: DataFrame, key: str, n: str, tolerance: int) -> DataFrame:
    """Ids whose count fell by more than ``tolerance``."""
    joined = before.select(key, F.col(n).alias("_b")).join(after.select(key, F.col(n).alias("_a")), key, "left")
    fall = F.greatest(F.col("_b") - F.coalesce("_a", F.lit(0)), F.lit(0))
    return joined.withColumn("fall", fall).where(F.col("fall") > tolerance).select(key, "fall")


def cache_probe(files: DataFrame, cache: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their cached value, and misses."""
    return files.join(cache.select(*keys, value), keys), files.join(cache, keys, "left_anti")


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], at: str, target: str) -> DataFrame:
    """The target of each point's key that is nearest to it; of two the smaller. Points of keys without targets are left out.

    The nearest ones on both sides are running lasts over points and targets together, so nothing is paired.
    """
    both = points.withColumn("_t", F.lit(None).cast(targets.schema[target].dataType)).unionByName(
        targets.select(*keys, F.col(target).alias(at), F.col(target).alias("_t")), allowMissingColumns=True
    )
    side = F.col("_t").isNull().cast("int")
    last = lambda order: F.last("_t", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, side).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"_l": last(F.col(at)), "_r": last(F.desc(at))}).where("_t IS NULL")
    nearer = F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull() | (F.col(at) - F.col("_l") <= F.col("_r") - F.col(at)), F.col("_l")).otherwise(F.col("_r"))
    return rows.withColumn(target, nearer).where(F.col(target).isNotNull()).drop("_t", "_l", "_r")


def far_from(points: DataFrame, edits: DataFrame, keys: list[str], at: str, line: str, radius: int) -> DataFrame:
    """Points with no edited line of their key within ``radius``: a band anti-join over buckets of that size."""
    width = max(1, radius)
    near = edits.select(*keys, F.col(line).alias("_l"), F.explode(F.sequence(F.floor(F.col(line) / width) - 1, F.floor(F.col(line) / width) + 1)).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    cond = [p[k] == near[k] for k in keys] + [p["_b"] == near["_b"], F.abs(p[at] - near["_l"]) <= radius]
    both = cond[0]
    for c in cond[1:]:
        both = both & c
    return p.join(near, both, "left_anti").drop("_b")


def scope_drift(before: DataFrame, after: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Sum over kinds of the change of counts, by key."""
    counted = before.select(*keys, kind, F.lit(1).alias("n")).unionAll(after.select(*keys, kind, F.lit(-1)))
    return counted.groupBy(*keys, kind).agg(F.abs(F.sum("n")).alias("d")).groupBy(*keys).agg(F.sum("d").alias("drift"))


def mode_last(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The most frequent kind of each key; of equals the highest."""
    return rows.groupBy(*keys, kind).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max_by(kind, F.struct("_n", kind)).alias(kind))


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def routed(warnings: DataFrame, text: str, prefix: str, fields: list[str]) -> DataFrame:
    """Typed rows from ``prefix`` warnings, split at colons into the fields; the last keeps the rest."""
    rest = F.substring(text, F.lit(len(prefix) + 1), F.length(text))
    parts = F.split(rest, ":", len(fields))
    rows = warnings.where(F.col(text).startswith(prefix) & (F.size(parts) == len(fields)))
    return rows.select(*[c for c in warnings.columns if c != text], *(parts[i].alias(f) for i, f in enumerate(fields)))
