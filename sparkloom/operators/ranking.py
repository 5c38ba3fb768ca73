"""The first k rows by a total order, however large k is, and places within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

#: Up to so many rows Spark's own top-k is used, which gathers them in one task.
GATHERED = 50_000


def first_k(rows: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of ``rows`` by ``order``.

    A large k is met without gathering: rows are dealt into sorted ranges, the
    ranges' sizes give the one in which row k lies, and only that one is cut.
    """
    if k <= GATHERED:
        return rows.orderBy(*order).limit(max(0, k))
    # written once, so that both reads see the same ranges
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r["count"]) for r in dealt.groupBy(part.alias("p")).count().collect())  # one row a range
    left = k
    for p, n in sizes:
        if n >= left:
            return dealt.where((part < p) | ((part == p) & (place < left))).drop("_at")
        left -= n
    return dealt.drop("_at")


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their place from 1 by ``order`` within their keys, which are null or not.

    Rows are dealt into sorted ranges whatever their keys, so that one key may
    hold most of them. A row's place is that in its range, plus the rows of
    its key in the ranges before, which are a table of one row a key and range.
    Rows that ``order`` does not tell apart are numbered as they come.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    pieces = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(pieces, same).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_at") + F.col("_shift")).cast("int").alias(name))
