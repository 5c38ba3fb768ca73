"""Work scheduling: file units, cost model, lanes and batches.

Costs are integer column expressions. Lanes and batches depend on what came
before, so they are folds: the lane of a unit is the least loaded one after
all larger units. That fold needs every unit in turn, so it runs in one task
over (cost, key) alone; ``lanes`` documents its bound.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the cost model.
BASE, MAX_BYTES, PER_BYTE, PER_LINE = 200_000, 4 * 1024 * 1024, 18, 2_400
KIND_BP = {"paired": 13_000, "header": 11_500, "implementation": 10_000}
EXTENSION_BP = {"header": 11_500, "implementation": 10_000, "other": 9_500}
CONTEXT_BP = {"none": 8_500, "exact": 10_500, "paired": 12_000, "header": 15_500, "source": 13_500}
HEADERS, SOURCES = ("h", "hh", "hpp", "hxx"), ("c", "cc", "cpp", "cxx")
MAX_UNITS, MAX_PATHS = 8, 16


def lookup(key: Column, table: dict[str, int]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def idiv(a: Column, b: int | Column) -> Column:
    """Integer quotient of numbers that are not negative."""
    return F.floor(a / b).cast("bigint")


def static_cost(n_bytes: Column, lines: Column, macro_bp: Column, comment_bp: Column, kind: Column, extension: Column, context: Column) -> Column:
    """Cost of a file from what can be seen of it; integer division throughout."""
    line = lines * PER_LINE
    base = BASE + F.least(n_bytes, F.lit(MAX_BYTES)) * PER_BYTE + line + idiv(idiv(macro_bp * line, 10_000), 2) + idiv(idiv(comment_bp * line, 10_000), 6)
    scaled = base.cast("decimal(38,0)") * lookup(kind, KIND_BP) * lookup(extension, EXTENSION_BP) * lookup(context, CONTEXT_BP)
    return F.greatest(F.floor(scaled / F.lit(10_000).cast("decimal(5,0)") / F.lit(100_000_000).cast("decimal(9,0)")).cast("bigint"), F.lit(1))


def blended_cost(static: Column, ewma: Column, penalty: Column, samples: Column) -> Column:
    """Seven tenths history, from half to three times the static cost; without three samples the static cost."""
    low = F.greatest(idiv(static, 2), F.lit(1))
    mixed = idiv(F.greatest(ewma + penalty, F.lit(1)) * 70 + static * 30, 100)
    return F.when(F.coalesce(samples, F.lit(0)) < 3, F.greatest(static, F.lit(1))).otherwise(F.least(F.greatest(mixed, low), F.greatest(static * 3, low)))


def unit_key(path: Column) -> Column:
    """Directory with the first include, inc, src or source segment neutralised, and the stem in lower case."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    neutral = F.regexp_replace(F.concat(F.lit("/"), parent, F.lit("/")), "^((?:/(?!(?i:include|inc|src|source)/)[^/]*)*?)/(?i:include|inc|src|source)/", "$1/__unit__/")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    inner = F.regexp_replace(F.regexp_replace(neutral, "^/", ""), "/$", "")
    return F.when(parent == "", stem).otherwise(F.concat_ws("/", inner, stem))


def extension_class(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    return F.when(ext.isin(*HEADERS), "header").when(ext.isin(*SOURCES), "implementation").otherwise("other")


def units(files: DataFrame) -> DataFrame:
    """files (path) with kind and group_key: paired files share one, others are alone."""
    key, ext = unit_key(F.col("path")), extension_class(F.col("path"))
    rows = files.withColumns({"_key": key, "_ext": ext})
    groups = rows.groupBy("_key").agg(F.bool_or(F.col("_ext") == "header").alias("_h"), F.bool_or(F.col("_ext") != "header").alias("_i"))
    kind = F.when(F.col("_h") & F.col("_i"), "paired").when(F.col("_h"), "header").otherwise("implementation")
    out = rows.join(groups, "_key").withColumn("kind", kind)
    return out.withColumn("group_key", F.when(F.col("kind") == "paired", F.col("_key")).otherwise(F.col("path"))).drop("_key", "_h", "_i").withColumnRenamed("_ext", "extension")


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at n div 2 of the sorted values (counted from 0), by key, without collecting them."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = Window.partitionBy(*keys)
    return rows.select(*keys, value, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(n).alias("n")).where(F.col("i") == F.floor(F.col("n") / 2)).select(*keys, F.col(value).alias("median"))


def lanes(ranked: DataFrame, count: int) -> DataFrame:
    """Each unit's lane: units come by cost (largest first) and key, and go to the lane with the least so far, the first of equals.

    Sequential by its meaning: one task holds the units' keys and costs (a
    unit is a group of files; ten million take under a gigabyte).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cost", "unit"], ascending=[False, True])
        heap = [(0, i) for i in range(count)]
        found = []
        for c in pdf["cost"].tolist():
            load, lane = heapq.heappop(heap)
            found.append(lane)
            heapq.heappush(heap, (load + c, lane))
        return pdf.assign(lane=found, place=range(len(pdf)))[["unit", "cost", "n_paths", "lane", "place"]]

    rows = ranked.select("unit", "cost", "n_paths", F.lit(0).alias("all"))
    kind = dict(rows.dtypes)["unit"]
    return rows.groupBy("all").applyInPandas(fold, f"unit {kind}, cost bigint, n_paths bigint, lane int, place bigint")


def batches(assigned: DataFrame, target: int) -> DataFrame:
    """Batch numbers within each lane, by cost, units and paths; a unit above one and a half times the target is alone."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        batch, cost, n_units, paths, out = 0, 0, 0, 0, []
        for c, p in zip(pdf["cost"].tolist(), pdf["n_paths"].tolist(), strict=True):
            alone = c > target * 3 // 2
            full = n_units and (cost + c > target or n_units >= MAX_UNITS or paths + p > MAX_PATHS)
            if n_units and (full or alone):
                batch, cost, n_units, paths = batch + 1, 0, 0, 0
            out.append(batch)
            if alone:
                batch += 1
            else:
                cost, n_units, paths = cost + c, n_units + 1, paths + p
        return pdf.assign(batch=out)

    kind = dict(assigned.dtypes)["unit"]
    return assigned.groupBy("lane").applyInPandas(fold, f"unit {kind}, cost bigint, n_paths bigint, lane int, place bigint, batch int")


def job_split(total: int, workers: DataFrame, worker: str = "worker") -> DataFrame:
    """Jobs for each of ``workers`` (numbered from 0): equal shares, one more for the first ones."""
    rows = workers.crossJoin(F.broadcast(workers.agg(F.count("*").alias("_n"))))  # one row
    count = F.col("_n")
    jobs = F.greatest(F.lit(total), count)
    return rows.select(worker, (F.floor(jobs / count) + F.when(F.col(worker) < jobs % count, 1).otherwise(0)).cast("bigint").alias("jobs"))


def parse_cap(targets: Column, observations: Column) -> Column:
    """How many targets are parsed at once: about a root of them, fewer as the population matures, 4 at least."""
    mature = 1 / (1 + F.exp(-3.0 * (observations / 10.0 - 1)))
    return F.greatest(F.ceil(F.ceil(F.sqrt(targets.cast("double"))) * (1.5 - mature)), F.lit(4)).cast("bigint")
