"""Include resolution along ordered search paths, and what files include in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def normal(path: Column) -> Column:
    """A path without ``.``, empty segments and ``..`` behind a name."""
    up = lambda out: (F.size(out) > 0) & (F.element_at(out, -1) != "..")
    step = lambda out, s: (
        F.when(s.isin("", "."), out).when((s == "..") & F.coalesce(F.when(F.size(out) > 0, up(out)), F.lit(False)), F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(s)))
    )
    found = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), found)).otherwise(found)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolved(includes: DataFrame, files: DataFrame, search: list[str]) -> DataFrame:
    """``includes`` (file, name, quoted) with ``target``: the first file of that name that there is; null for none.

    Quoted names are looked for beside the file first, then all names in the
    folders of ``search`` in order. Names that begin with ``/`` are whole paths.
    Repeated rows stay. A null name or file has no target.
    """
    whole = F.col("name").startswith("/")
    places = [F.when(~whole & F.col("quoted"), F.concat_ws("/", folder(F.col("file")), "name"))] + [F.when(~whole, F.concat(F.lit(d + "/" if d else ""), "name")) for d in search] + [F.when(whole, F.col("name"))]
    rows = includes.select("file", "name", "quoted").distinct()
    tried = rows.select("*", F.posexplode(F.array(*places)).alias("rank", "path")).where("path IS NOT NULL AND file IS NOT NULL").withColumn("path", normal(F.col("path")))
    there = files.select(F.col("path")).distinct()
    best = tried.join(there, "path").groupBy("file", "name", "quoted").agg(F.min_by("path", "rank").alias("target"))
    return includes.join(best, ["file", "name", "quoted"], "left")


def closure(edges: DataFrame) -> DataFrame:
    """(file, included, depth): all that a file includes, with the least number of steps; itself too if it is on a cycle.

    ``edges``: (file, target). Each round doubles the steps that are known: pairs of exactly that many go on by all pairs,
    so the rounds, in which all pairs are dealt once, are the logarithm of the greatest depth, and cycles end.
    """
    paths = cut(edges.where("file IS NOT NULL AND target IS NOT NULL").select("file", F.col("target").alias("included")).distinct().withColumn("depth", F.lit(1)))
    length = 1
    while True:
        jump = paths.where(F.col("depth") == length)
        if jump.isEmpty():
            return paths
        on = paths.select(F.col("file").alias("_m"), F.col("included").alias("_to"), F.col("depth").alias("_d"))
        longer = jump.join(on, jump.included == F.col("_m")).select("file", F.col("_to").alias("included"), (F.col("depth") + F.col("_d")).alias("depth"))
        paths = cut(paths.unionByName(longer).groupBy("file", "included").agg(F.min("depth").alias("depth")))
        length *= 2
