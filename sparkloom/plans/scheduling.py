"""Scheduling over ``documents`` as files, with paths from their ids and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scheduling as op
from ..session import table
from .registry import query

_PATH = "source || CASE doc_id % 3 WHEN 0 THEN '/include' WHEN 1 THEN '/src' ELSE '' END || '/File' || doc_id // 2 || CASE doc_id % 4 WHEN 0 THEN '.hpp' WHEN 3 THEN '.txt' ELSE '.cpp' END"
_U = f"""u AS (SELECT *, CASE WHEN h AND i THEN 'paired' WHEN h THEN 'header' ELSE 'implementation' END AS kind FROM (
  SELECT *, bool_or(ext = 'header') OVER (PARTITION BY key) AS h, bool_or(ext <> 'header') OVER (PARTITION BY key) AS i FROM (
    SELECT doc_id, text, {_PATH} AS path, source || CASE doc_id % 3 WHEN 2 THEN '' ELSE '/__unit__' END || '/file' || doc_id // 2 AS key,
      CASE doc_id % 4 WHEN 0 THEN 'header' WHEN 3 THEN 'other' ELSE 'implementation' END AS ext FROM documents))),
g AS (SELECT *, CASE kind WHEN 'paired' THEN key ELSE path END AS group_key FROM u)"""
_COST = f"""{_U}, n AS (SELECT *, octet_length(encode(text)) AS b, length(text) - length(replace(text, chr(10), '')) + 1 AS l,
    (doc_id % 40) * 100 AS mb, (doc_id % 30) * 100 AS cb, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'exact' WHEN 2 THEN 'paired' WHEN 3 THEN 'header' ELSE 'source' END AS cx FROM g),
c AS (SELECT *, greatest(((200000 + least(b, 4194304) * 18 + l * 2400 + (mb * l * 2400) // 10000 // 2 + (cb * l * 2400) // 10000 // 6)::HUGEINT
    * CASE kind WHEN 'paired' THEN 13000 WHEN 'header' THEN 11500 ELSE 10000 END * CASE ext WHEN 'header' THEN 11500 WHEN 'implementation' THEN 10000 ELSE 9500 END
    * CASE cx WHEN 'none' THEN 8500 WHEN 'exact' THEN 10500 WHEN 'paired' THEN 12000 WHEN 'header' THEN 15500 ELSE 13500 END) // 1000000000000, 1)::BIGINT AS cost FROM n)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    k = F.col("doc_id") % 3
    path = F.concat("source", F.when(k == 0, "/include").when(k == 1, "/src").otherwise(""), F.lit("/File"), F.floor(F.col("doc_id") / 2), F.when(F.col("doc_id") % 4 == 0, ".hpp").when(F.col("doc_id") % 4 == 3, ".txt").otherwise(".cpp"))
    return op.units(d.withColumn("path", path))


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    context = F.when(i == 0, "none").when(i == 1, "exact").when(i == 2, "paired").when(i == 3, "header").otherwise("source")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    cost = op.static_cost(F.octet_length("text"), lines.cast("bigint"), F.col("doc_id") % 40 * 100, F.col("doc_id") % 30 * 100, F.col("kind"), F.col("extension"), context)
    return files(spark, sf_dir).withColumn("cost", cost)


@query(f"WITH {_U} SELECT doc_id, path, kind, group_key, ext AS extension FROM g")
def paired_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", "kind", "group_key", "extension")


@query(f"WITH {_COST} SELECT doc_id, cost FROM c")
def static_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costed(spark, sf_dir).select("doc_id", "cost")


_HIST = "hist AS (SELECT user_id AS id, count(*) AS samples, (sum(value) * 10000)::BIGINT AS ewma, (max(value) * 1000)::BIGINT AS penalty FROM events GROUP BY user_id)"


@query(
    f"""WITH {_COST}, {_HIST} SELECT doc_id, CASE WHEN coalesce(samples, 0) < 60 THEN greatest(cost, 1)
      ELSE least(greatest((greatest(ewma + penalty, 1) * 70 + cost * 30) // 100, greatest(cost // 2, 1)), greatest(cost * 3, greatest(cost // 2, 1))) END AS cost FROM c LEFT JOIN hist ON hist.id = doc_id"""
)
def blended_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = table(spark, sf_dir, "events", "user_id", "value").groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count("*").alias("samples"), F.round(F.sum("value") * 10000).cast("bigint").alias("ewma"), F.round(F.max("value") * 1000).cast("bigint").alias("penalty")
    )
    rows = costed(spark, sf_dir).join(hist, "doc_id", "left")
    enough = F.when(F.col("samples") >= 60, 3).otherwise(0)
    return rows.select("doc_id", op.blended_cost(F.col("cost"), F.col("ewma"), F.col("penalty"), enough).alias("cost"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costed(spark, sf_dir).groupBy(F.col("group_key").alias("unit"), "kind").agg(F.sum("cost").alias("cost"), F.count("*").alias("n_paths"))


@query(f"WITH {_COST} SELECT group_key AS unit, kind, sum(cost)::BIGINT AS cost, count(*) AS n_paths FROM c GROUP BY group_key, kind ORDER BY sum(cost) DESC, CASE kind WHEN 'paired' THEN 0 WHEN 'header' THEN 1 ELSE 2 END, unit")
def ranked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).orderBy(F.desc("cost"), op.lookup(F.col("kind"), {"paired": 0, "header": 1, "implementation": 2}), "unit")


@query(f"WITH {_COST}, s AS (SELECT kind, cost, row_number() OVER (PARTITION BY kind ORDER BY cost) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM c) SELECT kind, cost AS median FROM s WHERE i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.upper_median(costed(spark, sf_dir), ["kind"], "cost")


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lanes(_ranked(spark, sf_dir), 16)


_LANES = f"""RECURSIVE {_COST}, ru AS (SELECT *, row_number() OVER (ORDER BY cost DESC, unit) AS i FROM (SELECT group_key AS unit, sum(cost)::BIGINT AS cost, count(*) AS n_paths FROM c GROUP BY group_key, kind)),
la AS (SELECT 0::BIGINT AS i, list_transform(range(16), lambda k: 0::BIGINT) AS loads, 0 AS lane, 0::BIGINT AS cost, 0::BIGINT AS n_paths UNION ALL
  SELECT i, list_transform(loads, lambda x, k: CASE WHEN k = l THEN x + cost ELSE x END), (l - 1)::INT, cost, n_paths FROM (SELECT ru.i, la.loads, list_position(la.loads, list_min(la.loads)) AS l, ru.cost, ru.n_paths FROM la JOIN ru ON ru.i = la.i + 1)),
un AS (SELECT i, lane, cost, n_paths FROM la WHERE i > 0)"""
_BATCHES = f"""{_LANES}, tg AS (SELECT greatest(sum(cost)::BIGINT // count(*), 1) * 4 AS t FROM un), nu AS (SELECT lane, cost, n_paths, t, cost > t * 3 // 2 AS alone, row_number() OVER (PARTITION BY lane ORDER BY i) AS j FROM un, tg),
ba AS (SELECT DISTINCT lane, 0::BIGINT AS j, 0 AS b, 0::BIGINT AS c, 0 AS n, 0::BIGINT AS p, -1 AS batch, 0::BIGINT AS cost, 0::BIGINT AS n_paths FROM nu UNION ALL
  SELECT lane, j, b + brk::INT + alone::INT, CASE WHEN alone THEN 0 WHEN brk THEN cost ELSE c + cost END, CASE WHEN alone THEN 0 WHEN brk THEN 1 ELSE n + 1 END, CASE WHEN alone THEN 0 WHEN brk THEN n_paths ELSE p + n_paths END, b + brk::INT, cost, n_paths
  FROM (SELECT nu.*, b, c, n, p, n > 0 AND (c + nu.cost > t OR n >= 8 OR p + nu.n_paths > 16 OR alone) AS brk FROM ba JOIN nu ON nu.lane = ba.lane AND nu.j = ba.j + 1))"""


@query(f"WITH {_LANES} SELECT lane, sum(cost)::BIGINT AS cost, count(*) AS units FROM un GROUP BY lane")
def lpt_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).groupBy("lane").agg(F.sum("cost").alias("cost"), F.count("*").alias("units"))


def _target(spark: SparkSession, sf_dir: str) -> int:
    total = _ranked(spark, sf_dir).agg(F.sum("cost").alias("c"), F.count("*").alias("n")).first()
    return max(1, (total.c or 1) // max(1, total.n))


@query(f"WITH {_BATCHES} SELECT lane, batch, sum(cost)::BIGINT AS cost, count(*) AS units, sum(n_paths)::BIGINT AS paths FROM ba WHERE j > 0 GROUP BY lane, batch")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.batches(_lanes(spark, sf_dir), _target(spark, sf_dir) * 4)
    return found.groupBy("lane", "batch").agg(F.sum("cost").alias("cost"), F.count("*").alias("units"), F.sum("n_paths").alias("paths"))


@query(f"WITH {_BATCHES} SELECT lane, batch, sum(cost)::BIGINT AS cost FROM ba WHERE j > 0 GROUP BY lane, batch")
def interleaved_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in the order of their number, then lane."""
    found = op.batches(_lanes(spark, sf_dir), _target(spark, sf_dir) * 4)
    return found.groupBy("lane", "batch").agg(F.sum("cost").alias("cost")).orderBy("batch", "lane")


@query("SELECT n_nationkey AS worker, (103 // 25 + CASE WHEN n_nationkey < 103 % 25 THEN 1 ELSE 0 END)::BIGINT AS jobs FROM nation")
def job_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.job_split(103, table(spark, sf_dir, "nation", "n_nationkey").withColumnRenamed("n_nationkey", "worker"))


@query("SELECT s_suppkey, greatest(ceil(ceil(sqrt(s_suppkey)) * (1.5 - 1 / (1 + exp(-3.0 * (s_nationkey / 10 - 1))))), 4)::BIGINT AS cap FROM supplier")
def parse_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", op.parse_cap(F.col("s_suppkey"), F.col("s_nationkey")).alias("cap"))
