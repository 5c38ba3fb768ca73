"""Line context over the star tables: a customer bucket is a file, days are lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as op
from ..session import table
from .registry import query

_IN = """ln AS (SELECT f AS file, i AS line FROM range(150) a(f), range(120) b(i)),
sc AS (SELECT o_custkey % 150 AS file, o_orderkey % 120 AS s, o_orderkey % 120 + o_orderkey % 13 AS e, CASE o_orderkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'type' WHEN 2 THEN 'namespace' ELSE 'preprocessor' END AS kind FROM orders WHERE o_orderpriority <> '1-URGENT'),
mc AS (SELECT o_custkey % 150 AS file, o_orderkey % 120 AS s, o_orderkey % 120 + 2 AS e FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
dl AS (SELECT user_id % 150 AS file, event_id % 120 AS line FROM events WHERE event_type = 'view'), rf AS (SELECT user_id % 150 AS file, event_id % 120 AS line FROM events WHERE event_type = 'click'),
er AS (SELECT DISTINCT user_id % 150 AS file, event_id % 120 AS line FROM events WHERE event_type = 'error'),
ins AS (SELECT file, line, kind FROM (SELECT ln.file, line, kind, row_number() OVER (PARTITION BY ln.file, line ORDER BY e - s, s DESC, kind) AS r FROM ln JOIN sc ON sc.file = ln.file AND line BETWEEN s AND e) WHERE r = 1),
pr AS (SELECT ln.file, ln.line, coalesce(kind, 'global') AS scope, coalesce(nd, 0) AS n_decls, coalesce(nr, 0) AS n_refs, m.file IS NOT NULL AS in_macro, er.file IS NOT NULL AS has_error
  FROM ln LEFT JOIN ins USING (file, line) LEFT JOIN (SELECT file, line, count(*) AS nd FROM dl GROUP BY ALL) USING (file, line) LEFT JOIN (SELECT file, line, count(*) AS nr FROM rf GROUP BY ALL) USING (file, line)
  LEFT JOIN (SELECT DISTINCT ln.file, line FROM ln JOIN mc ON mc.file = ln.file AND line BETWEEN s AND e) m ON m.file = ln.file AND m.line = ln.line LEFT JOIN er ON er.file = ln.file AND er.line = ln.line)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.range(150 * 120).selectExpr("id div 120 AS file", "id % 120 AS line")  # the lines of 150 files
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr("user_id % 150 AS file", "event_id % 120 AS line", "event_type")
    macros = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").selectExpr("o_custkey % 150 AS file", "o_orderkey % 120 AS s", "o_orderkey % 120 + 2 AS e")
    return op.profiles(lines, _scopes(spark, sf_dir), macros, ev.where("event_type = 'view'"), ev.where("event_type = 'click'"), ev.where("event_type = 'error'"))


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE o_orderkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'type' WHEN 2 THEN 'namespace' ELSE 'preprocessor' END AS kind"
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where("o_orderpriority <> '1-URGENT'").selectExpr("o_custkey % 150 AS file", "o_orderkey % 120 AS s", "o_orderkey % 120 + o_orderkey % 13 AS e", kind)
    # of scopes with the same bounds the first kind by name stands for all
    return rows.groupBy("file", "s", "e").agg(F.min("kind").alias("kind"))


@query(
    f"""WITH {_IN} SELECT file, line, scope, n_decls, n_refs, in_macro, has_error, CASE WHEN n_decls > 0 AND n_refs > 0 THEN 'mixed' WHEN n_decls > 0 THEN 'declaration' WHEN n_refs > 0 THEN 'reference' ELSE 'structural' END AS role,
      NOT in_macro AND (NOT has_error OR (n_decls = 0 AND n_refs = 0 AND scope <> 'preprocessor')) AS safe_edit, NOT has_error AND (in_macro OR scope = 'global') AS safe_global FROM pr"""
)
def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).withColumns({"role": op.role(F.col("n_decls"), F.col("n_refs"), F.col("scope")), "safe_edit": op.safe_edit(), "safe_global": op.safe_global()})


def _b(cond: str, name: str) -> str:
    return f"least(count(*) FILTER ({cond}) * 8 // count(*), 8)::INT AS b_{name}"


@query(
    f"WITH {_IN} SELECT file, count(*) AS n_lines, min(line) AS first, max(line) AS last, "
    + ", ".join([_b("in_macro", "macro"), _b("has_error", "error"), _b("n_decls > 0", "decl"), _b("n_refs > 0", "ref"), *(_b(f"scope = '{k}'", k) for k in ("function", "type", "namespace", "preprocessor"))])
    + " FROM pr GROUP BY file"
)
def context_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clusters(_profiles(spark, sf_dir))


@query(
    f"""WITH {_IN}, hit AS (SELECT file, line, s, e FROM (SELECT er.file, line, s, e, row_number() OVER (PARTITION BY er.file, line ORDER BY e - s, s DESC) AS r FROM er JOIN sc ON sc.file = er.file AND line BETWEEN s AND e) WHERE r = 1),
    rg AS (SELECT file, s, e FROM hit UNION SELECT file, line, line FROM er WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.file = er.file AND hit.line = er.line)),
    w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM rg),
    g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w), m AS (SELECT file, min(s) AS s, max(e) AS e FROM g GROUP BY file, g)
    SELECT file, s, e FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s, e) AS r FROM m) WHERE r <= 6"""
)
def impact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").where("event_type = 'error'").selectExpr("user_id % 150 AS file", "event_id % 120 AS line").distinct()
    return op.impact_ranges(edits, _scopes(spark, sf_dir))


_EV = "SELECT user_id, event_type, count(*) AS n, avg(value) / 100 AS ema FROM events GROUP BY ALL"


@query(
    f"""SELECT user_id, event_type, round(CASE WHEN n < 3 THEN 1.0 WHEN x <= 0.5 THEN 0.5 + x ELSE 1.0 + 0.6 * (x - 0.5) END, 6) AS modifier,
      CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 0 ELSE 4 END AS block, CASE event_type WHEN 'view' THEN 28 WHEN 'click' THEN 2 ELSE 6 END AS ref_tolerance
    FROM (SELECT *, least(greatest(ema, 0.0), 1.0) AS x FROM ({_EV}))"""
)
def context_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("ema"))
    t = F.col("event_type")
    kind, context = F.when(t == "view", "function").when(t == "click", "namespace").otherwise("x"), F.when(t == "view", "paired").when(t == "click", "exact").otherwise("none")
    return ev.select("user_id", "event_type", F.round(op.modifier(F.col("ema"), F.col("n")), 6).alias("modifier"), op.block_index(kind).alias("block"), op.tolerance(context, 0).alias("ref_tolerance"))


@query(
    """SELECT user_id, (a + b * floor(m * 120 / 27 + 0.5) + c * floor(m * 320 / 27 + 0.5) + d * floor(m * 480 / 27 + 0.5))::BIGINT AS score, floor(512 + 130560 / (1 + exp(-(10 / (0.1 + 0.05)) * (m - 0.7))))::BIGINT AS batch
    FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'signup') AS d, (user_id % 10) / 10 + 0.03 AS m FROM events GROUP BY user_id)"""
)
def diagnostic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_type")
    rows = ev.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "error", "signup"))).withColumn("m", F.col("user_id") % 10 / 10 + 0.03)
    counts = [F.col(t) for t in ("view", "click", "error", "signup")]
    return rows.select("user_id", op.diagnostic_score(counts, F.col("m"), F.col("m")).alias("score"), op.retry_batch(F.col("m"), F.lit(0.1)).alias("batch"))


@query("SELECT coalesce(p_partkey, l_partkey) AS id, round(coalesce(c * 0.85 + s * 0.15, c, s), 6) AS consensus FROM (SELECT p_partkey, p_size / 50 AS c FROM part WHERE p_size > 10) FULL JOIN (SELECT l_partkey, avg(l_discount) * 10 AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def consensus_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size > 10").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("consensus"))
    seen = table(spark, sf_dir, "lineitem", "l_partkey", "l_discount", "l_quantity").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg((F.avg("l_discount") * 10).alias("score"))
    return op.consensus_update(nodes, seen).select("id", F.round("consensus", 6).alias("consensus"))


@query("SELECT event_id // 4 AS file, bool_and(value > 1 AND event_type <> 'error') AS safe FROM events GROUP BY 1")
def structural_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "value")  # four events are the edits of a file
    return op.structural_only(ev.select(F.floor(F.col("event_id") / 4).alias("file"), (F.col("value") > 1).alias("structural"), (F.col("event_type") == "error").alias("rewrite")))


@query("SELECT user_id AS file, arg_min(event_id, {'a': (event_type = 'error')::INT, 'b': floor(value / 10), 'c': -(event_id % 5), 'd': event_id}) AS parse FROM events GROUP BY user_id")
def best_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return op.best_parse(ev.select(F.col("user_id").alias("file"), F.col("event_id").alias("parse"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") / 10).alias("weight"), (F.col("event_id") % 5).alias("symbols")), "file")
