"""Queries that look up, merge and compare, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups as op
from ..session import table
from .registry import query

_DL = """de AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS line, l_partkey % 40 AS col, l_orderkey AS id FROM lineitem WHERE l_orderkey % 5 = 0),
re AS (SELECT DISTINCT l_suppkey AS file, l_linenumber + 3 AS line, l_partkey % 30 AS col, l_orderkey + l_linenumber % 2 AS id FROM lineitem WHERE l_orderkey % 7 = 0),
q AS (SELECT DISTINCT l_suppkey AS file, l_linenumber + (l_orderkey % 4)::INT AS line, l_partkey % 50 AS col FROM lineitem)"""


@query(
    f"""WITH {_DL}, n AS (SELECT q.*, id, row_number() OVER (PARTITION BY q.file, q.line, q.col ORDER BY abs(q.col - de.col), de.col, id) AS r FROM q JOIN de USING (file, line)),
    v AS (SELECT * FROM (SELECT file, line, col, min(id) AS via FROM re GROUP BY ALL) WHERE via IN (SELECT id FROM de))
    SELECT q.file, q.line, q.col, coalesce(n.id, via) AS id FROM q LEFT JOIN (SELECT file, line, col, id FROM n WHERE r = 1) n USING (file, line, col) LEFT JOIN v USING (file, line, col)"""
)
def declaration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    decls = li.where("l_orderkey % 5 = 0").selectExpr("l_suppkey AS file", "l_linenumber AS line", "l_partkey % 40 AS column", "l_orderkey AS id").distinct()
    refs = li.where("l_orderkey % 7 = 0").selectExpr("l_suppkey AS file", "l_linenumber + 3 AS line", "l_partkey % 30 AS column", "l_orderkey + l_linenumber % 2 AS id").distinct()
    places = li.selectExpr("l_suppkey AS file", "l_linenumber + int(l_orderkey % 4) AS line", "l_partkey % 50 AS column").distinct()
    return op.declaration_at(places, decls, refs, ["file"]).select("file", "line", F.col("column").alias("col"), "id")


_TG = "tg AS (SELECT s_suppkey AS path, 'src/' || (s_nationkey % 5) AS dir, repeat('u', (1 + s_suppkey % 3)::INT) || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE (s_suppkey % 17)::VARCHAR END AS stem, CASE WHEN s_suppkey % 3 = 0 THEN 'cc' ELSE 'cpp' END AS ext FROM supplier)"
_EN = "en AS (SELECT c_custkey AS path, 'src/' || (c_nationkey % 5) AS dir, repeat('u', (1 + c_custkey % 2)::INT) || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE (c_custkey % 170)::VARCHAR END AS stem, CASE WHEN c_custkey % 2 = 0 THEN 'cc' ELSE 'cpp' END AS ext, c_custkey % 40 AS args, '-Isrc/' || (c_custkey % 5) AS include FROM customer)"


@query(
    f"""WITH {_TG}, {_EN}, p AS (SELECT tg.path AS target, en.path AS path, args, CASE WHEN tg.dir = en.dir THEN 6 ELSE 0 END + CASE WHEN tg.ext = en.ext THEN 2 ELSE 0 END + CASE WHEN tg.stem = en.stem THEN 10 WHEN starts_with(en.stem, tg.stem) OR starts_with(tg.stem, en.stem) THEN 6 ELSE 0 END + CASE WHEN contains(include, tg.dir) THEN 1 ELSE 0 END AS score FROM tg, en),
    o AS (SELECT *, row_number() OVER (PARTITION BY target, args ORDER BY score DESC, path) AS f FROM p WHERE score >= 12), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, path) AS place FROM o WHERE f = 1)
    SELECT target, path, score::INT AS score, args, place::INT AS place FROM b WHERE place <= 6"""
)
def source_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").selectExpr(
        "s_suppkey AS path", "'src/' || (s_nationkey % 5) AS dir", "repeat('u', int(1 + s_suppkey % 3)) || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE string(s_suppkey % 17) END AS stem", "CASE WHEN s_suppkey % 3 = 0 THEN 'cc' ELSE 'cpp' END AS ext"
    )
    entries = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").selectExpr(
        "c_custkey AS path", "'src/' || (c_nationkey % 5) AS dir", "repeat('u', int(1 + c_custkey % 2)) || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE string(c_custkey % 170) END AS stem", "CASE WHEN c_custkey % 2 = 0 THEN 'cc' ELSE 'cpp' END AS ext",
        "c_custkey % 40 AS args", "'-Isrc/' || (c_custkey % 5) AS include",
    )
    return op.source_consensus(targets, entries)


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'exact' WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 3 > 0 THEN 'paired' WHEN o_custkey % 4 > 0 THEN 'header' ELSE 'none' END WHEN o_custkey % 5 > 0 THEN 'source' ELSE 'none' END AS kind FROM orders")
def context_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(k.alias("path"), op.context_kind(k % 5 == 0, k % 2 == 0, c % 3, c % 4, c % 5).alias("kind"))


_GU = """nd AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size / 50 END::DOUBLE AS consensus FROM part WHERE p_partkey % 3 > 0), me AS (SELECT id, 1::BIGINT AS n_refs, 1::BIGINT AS n_files, consensus AS score FROM nd WHERE id % 2 = 0),
eg AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'A' THEN 'contains' ELSE 'reference' END AS kind, 2::BIGINT AS weight, 5::BIGINT AS last_seen FROM lineitem WHERE l_linenumber = 1),
pa AS (SELECT s_suppkey AS file, s_suppkey % 3 <> 0 AS success FROM supplier WHERE s_suppkey % 4 <> 0), sy AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS id FROM lineitem JOIN pa ON file = l_suppkey WHERE l_linenumber = 2),
rf AS (SELECT l_suppkey AS file, l_partkey + 5 AS id, sum(greatest(l_quantity::BIGINT % 4, 1))::BIGINT AS n FROM lineitem JOIN pa ON file = l_suppkey WHERE l_linenumber = 3 GROUP BY 1, 2),
sn AS (SELECT id, file, CASE WHEN success THEN 1.0 ELSE 0.5 END::DOUBLE AS v, row_number() OVER (PARTITION BY id ORDER BY file) AS k FROM sy JOIN pa USING (file)), cnt AS (SELECT id, count(*) AS n FROM sn GROUP BY id)"""


def _ema(start: str, share: float) -> str:
    return f"""SELECT cnt.id, {start} AS c0, n, CASE WHEN {start} IS NULL OR {start} <= 0 THEN (SELECT sum(v * CASE WHEN k = 1 THEN power(1 - {share}, n - 1) ELSE {share} * power(1 - {share}, n - k) END) FROM sn WHERE sn.id = cnt.id)
      ELSE {start} * power(1 - {share}, n) + (SELECT sum(v * {share} * power(1 - {share}, n - k)) FROM sn WHERE sn.id = cnt.id) END AS x FROM cnt LEFT JOIN """


def _upsert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_partkey % 3 > 0").selectExpr("p_partkey AS id", "CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size / 50 END AS consensus")
    metrics = nodes.where("id % 2 = 0").selectExpr("id", "1L AS n_refs", "1L AS n_files", "consensus AS score")
    edges = li.where("l_linenumber = 1").selectExpr("l_suppkey AS src", "l_partkey AS dst", "CASE WHEN l_returnflag = 'A' THEN 'contains' ELSE 'reference' END AS kind", "2L AS weight", "5L AS last_seen").distinct()
    parses = table(spark, sf_dir, "supplier", "s_suppkey").where("s_suppkey % 4 <> 0").selectExpr("s_suppkey AS file", "s_suppkey % 3 <> 0 AS success")
    mine = li.join(parses.select(F.col("file").alias("l_suppkey")), "l_suppkey", "left_semi")
    symbols = mine.where("l_linenumber = 2").selectExpr("l_suppkey AS file", "l_partkey AS id")
    references = mine.where("l_linenumber = 3").selectExpr("l_suppkey AS file", "l_partkey + 5 AS id", "bigint(l_quantity) % 4 AS n")
    return op.graph_upsert(nodes, metrics, edges, parses, symbols, references, 9)


@query(
    f"""WITH {_GU}, em AS ({_ema('nd.consensus', 0.15)} nd ON nd.id = cnt.id)
    SELECT id, round(consensus, 9) AS consensus FROM (SELECT id, x AS consensus FROM em UNION ALL SELECT id, consensus FROM nd WHERE id NOT IN (SELECT id FROM cnt)
    UNION ALL SELECT DISTINCT id, (SELECT CASE WHEN arg_max(success, file) THEN 1.0 ELSE 0.5 END FROM pa)::DOUBLE FROM rf WHERE id NOT IN (SELECT id FROM nd) AND id NOT IN (SELECT id FROM cnt))"""
)
def upserted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir)[0].select("id", F.round("consensus", 9).alias("consensus"))


@query(
    f"""WITH {_GU}, em AS ({_ema('me.score', 0.10)} me ON me.id = cnt.id), af AS (SELECT dst AS id FROM eg WHERE src IN (SELECT file FROM pa) UNION SELECT id FROM sy UNION SELECT id FROM rf),
    ne AS (SELECT src, dst, kind, weight FROM eg WHERE src NOT IN (SELECT file FROM pa) UNION ALL SELECT file, id, 'contains', 1 FROM sy UNION ALL SELECT file, id, 'reference', n FROM rf),
    c AS (SELECT dst AS id, count(*) FILTER (kind = 'contains') AS f, coalesce(sum(weight) FILTER (kind = 'reference'), 0)::BIGINT AS r FROM ne GROUP BY dst)
    SELECT id, CASE WHEN af.id IS NULL THEN me.n_refs WHEN coalesce(r, 0) = 0 AND cnt.n IS NOT NULL THEN 1 ELSE coalesce(r, 0) END AS n_refs, CASE WHEN af.id IS NULL THEN me.n_files ELSE coalesce(f, 0) END AS n_files, round(CASE WHEN cnt.n IS NULL THEN coalesce(score, 0) ELSE x END, 9)::DOUBLE AS score
    FROM me FULL JOIN af USING (id) LEFT JOIN c USING (id) LEFT JOIN cnt USING (id) LEFT JOIN em USING (id)"""
)
def upserted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir)[1].select("id", "n_refs", "n_files", F.round("score", 9).alias("score"))


@query(f"WITH {_GU} SELECT src, dst, kind, weight, last_seen FROM eg WHERE src NOT IN (SELECT file FROM pa) UNION ALL SELECT file, id, 'contains', 1, 9 FROM sy UNION ALL SELECT file, id, 'reference', n, 9 FROM rf")
def upserted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir)[2]


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R') SELECT src, dst FROM e WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9) EXCEPT SELECT src, dst FROM n")
def removed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag").selectExpr("l_suppkey AS src", "l_partkey AS dst", "l_returnflag AS kind")
    files = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").where("s_nationkey < 9").select(F.col("s_suppkey").alias("src"))
    return op.removed_targets(li, files, li.where("kind = 'R'"), "A")


@query("SELECT event_id AS id, event_type AS policy, value, 0 AS stage FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, NULL, 1 FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, value, 2 FROM events WHERE value > 60")
def stage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "value").withColumnsRenamed({"event_id": "id", "event_type": "policy"})
    return op.accumulated([ev.where("policy = 'view'"), ev.where("policy = 'error'").drop("value"), ev.where("value > 60")])


_SN = "sn AS (SELECT user_id AS policy, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (value > 50) AS blocked, max(value) AS drift, max(event_id) AS latest FROM events {} GROUP BY 1)"


@query(
    f"""WITH a AS (WITH {_SN.format("WHERE event_id % 3 = 0")} SELECT * FROM sn), b AS (WITH {_SN.format("WHERE event_id % 3 < 2 AND user_id % 4 > 0")} SELECT * FROM sn)
    SELECT * FROM (SELECT b.policy, greatest(b.runs - coalesce(a.runs, 0), 0) AS runs, greatest(b.failures - coalesce(a.failures, 0), 0) AS failures, greatest(b.blocked - coalesce(a.blocked, 0), 0) AS blocked,
      CASE WHEN b.drift > coalesce(a.drift, 0) THEN b.drift ELSE 0 END AS drift, b.latest FROM b LEFT JOIN a USING (policy)) WHERE runs > 0 OR failures > 0 OR blocked > 0"""
)
def telemetry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    shot = lambda d: d.groupBy(F.col("user_id").alias("policy")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("value") > 50).alias("blocked"), F.max("value").alias("drift"), F.max("event_id").alias("latest"))
    return op.counter_diff(shot(ev.where("event_id % 3 = 0")), shot(ev.where("event_id % 3 < 2 AND user_id % 4 > 0")), ["policy"], ["runs", "failures", "blocked"], ["latest"], ["drift"])


_RT = "SELECT event_type AS strategy, user_id % 7 AS context, count(*) AS attempts, count(*) FILTER (value > 30) AS successes FROM events {} GROUP BY 1, 2"


@query(_RT.format(""))
def retry_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.retry_sums(_retries(spark, sf_dir), ["strategy", "context"])


def _retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").selectExpr("event_id", "event_type AS strategy", "user_id % 7 AS context", "value > 30 AS success")


@query(f"WITH a AS ({_RT.format('WHERE event_id % 2 = 0')}), b AS ({_RT.format('WHERE event_id % 3 > 0')}) SELECT * FROM (SELECT strategy, context, greatest(b.attempts - coalesce(a.attempts, 0), 0) AS attempts, greatest(b.successes - coalesce(a.successes, 0), 0) AS successes FROM b LEFT JOIN a USING (strategy, context)) WHERE attempts > 0 OR successes > 0")
def retry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _retries(spark, sf_dir), ["strategy", "context"]
    return op.counter_diff(op.retry_sums(rows.where("event_id % 2 = 0"), keys), op.retry_sums(rows.where("event_id % 3 > 0"), keys), keys, ["attempts", "successes"])


@query(
    """WITH s AS (SELECT l_suppkey AS policy, l_linenumber AS shard, count(*) FILTER (l_returnflag = 'A') AS n, least(avg(l_discount) * 10, 1) AS estimate, avg(l_tax) AS variance FROM lineitem WHERE l_suppkey % 5 > 0 OR l_returnflag <> 'A' GROUP BY 1, 2)
    SELECT policy, round(CASE WHEN sum(n) = 0 THEN 0.5 ELSE sum(n * estimate) / sum(n) END, 9)::DOUBLE AS estimate, round(CASE WHEN sum(n) = 0 THEN 0.1 ELSE greatest(sum(n * variance) / sum(n), 1e-12) END, 9)::DOUBLE AS variance, sum(n)::BIGINT AS n FROM s GROUP BY policy"""
)
def scalar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax").where("l_suppkey % 5 > 0 OR l_returnflag <> 'A'")
    shards = li.groupBy(F.col("l_suppkey").alias("policy"), "l_linenumber").agg(F.count_if(F.col("l_returnflag") == "A").alias("n"), F.least(F.avg("l_discount") * 10, F.lit(1.0)).alias("estimate"), F.avg("l_tax").alias("variance"))
    return op.scalar_merge(shards, ["policy"]).select("policy", F.round("estimate", 9).alias("estimate"), F.round("variance", 9).alias("variance"), "n")


@query(
    """WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 50) FILTER (l_linenumber <= 2) AS x, list(DISTINCT l_suppkey) FILTER (l_linenumber > 2) AS y FROM lineitem GROUP BY 1)
    SELECT k, len(list_intersect(coalesce(x, []), coalesce(y, []))) > 0 AS touches, list_sort(list_intersect(coalesce(x, []), coalesce(y, []))) AS shared FROM a"""
)
def set_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    x, y = F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey") % 50)), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")))
    found = li.groupBy(F.col("l_orderkey").alias("k")).agg(x.alias("x"), y.alias("y")).select("k", op.overlap(F.col("x"), F.col("y")).alias("o"))
    return found.select("k", F.col("o.any").alias("touches"), F.col("o.shared").alias("shared"))


@query(
    """WITH f AS (SELECT p_brand AS policy, p_size % 4 AS file_kind, avg(p_retailprice) / 1000 AS m FROM part GROUP BY 1, 2), b AS (SELECT p_brand AS policy, p_size % 5 AS block_kind, avg(p_size) / 20 AS m FROM part WHERE p_size % 5 < 3 GROUP BY 1, 2), q AS (SELECT DISTINCT p_brand AS policy, p_size % 6 AS file_kind, p_partkey % 5 AS block_kind FROM part)
    SELECT q.policy, q.file_kind, q.block_kind, round(coalesce(f.m, 1) * coalesce(b.m, 1), 9) AS modifier FROM q LEFT JOIN f ON f.policy = q.policy AND f.file_kind = q.file_kind LEFT JOIN b ON b.policy = q.policy AND b.block_kind = q.block_kind"""
)
def modifier_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").withColumnRenamed("p_brand", "policy")
    files = p.groupBy("policy", F.expr("p_size % 4 AS file_kind")).agg((F.avg("p_retailprice") / 1000).alias("modifier"))
    blocks = p.where("p_size % 5 < 3").groupBy("policy", F.expr("p_size % 5 AS block_kind").cast("bigint").alias("block_kind")).agg((F.avg("p_size") / 20).alias("modifier"))
    asked = p.selectExpr("policy", "p_size % 6 AS file_kind", "p_partkey % 5 AS block_kind").distinct()
    return op.modifiers(asked, files, blocks).withColumn("modifier", F.round("modifier", 9))


_RD = "SELECT DISTINCT l_suppkey AS file, l_linenumber AS kind, l_partkey % 90 AS s, l_partkey % 90 + l_orderkey % 6 AS e FROM lineitem WHERE {}"


@query(
    f"""WITH b AS ({_RD.format("l_returnflag <> 'N'")}), a AS ({_RD.format("l_returnflag <> 'A'")}), m AS ((SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM b)), ed AS (SELECT DISTINCT user_id AS file, event_id % 100 AS line FROM events WHERE event_type = 'error'),
    n AS (SELECT m.*, EXISTS (SELECT 1 FROM ed WHERE ed.file = m.file AND line BETWEEN s - 2 AND e + 2) AS near FROM m) SELECT file, count(*) FILTER (near) AS local, count(*) FILTER (NOT near) AS remote FROM n GROUP BY file"""
)
def range_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").selectExpr("l_suppkey AS file", "l_linenumber AS kind", "l_partkey % 90 AS s", "l_partkey % 90 + l_orderkey % 6 AS e", "l_returnflag")
    edited = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").where("event_type = 'error'").selectExpr("user_id AS file", "event_id % 100 AS line")
    return op.range_drift(li.where("l_returnflag <> 'N'"), li.where("l_returnflag <> 'A'"), edited, ["file"], 2)


@query(
    """WITH g AS (SELECT DISTINCT o_custkey % 100 AS file, o_orderkey AS id, o_orderkey % 60 AS line, o_custkey % 4 AS kind, o_orderkey % 5 AS n FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey % 100 AS file, o_orderkey + o_custkey % 2 AS id, o_orderkey % 61 AS line, o_custkey % 3 AS kind, o_orderkey % 3 AS n FROM orders WHERE o_orderstatus <> 'P'),
    c AS (SELECT *, count(*) OVER (PARTITION BY file, line, kind) AS alone FROM a)
    SELECT DISTINCT g.file, g.id FROM g JOIN c ON g.file = c.file AND abs(g.line - c.line) <= 2 WHERE g.line > 0 AND (g.id = c.id OR (g.kind = c.kind AND (alone = 1 OR g.n = 0 OR c.n >= g.n - 1)))"""
)
def migrated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    gone = o.where("o_orderstatus = 'F'").selectExpr("o_custkey % 100 AS file", "o_orderkey AS id", "o_orderkey % 60 AS line", "o_custkey % 4 AS kind", "o_orderkey % 5 AS n_refs").distinct()
    after = o.where("o_orderstatus <> 'P'").selectExpr("o_custkey % 100 AS file", "o_orderkey + o_custkey % 2 AS id", "o_orderkey % 61 AS line", "o_custkey % 3 AS kind", "o_orderkey % 3 AS n_refs").distinct()
    return op.migrated_locally(gone, after, ["file"], 2)


@query(
    """SELECT event_id, event_id % 7 NOT IN (0, 3) AND CASE event_id % 4 WHEN 0 THEN event_id % 11 <= 8 AND value <= 48 AND user_id % 3 > 0 WHEN 1 THEN event_id % 11 <= 1 AND value <= 10 AND user_id % 3 > 0 AND event_id % 5 > 0 ELSE false END AS relaxed FROM events"""
)
def relaxed_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kinds = F.when(i % 7 == 0, F.array(F.lit("scope"))).when(i % 7 == 3, F.array(F.lit("diagnostics"), F.lit("identity"))).otherwise(F.array(F.lit("diagnostics")))
    context = F.element_at(F.array(*map(F.lit, ("paired", "source", "exact", "none"))), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events", "event_id", "user_id", "value").select("event_id", op.relaxes(kinds, context, F.col("user_id") % 3, i % 11, F.col("value"), i % 5 == 0).alias("relaxed"))


@query(
    """WITH ed AS (SELECT user_id AS file, event_id % 40 AS line, event_type AS policy FROM events), li AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 40 AS line, l_suppkey % 2 = 0 AS back FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
    de AS (SELECT DISTINCT l_suppkey AS file, l_orderkey % 300 AS id, l_partkey % 40 AS line FROM lineitem WHERE l_linenumber = 2), rf AS (SELECT l_suppkey AS file, l_orderkey % 300 AS id, min(l_partkey % 40) AS first FROM lineitem WHERE l_linenumber = 3 GROUP BY 1, 2),
    th AS (SELECT DISTINCT d.file, d.line FROM li JOIN de x ON x.file = li.file AND x.line = li.line JOIN de d ON d.file = x.file AND d.id = x.id WHERE back UNION SELECT d.file, d.line FROM li JOIN rf ON rf.file = li.file AND first = li.line JOIN de d ON d.file = rf.file AND d.id = rf.id WHERE back)
    SELECT DISTINCT file, policy FROM ed JOIN (SELECT file, line FROM li UNION SELECT file, line FROM th) USING (file, line) WHERE line > 0"""
)
def culprit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    edits = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr("user_id AS file", "event_id % 40 AS line", "event_type AS policy")
    lines = li.where("l_returnflag = 'R' AND l_linenumber = 1").selectExpr("l_suppkey AS file", "l_partkey % 40 AS line", "l_suppkey % 2 = 0 AS backtrack").distinct()
    decls = li.where("l_linenumber = 2").selectExpr("l_suppkey AS file", "l_orderkey % 300 AS id", "l_partkey % 40 AS line").distinct()
    refs = li.where("l_linenumber = 3").groupBy(F.col("l_suppkey").alias("file"), F.expr("l_orderkey % 300 AS id")).agg(F.min(F.expr("l_partkey % 40")).alias("first"))
    return op.culprits(edits, lines, decls, refs, ["file"])


@query(
    """WITH h AS (SELECT p_brand AS file, p_size AS name, p_partkey AS place, p_partkey % 3 AS access, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0), z AS (SELECT file, name, arg_max(access, place) AS z FROM h GROUP BY 1, 2),
    b AS (SELECT p_brand AS file, p_size AS name, -p_partkey AS start, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY -p_partkey) AS k FROM part),
    j AS (SELECT b.file, b.name, b.start, place, coalesce(h.access, z) AS access FROM b JOIN z USING (file, name) LEFT JOIN h ON h.file = b.file AND h.name = b.name AND h.k = b.k),
    o AS (SELECT *, row_number() OVER w AS position, coalesce(lag(access) OVER w <> access, true) AS section FROM j WINDOW w AS (PARTITION BY file ORDER BY place NULLS LAST, start)) SELECT file, name, start, access, position::INT AS position, section FROM o"""
)
def header_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    header = p.where("p_partkey % 2 = 0").selectExpr("p_brand AS file", "p_size AS name", "p_partkey AS place", "p_partkey % 3 AS access")
    return op.header_order(p.selectExpr("p_brand AS file", "p_size AS name", "-p_partkey AS start"), header, ["file"])


_FL = "SELECT p_partkey AS path, CASE p_partkey % 5 WHEN 0 THEN 'a/src/x' WHEN 1 THEN 'a/include/x' WHEN 2 THEN 'a/inc/x' WHEN 3 THEN 'b' ELSE 'a/Source/x' END AS dir, 's' || p_size AS stem, p_partkey % 2 = 0 AS header, ['.h', '.hpp', '.cc'][1 + (p_partkey % 3)::INT] AS ext FROM part"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr(
        "p_partkey AS path", "CASE p_partkey % 5 WHEN 0 THEN 'a/src/x' WHEN 1 THEN 'a/include/x' WHEN 2 THEN 'a/inc/x' WHEN 3 THEN 'b' ELSE 'a/Source/x' END AS dir", "'s' || p_size AS stem", "p_partkey % 2 = 0 AS header", "element_at(array('.h', '.hpp', '.cc'), int(1 + p_partkey % 3)) AS ext"
    )


@query(
    f"""WITH f AS ({_FL}), t AS (SELECT path, stem, header, dir AS d FROM f UNION SELECT path, stem, header, unnest(CASE WHEN dir IN ('a/src/x', 'a/Source/x') THEN ['a/include/x', 'a/inc/x'] WHEN dir IN ('a/include/x', 'a/inc/x') THEN ['a/src/x', 'a/source/x'] ELSE [] END) FROM f)
    SELECT DISTINCT t.path, f.path AS companion FROM t JOIN f ON f.dir = t.d AND f.stem = t.stem WHERE f.header <> t.header"""
)
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return op.companions(files, files)


@query(
    f"""WITH f AS ({_FL}), q AS (SELECT path AS source, stem, unnest([{{'i': 0, 'd': dir, 'e': '.h'}}, {{'i': 1, 'd': dir, 'e': '.hpp'}}, {{'i': 2, 'd': 'a/inc/x', 'e': '.h'}}, {{'i': 3, 'd': 'a/inc/x', 'e': '.hpp'}}, {{'i': 4, 'd': 'b', 'e': '.h'}}, {{'i': 5, 'd': 'b', 'e': '.hpp'}}]) AS x FROM f WHERE ext = '.cc'),
    l AS (SELECT dir, stem, ext, min(path) AS path FROM f GROUP BY 1, 2, 3) SELECT source, arg_min(l.path, x.i) AS header FROM q JOIN l ON l.dir = x.d AND l.ext = x.e AND l.stem = q.stem GROUP BY source"""
)
def first_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    listing = files.groupBy("dir", "stem", "ext").agg(F.min("path").alias("path"))  # a path of its own for each place
    return op.first_companion(files.where("ext = '.cc'"), listing, ["a/inc/x", "b"], [".h", ".hpp"])


@query("SELECT user_id AS file, bit_xor(('0x' || substr(md5(concat_ws(':', event_id, event_type)), 1, 15))::BIGINT) AS signature FROM events GROUP BY user_id")
def order_free_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumnRenamed("user_id", "file")
    return op.signature(ev, ["file"], ["event_id", "event_type"])


@query("SELECT *, row_number() OVER (PARTITION BY file ORDER BY off, id)::INT AS place FROM (SELECT DISTINCT l_suppkey AS file, l_partkey % 70 AS off, l_orderkey % 90 AS id FROM lineitem)")
def symbol_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").selectExpr("l_suppkey AS file", "l_partkey % 70 AS off", "l_orderkey % 90 AS id")
    return op.unique_at(li, ["file"], ["off", "id"])


@query("SELECT doc_id AS path, n_chars AS size, CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN 'f' || doc_id END AS features FROM documents")
def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars").selectExpr("doc_id AS path", "n_chars AS size", "doc_id % 3 AS mtime")
    cache = docs.where("path % 4 > 0").selectExpr("path", "size", "CASE WHEN path % 3 = 0 THEN 7L ELSE mtime END AS mtime", "'f' || path AS features")
    known, rest = op.changed_features(docs, cache)
    return known.unionByName(rest, allowMissingColumns=True).select("path", "size", "features")


@query("SELECT p_brand AS run, p_partkey AS policy, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::INT AS position FROM part WHERE p_partkey % 4 > 0")
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    found = op.registry_order(p.selectExpr("p_brand AS run", "p_partkey AS policy", "struct(p_size, p_partkey) AS place"), p.selectExpr("p_partkey AS policy", "p_partkey % 4 > 0 AS enabled"))
    return found.select("run", "policy", "position")


@query("SELECT conv_id * 1000 + turn AS path, octet_length(encode(text))::BIGINT AS size, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, (turn * 3 * 1000000)::BIGINT AS wall_ns, (turn % 2 * 1000000)::BIGINT AS penalty_ns, role = 'user' AS error FROM conversations")
def file_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.observations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").selectExpr("conv_id * 1000 + turn AS path", "text", "turn * 3 AS ms", "turn % 2 AS retries", "CASE WHEN role = 'user' THEN 'failed' END AS error"))


@query(
    """WITH b AS (SELECT c_nationkey AS run, avg(c_acctbal) / 10000 AS precision, max(c_acctbal) / 10000 AS recall, min(c_acctbal) / 10000 AS match_ratio, count(*) AS samples FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1), g AS (SELECT s_nationkey AS run, avg(s_acctbal) / 10000 AS precision, max(s_acctbal) / 10000 AS recall, min(s_acctbal) / 10000 AS match_ratio, count(*) AS samples FROM supplier GROUP BY 1)
    SELECT run, round(coalesce(b.precision, g.precision), 9) AS precision, coalesce(b.recall, g.recall) AS recall, coalesce(b.match_ratio, g.match_ratio) AS match_ratio, coalesce(b.samples, g.samples) AS samples, CASE WHEN b.run IS NULL THEN 'gate' ELSE 'benchmark' END AS source FROM b FULL JOIN g USING (run)"""
)
def accuracy_finalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    def means(d: DataFrame, k: str, v: str) -> DataFrame:
        return d.groupBy(F.col(k).alias("run")).agg((F.avg(v) / 10000).alias("precision"), (F.max(v) / 10000).alias("recall"), (F.min(v) / 10000).alias("match_ratio"), F.count("*").alias("samples"))

    c = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").where("c_nationkey % 3 > 0")
    found = op.finalized(means(c, "c_nationkey", "c_acctbal"), means(table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal"))
    return found.withColumn("precision", F.round("precision", 9))


@query("SELECT event_type AS strategy, user_id % 7 AS context, count(*) AS attempts, count(*) FILTER (value > 30) AS successes FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2")
def seeded_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _retries(spark, sf_dir), ["strategy", "context"]
    return op.seeded(op.retry_sums(rows.where("event_id < 0"), keys), op.retry_sums(rows.where("event_id % 2 = 1"), keys))


@query(
    f"""WITH b AS ({_RD.format("l_returnflag <> 'N'")}), a AS ({_RD.format("l_returnflag <> 'A'")}), n AS (SELECT file, count(*) AS n FROM b GROUP BY file),
    c AS (SELECT file, sum(abs(x - y))::BIGINT AS drift FROM (SELECT file, kind, count(*) FILTER (w) AS x, count(*) FILTER (NOT w) AS y FROM (SELECT file, kind, true AS w FROM b UNION ALL SELECT file, kind, false FROM a) GROUP BY 1, 2) GROUP BY 1),
    m AS ((SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM b)), ed AS (SELECT DISTINCT user_id AS file, event_id % 100 AS line FROM events WHERE event_type = 'error'),
    r AS (SELECT file, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ed WHERE ed.file = m.file AND line BETWEEN s - 1 AND e + 1)) AS remote FROM m GROUP BY file)
    SELECT file, round(least((coalesce(drift, 0) + coalesce(remote, 0)) / n, 1), 9)::DOUBLE AS severity, coalesce(drift, 0) > 40 OR coalesce(remote, 0) > 40 AS regressed, CASE WHEN coalesce(drift, 0) > 40 OR coalesce(remote, 0) > 40 THEN 80 ELSE 0 END AS penalty FROM n LEFT JOIN c USING (file) LEFT JOIN r USING (file)"""
)
def scope_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import scope_drift

    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").selectExpr("l_suppkey AS file", "l_linenumber AS kind", "l_partkey % 90 AS s", "l_partkey % 90 + l_orderkey % 6 AS e", "l_returnflag")
    before, after = (li.where(f"l_returnflag <> '{x}'").drop("l_returnflag").distinct() for x in "NA")
    edited = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").where("event_type = 'error'").selectExpr("user_id AS file", "event_id % 100 AS line")
    ranges = op.range_drift(before, after, edited, ["file"], 1)
    found = op.scope_integrity(before.groupBy("file").agg(F.count("*").alias("n")), ranges, scope_drift(before, after, ["file"], "kind"), ["file"], 40, 80)
    return found.withColumn("severity", F.round("severity", 9))


@query(
    """WITH r AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 90 AS s, l_partkey % 90 + l_orderkey % 6 AS e FROM lineitem WHERE l_linenumber = 4), ed AS (SELECT DISTINCT user_id AS file, event_id % 100 AS line FROM events)
    SELECT file, list_sort(list(line)) AS lines FROM ed WHERE EXISTS (SELECT 1 FROM r WHERE r.file = ed.file AND line BETWEEN s AND e) GROUP BY file"""
)
def macro_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").where("l_linenumber = 4").selectExpr("l_suppkey AS file", "l_partkey % 90 AS s", "l_partkey % 90 + l_orderkey % 6 AS e")
    return op.macro_touches(table(spark, sf_dir, "events", "event_id", "user_id").selectExpr("user_id AS file", "event_id % 100 AS line"), ranges, ["file"])


@query("SELECT user_id AS file, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS ratio, count(*) FILTER (event_type = 'error') AS errors, coalesce(list_sort(list(DISTINCT event_id % 100) FILTER (event_type = 'error')), []) AS lines FROM events GROUP BY user_id")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr("user_id AS file", "event_id % 100 AS line", "event_type = 'error' AS bad")
    return op.error_stats(nodes, ["file"]).withColumn("ratio", F.round("ratio", 9))


@query("SELECT conv_id * 1000 + turn AS path, text, CASE WHEN turn % 2 = 0 THEN role END AS error, turn % 3 = 0 AS changed FROM conversations")
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").selectExpr("conv_id * 1000 + turn AS path", "text", "CASE WHEN turn % 2 = 0 THEN role END AS error", "turn % 3 = 0 AS changed")
    return op.from_cache(op.to_cache(results, "f1"), results.schema)


@query(
    """WITH l AS (SELECT p_partkey AS line_no, p_brand AS doc, p_name || ' + ' || p_name || ';' AS line, p_name, p_size FROM part)
    SELECT doc, line_no, CASE p_size % 3 WHEN 0 THEN 'renamed + renamed;' WHEN 1 THEN p_name || ' + renamed;' ELSE line END AS line FROM l"""
)
def renamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_size")
    lines = p.selectExpr("p_brand AS doc", "p_partkey AS line_no", "p_name || ' + ' || p_name || ';' AS line")
    second = p.where("p_size % 3 < 2").selectExpr("p_brand AS doc", "p_partkey AS line_no", "length(p_name) + 4 AS column", "p_name AS old", "'renamed' AS new")
    first = p.where("p_size % 3 = 0").selectExpr("p_brand AS doc", "p_partkey AS line_no", "1 AS column", "p_name AS old", "'renamed' AS new")
    wrong = p.where("p_size % 3 = 2").selectExpr("p_brand AS doc", "p_partkey AS line_no", "2 AS column", "p_name AS old", "'renamed' AS new")
    return op.renamed(lines, first.unionByName(second).unionByName(wrong), ["doc"])
