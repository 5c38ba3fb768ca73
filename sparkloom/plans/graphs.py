"""Graph queries over ``lineitem``: an order is a file, a part a symbol, the ship date the time last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs as op
from ..operators.lineage import cut
from ..session import table
from .registry import query

NOW, RETENTION = 20020101, 20000
_E = """raw AS (SELECT 'f' || l_orderkey AS src, 's' || l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'reference' ELSE 'contains' END AS kind,
  (l_quantity / 10)::BIGINT AS weight, (year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate))::BIGINT AS last_seen FROM lineitem),
e AS (SELECT src, dst, kind, sum(greatest(weight, 1))::BIGINT AS weight, max(last_seen) AS last_seen FROM raw GROUP BY ALL),
nodes AS (SELECT id, id[1] = 'f' AS is_file, max(last_seen) AS last_seen FROM (SELECT src AS id, last_seen FROM e UNION ALL SELECT dst, last_seen FROM e) GROUP BY id)"""
_M = """m AS (SELECT dst AS id, greatest(coalesce(sum(weight) FILTER (kind = 'reference'), 0), 1)::BIGINT AS n_refs, count(*) FILTER (kind = 'contains') AS n_files,
  (substring(dst, 2)::BIGINT % 100) / 100 AS consensus FROM e GROUP BY dst)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    return li.select(
        F.concat(F.lit("f"), F.col("l_orderkey")).alias("src"),
        F.concat(F.lit("s"), F.col("l_partkey")).alias("dst"),
        F.when(F.col("l_linenumber") % 2 == 0, "reference").otherwise("contains").alias("kind"),
        F.bround(F.col("l_quantity") / 10).cast("bigint").alias("weight"),
        (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.day("l_shipdate")).cast("bigint").alias("last_seen"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.upsert(raw(spark, sf_dir))


def nodes(e: DataFrame) -> DataFrame:
    both = e.select(F.col("src").alias("id"), "last_seen").unionAll(e.select("dst", "last_seen"))
    return both.groupBy("id").agg(F.max("last_seen").alias("last_seen")).withColumn("is_file", F.col("id").startswith("f"))


def metrics(e: DataFrame) -> DataFrame:
    return op.reference_counts(e).withColumn("consensus", F.substring("id", 2, 20).cast("bigint") % 100 / 100)


@query(f"WITH {_E} SELECT * FROM e")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"WITH {_E}, {_M} SELECT id, n_refs, n_files FROM m")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reference_counts(edges(spark, sf_dir))


@query(f"WITH {_E}, {_M} SELECT m.id, coalesce(c.n, 0) AS n_files FROM m LEFT JOIN (SELECT dst, count(*) AS n FROM e WHERE kind = 'contains' AND weight > 3 GROUP BY dst) c ON c.dst = m.id")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return op.file_counts(metrics(e), e.where("weight > 3")).select("id", "n_files")


_P = f"""pe AS (SELECT * FROM e WHERE last_seen >= {NOW - RETENTION}),
pn AS (SELECT * FROM nodes WHERE last_seen >= {NOW - RETENTION} OR id IN (SELECT src FROM pe UNION SELECT dst FROM pe))"""


@query(f"WITH {_E}, {_P} SELECT id, is_file, last_seen FROM pn")
def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return op.prune_stale(nodes(e), e, NOW - RETENTION)[0].select("id", "is_file", "last_seen")


@query(f"WITH {_E} SELECT * FROM e ORDER BY last_seen DESC, weight DESC, src, dst, kind LIMIT 500")
def cap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cap_edges(edges(spark, sf_dir), 500)


_CN = f"""ce AS (SELECT * FROM pe ORDER BY last_seen DESC, weight DESC, src, dst, kind LIMIT 2000),
gone AS (SELECT id FROM (SELECT id, last_seen, CASE WHEN id NOT IN (SELECT src FROM ce UNION SELECT dst FROM ce) THEN 0 WHEN NOT is_file THEN 1 ELSE 2 END AS tier FROM pn)
  ORDER BY tier, last_seen, id LIMIT (SELECT greatest(count(*) - 11000, 0) FROM pn)),
cn AS (SELECT * FROM pn WHERE id NOT IN (SELECT id FROM gone))"""


@query(f"WITH {_E}, {_P}, {_CN} SELECT id, is_file, last_seen FROM cn")
def cap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each step's tables are read several times by the next ones, so they are cut
    e = cut(edges(spark, sf_dir))
    n, kept = op.prune_stale(cut(nodes(e)), e, NOW - RETENTION)
    kept = cut(kept)
    n = cut(n)
    return op.cap_nodes(n, cut(op.cap_edges(kept, 2000)), 11000).select("id", "is_file", "last_seen")


@query(f"WITH {_E}, {_M}, {_P}, {_CN} SELECT m.id, n_refs, n_files, {NOW}::BIGINT AS removed FROM m WHERE id NOT IN (SELECT id FROM cn)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return op.compact(nodes(e), e, metrics(e), NOW, RETENTION, 11000, 2000)[3].select("id", "n_refs", "n_files", "removed")


@query(
    f"""WITH {_E}, {_M}, {_P}, {_CN}, fe AS (SELECT * FROM ce WHERE src IN (SELECT id FROM cn) AND dst IN (SELECT id FROM cn))
    SELECT m.id, n_refs, coalesce(c.n, 0) AS n_files FROM m LEFT JOIN (SELECT dst, count(*) AS n FROM fe WHERE kind = 'contains' GROUP BY dst) c ON c.dst = m.id WHERE m.id IN (SELECT id FROM cn)"""
)
def graph_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return op.compact(nodes(e), e, metrics(e), NOW, RETENTION, 11000, 2000)[2].select("id", "n_refs", "n_files")


@query(f"WITH {_E}, {_P} SELECT (SELECT count(*) FROM pn) AS n_nodes, (SELECT count(*) FROM pe) AS n_edges, (SELECT count(*) FROM pn WHERE is_file) AS n_files")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    n, kept = op.prune_stale(nodes(e), e, NOW - RETENTION)
    return n.agg(F.count("*").alias("n_nodes"), F.count_if("is_file").alias("n_files")).crossJoin(kept.agg(F.count("*").alias("n_edges")))  # one row and one row


def _held(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


_L = f"""l AS (SELECT src, dst, max(greatest(weight, 1)) AS weight FROM e GROUP BY src, dst), fan AS (SELECT dst, count(*) AS fanout FROM l GROUP BY dst),
q AS (SELECT dst, fanout, CASE WHEN consensus IS NULL THEN {_held('1 / sqrt(greatest(fanout, 1))', 0.08, 0.6)} ELSE
  {_held(f"{_held('0.35 + consensus * 0.65', 0.2, 1.0)} * {_held('ln(1 + n_refs) / 5', 0.25, 1.3)} * (0.35 + 0.65 * least({_held('1 / sqrt(greatest(n_files, 1))', 0.05, 1.0)}, {_held('1 / sqrt(greatest(fanout, 1))', 0.05, 1.0)}))", 0.05, 1.3)} END AS quality
  FROM fan LEFT JOIN m ON m.id = fan.dst)"""


def _hop(k: int, before: str, visited: str) -> str:
    return f"""s{k} AS (SELECT * FROM (SELECT src AS via, dst, score AS base, weight AS w1, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM l JOIN {before} b ON b.id = l.src) WHERE r <= 80),
o{k} AS (SELECT * FROM (SELECT src, dst, weight, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM l WHERE src NOT IN (SELECT id FROM {visited}) AND dst IN (SELECT dst FROM s{k})) WHERE r <= 60),
h{k} AS (SELECT o.src AS id, {k} AS hop, max(base + (w1 + weight) * 0.5 * quality * {_held('1 / sqrt(greatest(fanout, 1))', 0.06, 1.0)}) AS score
  FROM s{k} s JOIN o{k} o USING (dst) JOIN q USING (dst) GROUP BY o.src ORDER BY score DESC, id LIMIT 160)"""


@query(
    f"WITH {_E}, {_M}, {_L}, seeds AS (SELECT 'f' || o_orderkey AS id, 1.0::DOUBLE AS score FROM orders WHERE o_custkey = 1), {_hop(1, 'seeds', 'seeds')}, "
    f"v1 AS (SELECT id FROM seeds UNION SELECT id FROM h1), {_hop(2, 'h1', 'v1')} "
    "SELECT id, hop, round(score, 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY hop, score DESC, id LIMIT 20"
)
def impact_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    seeds = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").where("o_custkey = 1").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("id"))
    return op.impact(e, metrics(e), seeds, 2, 20).select("id", "hop", F.round("score", 6).alias("score"))


@query(f"WITH {_E}, {_M}, {_L} SELECT dst AS id, round(quality, 6) AS quality FROM q")
def neighbor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    fan = e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("fanout"))
    found = fan.join(metrics(e), "id", "left")
    return found.select("id", F.round(op.quality(F.col("consensus"), F.col("n_refs"), F.col("n_files"), F.col("fanout")), 6).alias("quality"))


@query(
    f"""WITH {_E}, al AS (SELECT 's' || p_partkey AS old, 's' || p_partkey // 10 AS new FROM part),
    mv AS (SELECT coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst, kind, weight, last_seen FROM e LEFT JOIN al a ON a.old = src LEFT JOIN al b ON b.old = dst)
    SELECT src, dst, kind, sum(greatest(weight, 1))::BIGINT AS weight, max(last_seen) AS last_seen FROM mv GROUP BY ALL"""
)
def alias_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "part", "p_partkey").selectExpr("concat('s', p_partkey) AS old", "concat('s', p_partkey div 10) AS new")
    return op.aliased(raw(spark, sf_dir), aliases)


@query(
    f"""WITH {_E} SELECT * FROM e WHERE NOT (kind = 'contains' AND src IN (SELECT 'f' || o_orderkey FROM orders WHERE o_orderstatus = 'F'))
    UNION ALL SELECT 'f' || o_orderkey, 's0', 'contains', 1::BIGINT, {NOW}::BIGINT FROM orders WHERE o_orderstatus = 'F'"""
)
def replace_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("src"))
    fresh = files.select("src", F.lit("s0").alias("dst"), F.lit("contains").alias("kind"), F.lit(1).cast("bigint").alias("weight"), F.lit(NOW).cast("bigint").alias("last_seen"))
    return op.replace_edges(edges(spark, sf_dir), files, fresh, "contains")


@query(f"WITH {_E} SELECT src AS id FROM e UNION SELECT dst FROM e")
def endpoint_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.endpoints(edges(spark, sf_dir))


@query(f"WITH {_E} SELECT * FROM e WHERE src IN (SELECT id FROM nodes WHERE last_seen > 19990101) AND dst IN (SELECT id FROM nodes WHERE last_seen > 20011101)")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    n = nodes(e)
    kept = n.where((F.col("is_file") & (F.col("last_seen") > 19990101)) | (~F.col("is_file") & (F.col("last_seen") > 20011101)))
    return op.without_orphans(e, kept)


_PAIR = "pr AS (SELECT c_nationkey AS loser, c_mktsegment AS winner, count(*) AS n, max(c_custkey) AS last_seen FROM customer GROUP BY ALL)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").groupBy(F.col("c_nationkey").alias("loser"), F.col("c_mktsegment").alias("winner")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("last_seen"))


@query(f"WITH {_PAIR} SELECT loser, winner, n FROM pr")
def pair_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("loser", "winner", "n")


@query(f"WITH {_PAIR} SELECT loser, winner, k AS n, 2000::BIGINT AS last_seen FROM (SELECT *, floor(n * pow(2.0, -(greatest(2000 - last_seen, 0) / 1000)) + 0.5)::BIGINT AS k FROM pr) WHERE k >= 3")
def pair_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.decayed(_pairs(spark, sf_dir), 2000, 1000, 3).select("loser", "winner", "n", "last_seen")


@query(f"WITH {_PAIR} SELECT loser || '|' || winner AS key, n FROM pr ORDER BY n DESC, key LIMIT 40")
def learning_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _pairs(spark, sf_dir).select(F.concat_ws("|", F.col("loser").cast("string"), "winner").alias("key"), "n")
    return op.top(keyed, "n", "key", 40)


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'usr|' || replace(p_name, '|', '%7C') WHEN p_partkey % 3 = 1 THEN 'scoped|' || p_size || '|' || p_brand || '|' || p_name
      ELSE 'bucket|' || p_size || '|' || p_name END AS id FROM part"""
)
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey") % 3
    return p.select("p_partkey", op.symbol_id(F.when(k == 0, F.col("p_name")), F.when(k == 1, F.col("p_brand")), F.col("p_size").cast("string"), F.col("p_name")).alias("id"))


@query("SELECT loser, winner FROM (SELECT split_part(key, '|', 1) AS a, split_part(key, '|', 2) AS winner, TRY_CAST(split_part(key, '|', 1) AS INT) AS loser FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE c_nationkey || '|' || c_mktsegment END AS key FROM customer)) WHERE loser IS NOT NULL GROUP BY ALL")
def parse_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    key = F.when(F.col("c_custkey") % 5 == 0, "bad").otherwise(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    parts = F.split(key, r"\|")
    return c.select(parts[0].try_cast("int").alias("loser"), F.try_element_at(parts, F.lit(2)).alias("winner")).where("loser IS NOT NULL").distinct()
