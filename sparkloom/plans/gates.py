"""Gate and lookup queries over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates as op
from ..session import table
from . import accuracy, texts
from .registry import query

_ED = "ed AS (SELECT event_id, user_id AS file, event_id % 120 AS line, event_type AS policy, event_type = 'error' AS rewrite FROM events)"
_RG = "rg AS (SELECT o_custkey % 150 AS file, o_orderkey % 120 AS s, o_orderkey % 120 + 3 AS e FROM orders WHERE o_orderpriority = '1-URGENT')"
_ER = f"{_RG}, er AS (SELECT DISTINCT file, unnest(range(s, e + 1)) AS line FROM rg)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr("event_id", "user_id AS file", "event_id % 120 AS line", "event_type AS policy", "event_type = 'error' AS rewrite")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey % 150 AS file", "o_orderkey % 120 AS s", "o_orderkey % 120 + 3 AS e")


@query(f"WITH {_ER} SELECT file, line FROM er")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.error_lines(_regions(spark, sf_dir))


@query(f"WITH {_ED}, {_ER} SELECT event_id FROM ed WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.file = ed.file AND er.line = ed.line)")
def understanding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.understood(_edits(spark, sf_dir), op.error_lines(_regions(spark, sf_dir))).select("event_id")


@query(
    f"""WITH {_ED}, {_ER}, m AS (SELECT ed.*, er.file IS NOT NULL AS i FROM ed LEFT JOIN er USING (file, line)), w AS (SELECT *, bool_and(i) OVER (PARTITION BY file, policy) AS a FROM m)
    SELECT event_id FROM w WHERE i AND (NOT rewrite OR a)"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.within_scope(_edits(spark, sf_dir), op.error_lines(_regions(spark, sf_dir))).select("event_id")


@query("SELECT user_id, n > 0 AND (ok OR (f <= 1 AND e <= 6)) AS votes FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS n, user_id % 3 = 0 AS ok, count(*) FILTER (value > 250) AS f, count(*) FILTER (value > 150) AS e FROM events GROUP BY user_id)")
def vote_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    rows = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.count_if(F.col("value") > 250).alias("f"), F.count_if(F.col("value") > 150).alias("e"))
    return rows.select("user_id", op.may_vote(F.col("n"), F.col("user_id") % 3 == 0, F.col("f"), F.col("e")).alias("votes"))


@query("SELECT event_id, CASE WHEN value > 80 THEN 'Selected' WHEN event_type = 'view' THEN 'BlockedZone' WHEN event_type = 'error' THEN 'BlockedHardConstraint' WHEN value > 20 THEN 'DroppedConflict' ELSE 'DroppedConvergence' END AS outcome FROM events")
def candidate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    t, v = F.col("event_type"), F.col("value")
    return ev.select("event_id", op.candidate_outcome(v > 80, t == "view", t == "error", v > 20).alias("outcome"))


@query("SELECT c_custkey, CASE l WHEN 'Must' THEN 'Must' WHEN 'Hard' THEN 'Soft' ELSE 'Advisory' END AS relaxed, CASE l WHEN 'Advisory' THEN 'Soft' WHEN 'Soft' THEN 'Hard' ELSE 'Must' END AS hardened FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'Must' WHEN 1 THEN 'Hard' WHEN 2 THEN 'Soft' ELSE 'Advisory' END AS l FROM customer)")
def enforcement_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 4
    level = F.when(k == 0, "Must").when(k == 1, "Hard").when(k == 2, "Soft").otherwise("Advisory")
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select("c_custkey", op.step_enforcement(level, False).alias("relaxed"), op.step_enforcement(level, True).alias("hardened"))


@query(
    """WITH r AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER (l_quantity > 10) AS s FROM lineitem WHERE l_quantity > 40 GROUP BY 1), o AS (SELECT p_partkey AS id, p_name AS name, greatest(coalesce(n, 0), 1) AS expected, greatest(coalesce(s, 0), 1) AS least FROM part LEFT JOIN r ON r.id = p_partkey)
    SELECT *, CASE WHEN length(name) < 9 THEN 0.5 WHEN least >= expected THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM o"""
)
def rename_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    refs = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 40").select(F.col("l_partkey").alias("id"), (F.col("l_quantity") > 10).alias("safe"))
    found = op.occurrences(decls, refs)
    return found.withColumn("confidence", op.rename_confidence(F.length("name") >= 9, F.col("expected"), F.col("least")))


@query("SELECT a.p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_name = a.p_name AND b.p_partkey <> a.p_partkey)")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return op.named_elsewhere(p, p.select("*")).select(F.col("line").alias("p_partkey"))


@query("WITH s AS (SELECT l_suppkey % 40 AS k, l_quantity::BIGINT AS n_refs, l_linenumber::BIGINT AS n_files, l_discount AS consensus, l_returnflag <> 'A' AS live FROM lineitem), b AS (SELECT k, max({'a': n_refs, 'b': n_files, 'c': consensus, 'd': live}) AS x FROM s GROUP BY k) SELECT k, x.a AS n_refs, x.b AS n_files, x.c AS consensus, x.d AS live FROM b")
def best_project_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_linenumber", "l_discount", "l_returnflag")
    return op.best_signal(li.select((F.col("l_suppkey") % 40).alias("k"), F.col("l_quantity").cast("bigint").alias("n_refs"), F.col("l_linenumber").cast("bigint").alias("n_files"), F.col("l_discount").alias("consensus"), (F.col("l_returnflag") == "A").alias("tombstone")), "k")


@query("SELECT p_partkey AS id, 7::BIGINT AS last_seen FROM part WHERE p_size > 25 UNION ALL SELECT DISTINCT l_partkey, 99::BIGINT FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def stub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit(7).cast("bigint").alias("last_seen"))
    return op.stub_nodes(table(spark, sf_dir, "lineitem", "l_partkey").select(F.col("l_partkey").alias("id")), nodes, 99)


@query(
    """WITH d AS (SELECT l_suppkey AS file, count(DISTINCT l_partkey) AS n_ids FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS file, count(*) AS n_refs FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    s AS (SELECT l_suppkey AS file, count(*) FILTER (l_linenumber = 1) AS n_function, count(*) FILTER (l_linenumber = 2) AS n_type, count(*) FILTER (l_linenumber = 3) AS n_namespace, count(*) FILTER (l_linenumber = 4) AS n_preprocessor FROM lineitem GROUP BY 1)
    SELECT file, coalesce(n_ids, 0) AS n_ids, coalesce(n_refs, 0) AS n_refs, n_function, n_type, n_namespace, n_preprocessor FROM s LEFT JOIN d USING (file) LEFT JOIN r USING (file)"""
)
def semantic_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag").withColumnRenamed("l_suppkey", "file")
    kind = F.when(F.col("l_linenumber") == 1, "function").when(F.col("l_linenumber") == 2, "type").when(F.col("l_linenumber") == 3, "namespace").when(F.col("l_linenumber") == 4, "preprocessor")
    return op.snapshot(li.where("l_returnflag = 'A'").select("file", F.col("l_partkey").alias("id")), li.where("l_returnflag = 'R'").select("file"), li.select("file", kind.alias("kind")))


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, false) AS breaks FROM events")
def section_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.section_breaks(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type").select("event_id", "breaks")


@query(f"WITH {texts._lines(texts.COMMENTS)}, t AS (SELECT *, {texts._S.format('line')} AS s FROM c) SELECT doc, coalesce(min(CASE WHEN NOT (s = '' OR s LIKE '//%' OR s LIKE '/*%' OR s LIKE '*%' OR s LIKE '#!%') THEN line_no END), max(line_no) + 1) AS line_no FROM t GROUP BY doc")
def top_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_insert(texts.lines(spark, sf_dir, texts.COMMENTS))


@query("SELECT page_id, [lower(s || '.h'), lower(s || '.hpp')] AS headers FROM (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS s FROM pages)")
def main_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", op.main_headers(F.col("url"), [".h", ".hpp"]).alias("headers"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'usr:' || p_brand ELSE 'loc:' || p_type || '|' || p_size || '|-|' || p_partkey || '|' || p_name END AS id FROM part")
def declaration_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    usr = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand"))
    return p.select("p_partkey", op.declaration_id(usr, F.col("p_type"), F.col("p_size").cast("string"), F.lit(None).cast("string"), F.col("p_partkey"), F.col("p_name")).alias("id"))


@query("SELECT n_nationkey AS policy, coalesce(b, n_regionkey) AS priority, coalesce(c, 5) AS radius FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS b, min(s_suppkey) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def resolved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("policy"), F.col("n_regionkey").alias("priority"), F.lit(5).alias("radius"))
    settings = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").groupBy(F.col("s_nationkey").alias("policy")).agg(F.max("s_suppkey").alias("priority"), F.min("s_suppkey").alias("radius"))
    return op.resolved_profiles(catalog, settings, "policy", ["priority", "radius"])


@query(f"WITH {accuracy._G} SELECT file_id, (status = 'warning')::INT AS warnings, (status <> 'passed')::INT AS violations, (status = 'failed_closed')::INT AS errors FROM st")
def applied_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.accuracy import gate

    return op.applied_gate(gate(accuracy._gate_inputs(spark, sf_dir)))


@query("SELECT user_id, (8 * count(*) FILTER (event_type = 'error') + 4 * count(*) FILTER (event_type = 'view') + count(*))::BIGINT AS effort FROM events GROUP BY user_id")
def retry_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("r"), F.count_if(F.col("event_type") == "view").alias("v"), F.count("*").alias("s"))
    return ev.select("user_id", op.retry_effort(F.col("r"), F.col("v"), F.col("s")).alias("effort"))
