"""What was wrong or failed on larger tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import edits, graphs, lookups, reports, scanning, scopes
from sparkloom.plans import registry, source


def test_scores_are_rounded_by_their_binary_value(spark):
    x = [0.305, 0.355, 0.145, 0.125, 0.375, 2.675, 1234.5, 0.0, -0.305]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", reports.two_places(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{r.x:.2f}" for r in rows]
    said = spark.range(1).select(reports.reason(F.lit("Block"), F.lit(0.305), F.lit(0.5), F.lit(None)).alias("r")).first().r
    assert said == "blocked by confidence gate (score=0.30, threshold=0.50)"


def test_empty_parameters_behind_any_number_of_words(spark):
    long = "word " * 100_000
    rows = spark.createDataFrame([(long + "f ( );", ), (long, ), ("int  f ();", ), ("a b *(", ), ("int x (a);", )], "line string")
    got = [r.x for r in rows.select(edits.void_parameters(F.col("line")).alias("x")).collect()]
    assert got == [long + "f(void);", long, "int  f(void);", "a b *(", "int x (a);"]


def test_candidates_are_ranked_by_kind_of_customer(spark, sf_dir):
    found = registry.QUERIES["scored_candidates_topk"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # every window is above the distinct kinds, none above single customers
    assert all("c_custkey" not in line for line in plan.splitlines() if "Window" in line or "windowspecdefinition" in line)


def test_capped_nodes_read_lineitem_once(spark, sf_dir):
    plan = registry.QUERIES["cap_nodes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "LogicalRDD" in plan  # only tables that were cut are left


def test_impact_moves_only_links_that_a_hop_meets(spark):
    near = [("f1", "s1", 1), ("f2", "s1", 2), ("f2", "s2", 1), ("f3", "s2", 4)]
    far = [(f"g{i}", f"t{i % 977}", 1) for i in range(20_000)]
    e = spark.createDataFrame([(a, b, "contains", w, 1) for a, b, w in near + far], "src string, dst string, kind string, weight long, last_seen long")
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    m = graphs.reference_counts(e).withColumn("consensus", F.lit(0.5))
    before = total()
    found = graphs.impact(e, m, spark.createDataFrame([("f1",)], "id string"), 2, 20).collect()
    assert [(r.id, r.hop) for r in found] == [("f2", 1), ("f3", 2)]
    assert total() - before < 50_000


def test_companions_are_not_shuffled_as_pairs(spark):
    kind = "path long, dir string, stem string, header boolean"
    files = spark.createDataFrame([(i, "b", "s", i % 2 == 0) for i in range(600)], kind)
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = total()
    assert lookups.companions(files, files).count() == 2 * 300 * 300
    assert total() - before < 200_000
    # paths that are listed in several places are told once
    twice = spark.createDataFrame([(1, "a/src", "s", False), (2, "a/inc", "s", True), (2, "a/src", "s", True), (2, "a/src", "s", True)], kind)
    assert sorted(tuple(r) for r in lookups.companions(twice, twice).collect()) == [(1, 2), (2, 1)]


def test_companions_are_made_in_all_tasks(spark, monkeypatch):
    kind = "path long, dir string, stem string, header boolean"
    files = spark.createDataFrame([(i, "b", f"s{i % 40}", i % 80 < 40) for i in range(1600)], kind)
    by_task = lookups.companions(files, files).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 40 * 2 * 20 * 20
    assert max(r["count"] for r in by_task) < 40 * 20 * 20  # half of all; one small shuffle is read by one task
    # one stem is cut into cells, which as many tasks as the pairs ask for make
    one = spark.createDataFrame([(i, "b", "s", i % 2 == 0) for i in range(400)], kind)
    for name, most in (("BLOCK", 7), ("LISTED", 11), ("PAIRS", 2000)):
        monkeypatch.setattr(lookups, name, most)
    found = lookups.companions(one, one)
    assert found.rdd.getNumPartitions() == 41
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, j) for i in range(400) for j in range(400) if (i - j) % 2)
    # a path may be unknown, and paths of several places have cells as well
    several = [(None, "a/src", "s", False), *((i, d, "s", i % 2 == 0) for i in range(60) for d in ("a/src", "a/inc"))]
    some = spark.createDataFrame(several, kind)
    want = {(i, j) for i in (None, *range(60)) for j in (None, *range(60)) if bool(i is not None and i % 2 == 0) != bool(j is not None and j % 2 == 0)}
    got = [tuple(r) for r in lookups.companions(some, some).collect()]
    assert len(got) == len(want) and set(got) == want


def test_aliased_edges_are_dealt_by_their_number(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(100 * n).selectExpr("concat('f', id) AS src", "concat('s', id % 50) AS dst", "'contains' AS kind", "id % 3 AS weight", "id AS last_seen")
    aliases = spark.range(50).selectExpr("concat('s', id) AS old", "concat('s', id div 10) AS new")
    found = graphs.aliased(rows, aliases, 10)
    assert found.rdd.getNumPartitions() == 10 * n + 1
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.dst for r in found.collect()) == sorted(f"s{i % 50 // 10}" for i in range(100 * n))


def test_statements_are_dealt_once(spark):
    """Also the first token of a line comes from the order of the text, so all tokens move once."""
    lines = ["#define A {", " {", "a ;", "# if x", "b { c ; }", "}"]
    tokens = scanning.tokens(spark.createDataFrame([(d, i + 1, x) for d in (1, 2) for i, x in enumerate(lines)], "doc long, line_no long, line string"))
    found = scopes.statements(tokens)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(doc#" in plan
    assert sorted((r.doc, r.at, r.text, r.ends) for r in found.collect() if r.n) == sorted((d, at, t, e) for d in (1, 2) for at, t, e in ((15, "a", ";"), (26, "b", "{"), (30, "c", ";")))


def test_scopes_from_statements_at_hand(spark, sf_dir):
    tokens = source.source_tokens(spark, sf_dir).where("doc % 7 = 0")
    every = scopes.scopes(tokens).where("kind <> 'preprocessor'")
    some = scopes.scopes(tokens, scopes.statements(tokens), conditions=False)
    assert every.exceptAll(some).isEmpty() and some.exceptAll(every).isEmpty() and not some.isEmpty()
