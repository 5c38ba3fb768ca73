"""Accuracy queries: quality labels against a rule on documents, and events as gate inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy as op
from ..session import table
from .registry import query


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "n_chars", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id", (F.col("n_chars") > 500).alias("changed"), (F.col("quality") == 1).alias("should_change"), (F.col("toxic") == 0).alias("exact")
    )


_F = "f AS (SELECT doc_id, n_chars > 500 AS changed, quality = 1 AS should_change, toxic = 0 AS exact FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {_F}, c AS (SELECT count(*) FILTER (changed AND should_change AND exact) AS tp, count(*) FILTER (should_change AND NOT (changed AND exact)) AS fn,
      count(*) FILTER (changed AND NOT should_change) AS fp, count(*) FILTER (NOT changed AND NOT should_change) AS tn, count(*) FILTER (exact) AS matches, count(*) AS files FROM f)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 1.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1.0), 6) AS recall, round(coalesce(matches / nullif(files, 0), 1.0), 6) AS match_ratio FROM c"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.confusion(_files(spark, sf_dir))


_G = """g AS (SELECT user_id AS file_id, count(*) AS attempted_edits, count(*) FILTER (value > 12) AS accepted_edits, count(*) FILTER (event_type = 'error') AS attempted_violations,
  CASE user_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'paired' WHEN 2 THEN 'header' WHEN 3 THEN 'source' ELSE 'none' END AS context FROM events GROUP BY user_id),
h AS (SELECT *, least(greatest(accepted_edits / attempted_edits, 0.0), 1.0) AS precision,
  CASE WHEN attempted_violations = 0 THEN 1.0 ELSE least(accepted_edits / least(attempted_violations, greatest(attempted_edits, 1)), 1.0) END AS recall FROM g),
k AS (SELECT *, CASE WHEN attempted_edits + attempted_violations >= 6 THEN (precision < 0.92)::INT + (recall < 0.6)::INT ELSE 0 END AS misses FROM h),
st AS (SELECT *, CASE WHEN misses = 0 THEN 'passed' WHEN context <> 'exact' AND NOT (context = 'paired' AND misses >= 2) THEN 'warning' ELSE 'failed_closed' END AS status FROM k)"""


def _gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("file_id") % 5 == 0, "exact").when(F.col("file_id") % 5 == 1, "paired").when(F.col("file_id") % 5 == 2, "header").when(F.col("file_id") % 5 == 3, "source").otherwise("none")
    return (
        table(spark, sf_dir, "events", "user_id", "event_type", "value")
        .groupBy(F.col("user_id").alias("file_id"))
        .agg(F.count("*").alias("attempted_edits"), F.count_if(F.col("value") > 12).alias("accepted_edits"), F.count_if(F.col("event_type") == "error").alias("attempted_violations"))
        .withColumn("context", kinds)
    )


@query(f"WITH {_G} SELECT file_id, round(precision, 6) AS precision, round(recall, 6) AS recall, misses, status FROM st")
def accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.gate(_gate_inputs(spark, sf_dir))
    return found.select("file_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "misses", "status")


@query(
    f"""WITH {_G} SELECT count(*) AS considered, count(*) FILTER (status <> 'passed') AS failing,
      round(avg(CASE WHEN status <> 'passed' THEN precision ELSE 1.0 END), 6) AS precision, round(avg(CASE WHEN status <> 'passed' THEN recall ELSE 1.0 END), 6) AS recall,
      round(count(*) FILTER (status = 'passed') / count(*), 6) AS match_ratio FROM st WHERE status <> 'passed' OR file_id % 10 <> 9"""
)
def gate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("status") != "passed"
    rows = op.gate(_gate_inputs(spark, sf_dir)).select(
        F.when(bad, F.col("precision")).alias("gate_precision"), F.when(bad, F.col("recall")).alias("gate_recall"), F.when(F.col("file_id") % 10 == 9, "failed").alias("error")
    )
    return op.rollout_signal(rows)


@query(
    f"""WITH {_G} SELECT status, count(*) FILTER (policy IN ('semantic_contract', 'post_edit_check')) AS violations
    FROM (SELECT status, CASE file_id % 3 WHEN 0 THEN 'semantic_contract' WHEN 1 THEN 'post_edit_check' ELSE 'other' END AS policy FROM st) GROUP BY status"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = F.when(F.col("file_id") % 3 == 0, "semantic_contract").when(F.col("file_id") % 3 == 1, "post_edit_check").otherwise("other")
    return op.gate(_gate_inputs(spark, sf_dir)).groupBy("status").agg(F.count_if(policy.isin(*op.CONTRACT_POLICIES)).alias("violations"))


@query(
    """SELECT n_nationkey, profile, CASE profile WHEN 'strict' THEN greatest(p, 0.98) WHEN 'balanced' THEN greatest(p, 0.94) ELSE least(p, 0.90) END AS min_precision,
      CASE profile WHEN 'strict' THEN greatest(p, 0.94) WHEN 'balanced' THEN greatest(p, 0.78) ELSE least(p, 0.60) END AS min_recall,
      CASE profile WHEN 'strict' THEN greatest(p, 0.95) WHEN 'balanced' THEN greatest(p, 0.85) ELSE least(p, 0.72) END AS min_match_ratio,
      CASE profile WHEN 'strict' THEN greatest(n_nationkey, 16) WHEN 'balanced' THEN greatest(n_nationkey, 10) ELSE least(n_nationkey, 8) END AS min_samples
    FROM (SELECT n_nationkey, n_nationkey / 25.0::DOUBLE AS p, CASE n_regionkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'balanced' ELSE 'adaptive' END AS profile FROM nation)"""
)
def profile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("n_nationkey") / F.lit(25.0)
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(
        "n_nationkey",
        F.when(F.col("n_regionkey") % 3 == 0, "strict").when(F.col("n_regionkey") % 3 == 1, "balanced").otherwise("adaptive").alias("profile"),
        p.alias("min_precision"), p.alias("min_recall"), p.alias("min_match_ratio"), F.col("n_nationkey").alias("min_samples"),
    )
    return op.applied_thresholds(rows)


@query(
    """SELECT d.doc_id, d.n_chars, l.quality IS NOT NULL AS found, coalesce(l.quality = 1, false) AS exact
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)"""
)
def golden_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "n_chars"), table(spark, sf_dir, "labels", "doc_id", "quality")
    wanted = table(spark, sf_dir, "benchmark", "item_id")
    kept = docs.join(wanted, docs.doc_id == wanted.item_id, "left_semi").join(labels, "doc_id", "left")
    return kept.select("doc_id", "n_chars", F.col("quality").isNotNull().alias("found"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("exact"))
