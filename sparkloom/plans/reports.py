"""Report queries over ``events``: an event is a policy's run on the file ``user_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as op
from ..session import table
from .registry import query

RUNS = """
  event_id AS seq, user_id AS file_id, event_type AS policy, value AS elapsed_ms, event_id % 4 AS n_edits,
  CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 2 ELSE 0 END AS n_blocked,
  CASE WHEN event_id % 11 = 0 THEN 'Apply' WHEN event_id % 11 = 1 THEN 'ApplyPartial' WHEN event_id % 11 = 2 THEN 'Block' END AS confidence,
  CASE WHEN event_type = 'error' AND value > 100 THEN 'failed' END AS error, value / 500 AS score
"""
_OUT = """CASE WHEN confidence = 'Apply' THEN 'Applied' WHEN confidence = 'ApplyPartial' THEN 'PartiallyApplied' WHEN confidence = 'Block' THEN 'Blocked'
  WHEN n_edits = 0 AND n_blocked = 0 THEN 'NoChange' WHEN n_edits = 0 THEN 'Blocked' WHEN n_blocked > 0 THEN 'PartiallyApplied' ELSE 'Applied' END"""
_R = f"r AS (SELECT *, {_OUT} AS outcome FROM (SELECT {RUNS} FROM events))"
_REC = """rec AS (SELECT file_id, sum(elapsed_ms) AS elapsed_ms, bool_or(n_edits > 0) AS changed, count(error) AS n_errors, count(*) AS n_policies,
  sum(n_edits) AS edits, count(*) FILTER (outcome = 'Blocked') AS nb, coalesce(sum(n_blocked) FILTER (outcome = 'Blocked'), 0) AS held FROM r GROUP BY file_id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [f"event_id AS seq", *(x.strip() for x in _split(RUNS)[1:])]
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").selectExpr(*exprs)
    return rows.withColumn("outcome", op.outcome(F.col("confidence"), F.col("n_edits"), F.col("n_blocked")))


def _split(columns: str) -> list[str]:
    """Column expressions of a list, parted at the commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def with_reasons(rows: DataFrame) -> DataFrame:
    codes = F.array(
        F.when(F.col("seq") % 3 == 0, "low_confidence"), F.when(F.col("seq") % 5 == 0, "unstable_scope"), F.when(F.col("error").isNotNull(), "parse_error")
    )
    return rows.withColumn("reasons", F.array_compact(codes))


@query(
    f"WITH {_R} SELECT policy, count(*) AS n_runs, round(sum(elapsed_ms), 6) AS total_ms, round(avg(elapsed_ms), 6) AS avg_ms, max(elapsed_ms) AS max_ms, "
    "arg_max(seq, {'a': elapsed_ms, 'b': -seq}) AS slowest_seq, sum(n_edits)::BIGINT AS edits, count(*) FILTER (outcome = 'Blocked') AS blocked FROM r GROUP BY policy"
)
def report_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.by_policy(runs(spark, sf_dir))


def _summary(tie: str) -> str:
    return (
        f"WITH {_R}, {_REC} SELECT count(*) AS files, count(*) FILTER (changed) AS changed, count(*) FILTER (n_errors > 0) AS errors, sum(edits)::BIGINT AS edits, "
        "sum(nb)::BIGINT AS blocked_policies, sum(held)::BIGINT AS violations, round(sum(elapsed_ms), 4) AS total_ms, round(avg(elapsed_ms), 4) AS avg_ms, "
        f"round(max(elapsed_ms), 4) AS max_ms, arg_max(file_id, {{'a': round(elapsed_ms, 6), 'b': {tie}}}) AS slowest_file FROM rec"
    )


@query(_summary("-file_id"))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summary(op.records(runs(spark, sf_dir)))


@query(_summary("file_id"))
def cli_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summary(op.records(runs(spark, sf_dir)), last_max=True)


def _filtered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = op.filter_records(op.records(runs(spark, sf_dir)), kind)
    return found.select("file_id", F.round("elapsed_ms", 4).alias("elapsed_ms"), "changed", "n_errors", F.size("policies").cast("bigint").alias("n_policies"))


def _filter_sql(where: str) -> str:
    return f"WITH {_R}, {_REC} SELECT file_id, round(elapsed_ms, 4) AS elapsed_ms, changed, n_errors, n_policies FROM rec {where}"


@query(_filter_sql("WHERE nb > 0"))
def report_filter_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "blocked")


@query(_filter_sql("WHERE changed"))
def report_filter_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "changed")


@query(_filter_sql("WHERE n_errors > 0"))
def report_filter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "errors")


@query(_filter_sql("ORDER BY elapsed_ms DESC, file_id"))
def report_filter_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "slow")


@query(f"WITH {_R} SELECT seq, outcome FROM r")
def outcome_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("seq", "outcome")


@query(
    f"""WITH {_R}, g AS (SELECT file_id, policy, sum(n_edits)::BIGINT AS n_edits, sum(n_blocked)::BIGINT AS n_blocked,
      arg_max(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence, round(max(score), 6) AS score FROM r GROUP BY file_id, policy)
    SELECT file_id, policy, n_edits, n_blocked, confidence, score, {_OUT} AS outcome,
      CASE WHEN confidence = 'Block' THEN printf('blocked by confidence gate (score=%.2f, threshold=%.2f)', score, 0.5)
        WHEN n_blocked > 0 THEN printf('%d lines held', n_blocked) END AS reason FROM g"""
)
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = runs(spark, sf_dir)
    # max_by over the decided runs alone: an undecided run says nothing
    last = decided.where(F.col("confidence").isNotNull()).groupBy("file_id", "policy").agg(F.max_by("confidence", "seq").alias("confidence"))
    found = op.project(decided).drop("confidence", "outcome", "reason").join(last, ["file_id", "policy"], "left")
    c, e, b = F.col("confidence"), F.col("n_edits"), F.col("n_blocked")
    return found.withColumn("outcome", op.outcome(c, e, b)).withColumn(
        "reason", op.reason(c, F.col("score"), F.lit(0.5), F.when(b > 0, F.format_string("%d lines held", b)))
    )


_FLAGS = "sum((seq % 3 = 0)::INT)::BIGINT AS low_confidence, sum((seq % 5 = 0)::INT)::BIGINT AS unstable_scope, count(error) AS parse_error"
_TEL = f"""SELECT policy, count(*) AS n_runs, count(error) AS failures, count(*) FILTER (outcome = 'Blocked') AS blocked, sum(n_edits)::BIGINT AS edits,
  round(sum(elapsed_ms), 6) AS elapsed_sum, max(elapsed_ms) AS elapsed_max, round(sum(elapsed_ms) / count(*), 6) AS elapsed_avg, {_FLAGS} FROM r GROUP BY policy"""


@query(f"WITH {_R} {_TEL}")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.telemetry(with_reasons(runs(spark, sf_dir)))


@query(f"WITH {_R}, t AS ({_TEL}) SELECT policy, elapsed_sum, failures FROM t ORDER BY elapsed_sum DESC, failures DESC, policy LIMIT 8")
def telemetry_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.telemetry(with_reasons(runs(spark, sf_dir)))
    return found.select("policy", "elapsed_sum", "failures").orderBy(F.desc("elapsed_sum"), F.desc("failures"), "policy").limit(8)


@query(
    f"WITH {_R} SELECT count(*) FILTER (confidence = 'Apply') AS applied, count(*) FILTER (confidence = 'ApplyPartial') AS partial, "
    f"count(*) FILTER (confidence = 'Block') AS blocked, {_FLAGS} FROM r"
)
def confidence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.confidence_counters(with_reasons(runs(spark, sf_dir)))


@query(
    f"WITH {_R}, {_REC} SELECT file_id, printf('%d: %s, %d policies, %d ms', file_id, CASE WHEN changed THEN 'changed' ELSE 'unchanged' END, n_policies, floor(round(elapsed_ms, 4))::BIGINT) AS line FROM rec "
)
def human_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.human_line(op.records(runs(spark, sf_dir)))


@query(
    f"WITH {_R} SELECT file_id % 8 AS batch, count(DISTINCT file_id) AS files, count(*) AS n_runs, round(sum(elapsed_ms), 4) AS elapsed_ms, "
    f"sum(n_edits)::BIGINT AS edits, count(error) AS errors FROM r GROUP BY 1"
)
def batch_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy((F.col("file_id") % 8).alias("batch")).agg(
        F.count_distinct("file_id").alias("files"), F.count("*").alias("n_runs"), F.round(F.sum("elapsed_ms"), 4).alias("elapsed_ms"), F.sum("n_edits").alias("edits"), F.count("error").alias("errors")
    )
