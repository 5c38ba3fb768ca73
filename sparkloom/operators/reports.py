"""Run reports: nested records per file, summaries and per-policy telemetry.

A *run* is one execution of a policy on a file: file_id, policy, seq,
elapsed_ms, n_edits, n_blocked, confidence (Apply, ApplyPartial, Block or
null), error (null if none). A *record* is a file with its runs nested.
All functions are plain column expressions and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("low_confidence", "unstable_scope", "parse_error")


def outcome(confidence: Column, n_edits: Column, n_blocked: Column) -> Column:
    """A policy's outcome: the confidence decision if there is one, else by what it left."""
    return (
        F.when(confidence == "Apply", "Applied")
        .when(confidence == "ApplyPartial", "PartiallyApplied")
        .when(confidence == "Block", "Blocked")
        .when((n_edits == 0) & (n_blocked == 0), "NoChange")
        .when(n_edits == 0, "Blocked")
        .when(n_blocked > 0, "PartiallyApplied")
        .otherwise("Applied")
    )


def two_places(x: Column) -> Column:
    """A number with two decimals, rounded by its exact binary value as C does; Java's ``%.2f`` rounds the shortest decimal."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.00"))


def reason(confidence: Column, score: Column, threshold: Column, first_blocked: Column) -> Column:
    """Why a policy was held back: the gate's numbers, else the first blocked line's reason, else null."""
    gate = F.format_string("blocked by confidence gate (score=%s, threshold=%s)", two_places(F.coalesce(score, F.lit(0.0))), two_places(F.coalesce(threshold, F.lit(0.0))))
    return F.when(confidence == "Block", gate).otherwise(first_blocked)


def records(runs: DataFrame) -> DataFrame:
    """One row a file: elapsed_ms, changed, n_errors and the nested policies in order."""
    one = F.struct("seq", "policy", "outcome", "elapsed_ms", "n_edits", "n_blocked")
    return runs.groupBy("file_id").agg(
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.bool_or(F.col("n_edits") > 0).alias("changed"),
        F.count("error").alias("n_errors"),
        F.array_sort(F.collect_list(one)).alias("policies"),
    )


def filter_records(recs: DataFrame, kind: str | None) -> DataFrame:
    """blocked, changed, errors; slow sorts the slowest first; anything else keeps all."""
    if kind == "blocked":
        return recs.where(F.exists("policies", lambda p: p["outcome"] == "Blocked"))
    if kind == "changed":
        return recs.where("changed")
    if kind == "errors":
        return recs.where("n_errors > 0")
    if kind == "slow":
        return recs.orderBy(F.desc("elapsed_ms"), "file_id")
    return recs


def by_policy(runs: DataFrame) -> DataFrame:
    """Count, total, mean, greatest time and edits of each policy."""
    return runs.groupBy("policy").agg(
        F.count("*").alias("n_runs"),
        F.round(F.sum("elapsed_ms"), 6).alias("total_ms"),
        F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.max_by("seq", F.struct(F.col("elapsed_ms"), -F.col("seq"))).alias("slowest_seq"),
        F.sum("n_edits").alias("edits"),
        F.count_if(F.col("outcome") == "Blocked").alias("blocked"),
    )


def summary(recs: DataFrame, last_max: bool = False) -> DataFrame:
    """One row over all records. Of equally slow files the first by id is the slowest, or with ``last_max`` the last."""
    edits = F.aggregate("policies", F.lit(0).cast("bigint"), lambda a, p: a + p["n_edits"])
    blocked = F.size(F.filter("policies", lambda p: p["outcome"] == "Blocked"))
    held = F.aggregate("policies", F.lit(0).cast("bigint"), lambda a, p: a + F.when(p["outcome"] == "Blocked", p["n_blocked"]).otherwise(0))
    tie = F.col("file_id") if last_max else -F.col("file_id")
    return recs.agg(
        F.count("*").alias("files"),
        F.count_if("changed").alias("changed"),
        F.count_if(F.col("n_errors") > 0).alias("errors"),
        F.sum(edits).alias("edits"),
        F.sum(blocked).cast("bigint").alias("blocked_policies"),
        F.sum(held).alias("violations"),
        F.round(F.sum("elapsed_ms"), 4).alias("total_ms"),
        F.round(F.avg("elapsed_ms"), 4).alias("avg_ms"),
        F.round(F.max("elapsed_ms"), 4).alias("max_ms"),
        F.max_by("file_id", F.struct(F.round("elapsed_ms", 6), tie)).alias("slowest_file"),
    )


def reason_flags(codes: Column) -> list[Column]:
    """One 0/1 column for each known reason code of an array."""
    return [F.array_contains(codes, r).cast("int").alias(r) for r in REASONS]


def telemetry(runs: DataFrame) -> DataFrame:
    """Roll-up per policy with failures, elapsed sum and maximum, and counts of reason codes (column ``reasons``)."""
    flags = [F.sum(c.cast("bigint")).alias(r) for c, r in zip(reason_flags(F.col("reasons")), REASONS, strict=True)]
    return runs.groupBy("policy").agg(
        F.count("*").alias("n_runs"),
        F.count("error").alias("failures"),
        F.count_if(F.col("outcome") == "Blocked").alias("blocked"),
        F.sum("n_edits").alias("edits"),
        F.round(F.sum("elapsed_ms"), 6).alias("elapsed_sum"),
        F.max("elapsed_ms").alias("elapsed_max"),
        F.round(F.coalesce(F.sum("elapsed_ms") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("elapsed_avg"),
        *flags,
    )


def confidence_counters(runs: DataFrame) -> DataFrame:
    """Global counts of confidence decisions and reasons."""
    flags = [F.sum(c.cast("bigint")).alias(r) for c, r in zip(reason_flags(F.col("reasons")), REASONS, strict=True)]
    return runs.agg(*(F.count_if(F.col("confidence") == k).alias(a) for k, a in (("Apply", "applied"), ("ApplyPartial", "partial"), ("Block", "blocked"))), *flags)


def project(runs: DataFrame) -> DataFrame:
    """Per file and policy: edits and blocked line counts regrouped, with outcome and reason."""
    return runs.groupBy("file_id", "policy").agg(
        F.sum("n_edits").alias("n_edits"), F.sum("n_blocked").alias("n_blocked"), F.max_by("confidence", "seq").alias("confidence"), F.round(F.max("score"), 6).alias("score")
    ).withColumn("outcome", outcome(F.col("confidence"), F.col("n_edits"), F.col("n_blocked"))).withColumn(
        "reason", reason(F.col("confidence"), F.col("score"), F.lit(0.5), F.when(F.col("n_blocked") > 0, F.format_string("%d lines held", "n_blocked")))
    )


def human_line(recs: DataFrame) -> DataFrame:
    """A line of text for each record."""
    return recs.select("file_id", F.format_string("%d: %s, %d policies, %d ms", "file_id", F.when(F.col("changed"), "changed").otherwise("unchanged"), F.size("policies"), F.floor(F.round("elapsed_ms", 4))).alias("line"))
