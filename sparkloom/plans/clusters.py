"""Cluster learning over ``events``: the cluster is user_id modulo 16, decisions and outcomes follow the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as op
from ..session import table
from .registry import query

ROWS = """event_id, user_id AS file_id, event_type AS policy, user_id % 16 AS cluster,
  CASE WHEN value > 40 THEN 'apply' WHEN value > 15 THEN 'apply_partial' ELSE 'block' END AS decision,
  CASE WHEN value > 30 THEN 'accepted' WHEN value > 8 THEN 'regressed' ELSE 'reverted' END AS outcome"""
_C = f"""c AS (SELECT {ROWS} FROM events),
d AS (SELECT policy, cluster, count(*) FILTER (decision = 'apply') AS apply, count(*) FILTER (decision = 'apply_partial') AS apply_partial,
  count(*) FILTER (decision = 'block') AS block FROM c GROUP BY policy, cluster),
o AS (SELECT policy, cluster, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'regressed') AS regressed,
  count(*) FILTER (outcome = 'reverted') AS reverted FROM (SELECT DISTINCT file_id, policy, cluster, outcome FROM c) GROUP BY policy, cluster)"""
_S = f"""{_C}, s AS (SELECT d.*, accepted, regressed, reverted, apply + apply_partial + block AS decisions, accepted + regressed + reverted AS outcomes,
  (apply + apply_partial * 0.72 + block * 0.05) / (apply + apply_partial + block) AS decision_mean,
  (accepted + regressed * 0.25) / (accepted + regressed + reverted) AS outcome_mean FROM d JOIN o USING (policy, cluster))"""
_Z = "1.959963984540054"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


_BOUNDS = f"""b AS (SELECT *,
  {_clamp(f"((accepted / n + {_Z}*{_Z} / (2 * n)) - sqrt((accepted / n) * (1 - accepted / n) / n + {_Z}*{_Z} / (4 * n * n)) * {_Z}) / (1 + {_Z}*{_Z} / n)")} AS wl,
  {_clamp(f"((accepted / n + {_Z}*{_Z} / (2 * n)) + sqrt((accepted / n) * (1 - accepted / n) / n + {_Z}*{_Z} / (4 * n * n)) * {_Z}) / (1 + {_Z}*{_Z} / n)")} AS wu,
  {_clamp(f"(accepted + 1) / (n + 2) - sqrt((accepted + 1) * (n - accepted + 1) / ((n + 2) * (n + 2) * (n + 3))) * {_Z}")} AS bl,
  {_clamp(f"(accepted + 1) / (n + 2) + sqrt((accepted + 1) * (n - accepted + 1) / ((n + 2) * (n + 2) * (n + 3))) * {_Z}")} AS bu
  FROM (SELECT *, outcomes::DOUBLE AS n FROM s))"""
_EMA = """e AS (SELECT *, 0.5 * pow(0.78, decisions) + decision_mean * (1 - pow(0.78, decisions)) AS decision_ema,
  0.5 * pow(0.74, outcomes) + outcome_mean * (1 - pow(0.74, outcomes)) AS outcome_ema FROM b)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return ev.selectExpr(*[x.strip() for x in ROWS.split(",\n")[0].split(", ")], *[x.strip() for x in ROWS.split(",\n")[1:]])


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return op.mean_scores(op.counters(r).join(op.outcome_counters(r), ["policy", "cluster"]))


def with_ema(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {
            "decision_ema": op.ema_batch(F.lit(0.5), op.DECISION_ALPHA, F.col("decision_mean"), F.col("decisions")),
            "outcome_ema": op.ema_batch(F.lit(0.5), op.OUTCOME_ALPHA, F.col("outcome_mean"), F.col("outcomes")),
        }
    )


@query(f"WITH {_C} SELECT * FROM d")
def cluster_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.counters(rows(spark, sf_dir))


@query(f"WITH {_C} SELECT * FROM o")
def cluster_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.outcome_counters(rows(spark, sf_dir))


@query(f"WITH {_S}, {_BOUNDS} SELECT policy, cluster, round(wl, 6) AS lower, round(wu, 6) AS upper FROM b")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = op.wilson(F.col("accepted"), F.col("regressed") + F.col("reverted"))
    return stats(spark, sf_dir).select("policy", "cluster", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@query(f"WITH {_S}, {_BOUNDS} SELECT policy, cluster, round(bl, 6) AS lower, round(bu, 6) AS upper FROM b")
def beta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = op.beta(F.col("accepted"), F.col("regressed") + F.col("reverted"))
    return stats(spark, sf_dir).select("policy", "cluster", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@query(f"WITH {_S} SELECT policy, cluster, decisions, outcomes, round(decision_mean, 6) AS decision_mean, round(outcome_mean, 6) AS outcome_mean FROM s")
def decision_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("policy", "cluster", "decisions", "outcomes", F.round("decision_mean", 6).alias("decision_mean"), F.round("outcome_mean", 6).alias("outcome_mean"))


@query(f"WITH {_S}, {_BOUNDS}, {_EMA} SELECT policy, cluster, round(decision_ema, 6) AS decision_ema, round(outcome_ema, 6) AS outcome_ema, floor({_clamp('decision_ema')} * 10000 + 0.5)::INT AS decision_bp FROM e")
def ema_batch_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_ema(stats(spark, sf_dir))
    return found.select("policy", "cluster", F.round("decision_ema", 6).alias("decision_ema"), F.round("outcome_ema", 6).alias("outcome_ema"), op.to_bp(F.col("decision_ema")).alias("decision_bp"))


@query(
    f"""WITH {_S}, {_BOUNDS}, {_EMA}, f AS (SELECT *, least(wl, bl) AS lo, {_clamp('greatest(wu, bu) - least(wl, bl)')} AS sp,
      {_clamp('(decision_ema * 0.45 + outcome_ema * 0.55) * 0.55 + least(wl, bl) * 0.45')} AS st, reverted / n AS rr, sqrt(0.05) AS k FROM e)
    SELECT policy, cluster, round(st, 6) AS stability, round(sp, 6) AS spread,
      CASE WHEN decisions < 6 THEN 'Neutral' WHEN st >= 0.8 AND sp < k * 0.805 THEN 'Relax'
        WHEN st <= 0.55 OR sp > k * 1.966 OR rr >= k * 0.983 THEN 'Harden' ELSE 'Neutral' END AS bias,
      CASE WHEN decisions < 6 THEN NULL WHEN st < 0.4 OR lo < 0.3 THEN 1 WHEN st < 0.6 OR sp > k * 1.5625 THEN 3 END AS radius_cap FROM f"""
)
def cluster_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.controls(with_ema(stats(spark, sf_dir)))
    return found.select("policy", "cluster", F.round("stability", 6).alias("stability"), F.round("spread", 6).alias("spread"), "bias", "radius_cap")


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return ev.groupBy("event_type", (F.col("event_id") % 4).alias("shard")).agg(op.unit(F.avg("value") / 100).alias("estimate"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.abs(F.col("value") - 50)).alias("peak"))


_SH = "sh AS (SELECT event_type, event_id % 4 AS shard, least(greatest(avg(value) / 100, 0.0), 1.0) AS estimate, count(*) AS n, round(sum(value), 4) AS total, max(abs(value - 50)) AS peak FROM events GROUP BY ALL)"


@query(f"WITH {_SH} SELECT event_type, round(sum(estimate * n) / sum(n), 6) AS estimate, sum(n)::BIGINT AS n FROM sh GROUP BY event_type")
def weighted_mean_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge_weighted(_shards(spark, sf_dir), ["event_type"], "estimate", "n").withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {_SH} SELECT event_type, sum(n)::BIGINT AS n, arg_max(total, shard) AS last_total, max(peak) AS peak FROM sh GROUP BY event_type")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).groupBy("event_type").agg(F.sum("n").alias("n"), F.max_by("total", "shard").alias("last_total"), F.max("peak").alias("peak"))


@query(
    f"""WITH {_SH}, c AS (SELECT event_type, n, i, (estimate + i * 0.01) AS v FROM sh, range(5) t(i))
    SELECT event_type, i, round(sum(v * n) / sum(n), 6) AS v FROM c GROUP BY event_type, i"""
)
def kalman_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _shards(spark, sf_dir).select("event_type", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("estimate") + i * 0.01)).alias("i", "v"))
    return op.merge_weighted(cells.withColumn("i", F.col("i").cast("bigint")), ["event_type", "i"], "v", "n").select("event_type", "i", F.round("v", 6).alias("v"))


@query(
    """WITH a AS (SELECT event_type, user_id % 16 AS cluster, count(*) AS n, count(*) FILTER (value > 50) AS wins FROM events GROUP BY ALL),
    b AS (SELECT event_type, user_id % 16 AS cluster, count(*) AS n, count(*) FILTER (value > 50) AS wins FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
    SELECT event_type, cluster, greatest(a.n - coalesce(b.n, 0), 0) AS n, greatest(a.wins - coalesce(b.wins, 0), 0) AS wins
    FROM a LEFT JOIN b USING (event_type, cluster) WHERE greatest(a.n - coalesce(b.n, 0), a.wins - coalesce(b.wins, 0)) > 0"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value").withColumn("cluster", F.col("user_id") % 16)
    count = [F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("wins")]
    now, then = ev.groupBy("event_type", "cluster").agg(*count), ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("event_type", "cluster").agg(*count)
    return op.saturating_diff(now, then, ["event_type", "cluster"], ["n", "wins"])


@query(
    """WITH s AS (SELECT event_type AS strategy, user_id % 8 AS context, event_id % 4 AS shard, count(*) AS attempts, count(*) FILTER (value > 50) AS successes FROM events GROUP BY ALL)
    SELECT strategy, context, sum(attempts)::BIGINT AS attempts, sum(successes)::BIGINT AS successes, round(sum(successes / attempts * attempts) / sum(attempts), 6) AS rate FROM s GROUP BY strategy, context"""
)
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    s = ev.groupBy(F.col("event_type").alias("strategy"), (F.col("user_id") % 8).alias("context"), (F.col("event_id") % 4).alias("shard")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("successes")
    )
    return s.groupBy("strategy", "context").agg(
        F.sum("attempts").alias("_a"), F.sum("successes").alias("successes"), F.round(F.sum(F.col("successes") / F.col("attempts") * F.col("attempts")) / F.sum("attempts"), 6).alias("rate")
    ).withColumnRenamed("_a", "attempts")


@query(f"WITH {_S}, {_BOUNDS}, {_EMA} SELECT policy || '|' || cluster AS key, decisions, outcomes, floor({_clamp('decision_ema')} * 10000 + 0.5)::INT AS decision_bp, floor({_clamp('outcome_ema')} * 10000 + 0.5)::INT AS outcome_bp FROM e")
def cluster_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_ema(stats(spark, sf_dir))
    return found.select(
        F.concat_ws("|", "policy", F.col("cluster").cast("string")).alias("key"), "decisions", "outcomes", op.to_bp(F.col("decision_ema")).alias("decision_bp"), op.to_bp(F.col("outcome_ema")).alias("outcome_bp")
    ).orderBy("key")
