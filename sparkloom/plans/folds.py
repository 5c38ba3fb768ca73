"""Ordered folds over ``events`` in the order of (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as op
from ..session import table
from .registry import query

_RUN = "WITH RECURSIVE x AS (SELECT event_type || ':' || user_id AS k, value AS v, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each policy (event type) and file (user) the history, by ``k``; both together bound its length."""
    rows = _events(spark, sf_dir).select(F.concat_ws(":", "event_type", "user_id").alias("k"), "ts", "event_id", (F.col("value") / 100).alias("x"))
    return op.series(rows, ["k"], ["ts", "event_id"], ["x"])


@query(
    _RUN + """, f AS (SELECT k, 1::BIGINT AS i, least(greatest(0.5 + 0.2 * (v / 100 - 0.5), 0.0), 1.0) AS m FROM x WHERE i = 1
    UNION ALL SELECT x.k, x.i, least(greatest(m + 0.2 * (v / 100 - m), 0.0), 1.0) FROM f JOIN x ON x.k = f.k AND x.i = f.i + 1)
    SELECT k, round(arg_max(m, i), 6) AS ema, max(i) AS n FROM f GROUP BY k"""
)
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("k", F.round(op.ema(F.col("xs"), "x", 0.2, 0.5), 6).alias("ema"), F.size("xs").cast("bigint").alias("n"))


@query(
    """WITH RECURSIVE x AS (SELECT user_id AS k, (value * 1000)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type <> 'error'),
    f AS (SELECT k, i, v AS m FROM x WHERE i = 1 UNION ALL SELECT x.k, x.i, CASE WHEN m = 0 THEN v ELSE (7 * m + v) // 8 END FROM f JOIN x ON x.k = f.k AND x.i = f.i + 1)
    SELECT k AS user_id, arg_max(m, i) AS ewma, max(i) AS samples FROM f GROUP BY k"""
)
def ewma_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type <> 'error'").withColumn("x", F.round(F.col("value") * 1000).cast("bigint"))
    found = op.series(rows, ["user_id"], ["ts", "event_id"], ["x"])
    return found.select("user_id", op.integer_ewma(F.col("xs"), "x").alias("ewma"), F.size("xs").cast("bigint").alias("samples"))


_K = """, f AS (
  SELECT k, 1::BIGINT AS i, least(greatest(v / 100, 0.0), 1.0) AS e, 0.02::DOUBLE AS p, 0.0001::DOUBLE AS q, 0.02::DOUBLE AS r FROM x WHERE i = 1
  UNION ALL
  SELECT k, i, least(greatest(e + g * y, 0.0), 1.0), greatest((1 - g) * pp, 1e-12),
    CASE WHEN n >= 3 THEN least(greatest((1 - a) * q + a * (g * y * g * y + greatest((1 - g) * pp, 1e-12) - p), 1e-6), 0.05 * (1 - mt * 0.5) + 0.05 * 0.5) ELSE q END,
    CASE WHEN n >= 3 THEN least(greatest((1 - a) * r + a * (y * y - pp), 0.002), 0.15 * (1 - mt * 0.5) + 0.15 * 0.5) ELSE r END
  FROM (SELECT x.k, x.i, f.e, f.p, f.q, f.r, f.i AS n, f.p + f.q AS pp, least(greatest(v / 100, 0.0), 1.0) - f.e AS y, (f.p + f.q) / (f.p + f.q + f.r) AS g,
      CASE WHEN f.i >= 3 THEN 1 / least((f.i - 1)::DOUBLE, 20.0) END AS a, least(f.i / 20.0, 1.0) AS mt
    FROM f JOIN x ON x.k = f.k AND x.i = f.i + 1))"""


@query(_RUN + _K + " SELECT k, round(arg_max(e, i), 6) AS estimate, round(arg_max(p, i), 6) AS variance, max(i)::INT AS n FROM f GROUP BY k")
def scalar_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = op.scalar_kalman(F.col("xs"), "x")
    rows = _series(spark, sf_dir).select("k", s.alias("s"))
    return rows.select("k", F.round("s.e", 6).alias("estimate"), F.round("s.v", 6).alias("variance"), F.col("s.n").alias("n"))


@query(
    _RUN + _K + """, z AS (SELECT k, arg_max(e, i) AS e, sqrt(arg_max(p, i)) AS d FROM f GROUP BY k)
    SELECT k, round(length(k) * 10 - e * 0.8 * (1 - least(d, 1.0)) * 30.0, 4) AS priority, round(e * 0.8 * (1 - least(d, 1.0)), 6) AS repair_weight FROM z"""
)
def dynamic_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = op.scalar_kalman(F.col("xs"), "x")
    rows = _series(spark, sf_dir).select("k", s.alias("s"))
    weight = F.col("s.e") * 0.8 * (1 - F.least(F.sqrt("s.v"), F.lit(1.0)))
    return rows.select("k", F.round(F.length("k") * 10 - weight * 30.0, 4).alias("priority"), F.round(weight, 6).alias("repair_weight"))


@query(
    """WITH RECURSIVE x AS (SELECT k, i, precision >= 0.94 AS passed, precision, recall, mr, n >= 50 AS enough, 2 AS req FROM (
      SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, 0.9 + 0.1 * hi AS precision, 0.8 + 0.2 * hi AS recall, 0.85 + 0.15 * hi AS mr, n
      FROM (SELECT event_type, ts::DATE AS day, count(*) AS n, count(*) FILTER (value > 20) / count(*) AS hi FROM events GROUP BY 1, 2))),
    f AS (SELECT k, 0::BIGINT AS i, 1 AS lv, 0 AS ps, 0 AS fs, 0 AS up, 0 AS dn, false AS armed FROM x WHERE i = 1
    UNION ALL
    SELECT k, i, CASE WHEN enough THEN lv + rise - fall ELSE lv END, CASE WHEN NOT enough THEN ps WHEN rise + fall > 0 THEN 0 ELSE p2 END,
      CASE WHEN NOT enough THEN fs WHEN rise + fall > 0 THEN 0 ELSE f2 END, CASE WHEN enough THEN up + rise ELSE up END, CASE WHEN enough THEN dn + fall ELSE dn END,
      enough AND (CASE WHEN rise + fall > 0 THEN 0 ELSE p2 END) >= (CASE lv + rise - fall WHEN 2 THEN least(req, 2) WHEN 1 THEN greatest(req, 2) ELSE greatest(req + 1, 3) END)
    FROM (SELECT *, (passed AND ((lv = 0 AND p2 >= 3 AND precision >= 0.94 AND recall >= 0.78 AND mr >= 0.85) OR (lv = 1 AND p2 >= 5 AND precision >= 0.98 AND recall >= 0.94 AND mr >= 0.95)))::INT AS rise,
        (NOT passed AND ((lv = 2 AND f2 >= 2) OR (lv = 1 AND f2 >= 3)))::INT AS fall
      FROM (SELECT x.*, f.lv, f.ps, f.fs, f.up, f.dn, CASE WHEN passed THEN f.ps + 1 ELSE 0 END AS p2, CASE WHEN passed THEN 0 ELSE f.fs + 1 END AS f2 FROM f JOIN x ON x.k = f.k AND x.i = f.i + 1)))
    SELECT k AS event_type, arg_max(lv, i) AS level, arg_max(ps, i) AS passes, arg_max(fs, i) AS fails, arg_max(up, i) AS promotions, arg_max(dn, i) AS demotions, arg_max(armed, i) AS armed FROM f GROUP BY k"""
)
def rollout_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("hi"))
    seen = days.select(
        "event_type", "day", (0.9 + 0.1 * F.col("hi") >= 0.94).alias("passed"), (0.9 + 0.1 * F.col("hi")).alias("precision"), (0.8 + 0.2 * F.col("hi")).alias("recall"),
        (0.85 + 0.15 * F.col("hi")).alias("match_ratio"), (F.col("n") >= 50).alias("enough"), F.lit(2).alias("required"),
    )
    rows = op.series(seen, ["event_type"], ["day"], ["passed", "precision", "recall", "match_ratio", "enough", "required"]).select("event_type", op.rollout(F.col("xs")).alias("s"))
    return rows.select("event_type", *(F.col(f"s.{a}").alias(b) for a, b in (("level", "level"), ("passes", "passes"), ("fails", "fails"), ("up", "promotions"), ("down", "demotions"), ("armed", "armed"))))


@query()
def kalman5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five signals of an event's value per user; rows-only, since the fold inverts matrices."""
    rows = _events(spark, sf_dir).selectExpr(
        "user_id", "ts", "event_id", "least(value / 100, 1) AS d0", "least(value / 200, 1) AS d1", "CASE WHEN event_type = 'view' THEN 0.9 ELSE 0.4 END AS d2", "(event_id % 10) / 10.0D AS d3", "least(sqrt(value) / 20, 1) AS d4"
    )
    return op.kalman5(rows, "user_id", ["ts", "event_id"], [f"d{i}" for i in range(5)])
