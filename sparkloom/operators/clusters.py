"""Learning by policy and cluster: counters, confidence bounds, controls, averages and merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores, weights and thresholds of the estimators.
WILSON_Z = 1.959963984540054
DECISION_SCORES = {"apply": 1.0, "apply_partial": 0.72, "block": 0.05}
OUTCOME_SCORES = {"accepted": 1.0, "regressed": 0.25, "reverted": 0.0}
DECISION_ALPHA = 0.22
OUTCOME_ALPHA = 0.26
LEAST_DECISIONS = 6
DECISION_WEIGHT = 0.45
OUTCOME_WEIGHT = 0.55


@dataclass(frozen=True)
class Trust:
    """Estimate and deviation of the trust dimension, which the controls' thresholds scale with."""

    estimate: float = 0.85
    deviation: float = 0.05**0.5


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def counters(decisions: DataFrame) -> DataFrame:
    """Decisions by policy (lower case) and cluster."""
    return decisions.groupBy(F.lower("policy").alias("policy"), "cluster").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in DECISION_SCORES))


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """Outcomes by policy and cluster, one for each distinct key of a file."""
    once = outcomes.select("file_id", F.lower("policy").alias("policy"), "cluster", "outcome").distinct()
    return once.groupBy("policy", "cluster").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_SCORES))


def wilson(successes: Column, failures: Column) -> tuple[Column, Column]:
    """Wilson score interval at 95 %; (0.5, 0.5) without observations."""
    n = (successes + failures).cast("double")
    z2 = WILSON_Z * WILSON_Z
    p = successes / n
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * WILSON_Z / (1 + z2 / n)
    none = n == 0
    return F.when(none, 0.5).otherwise(unit(centre - margin)), F.when(none, 0.5).otherwise(unit(centre + margin))


def beta(successes: Column, failures: Column) -> tuple[Column, Column]:
    """Mean of the posterior under a uniform prior, less and plus z deviations."""
    a, b = successes + 1.0, failures + 1.0
    mean = a / (a + b)
    margin = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * WILSON_Z
    return unit(mean - margin), unit(mean + margin)


def ema_batch(current: Column, alpha: float, mean: Column, count: Column) -> Column:
    """The average after ``count`` steps towards ``mean`` at once."""
    keep = F.pow(F.lit(1 - min(max(alpha, 0.0001), 1.0)), count.cast("double"))
    return F.when(count == 0, unit(current)).otherwise(unit(current * keep + mean * (1 - keep)))


def weighted_mean(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return F.when(wa == 0, unit(b)).when(wb == 0, unit(a)).otherwise(unit((a * wa + b * wb) / (wa + wb)))


def to_bp(x: Column) -> Column:
    """Ratio as basis points."""
    return F.floor(unit(x) * 10000 + 0.5).cast("int")


def from_bp(x: Column) -> Column:
    return unit(x / 10000.0)


def mean_scores(stats: DataFrame) -> DataFrame:
    """Decision and outcome totals and mean scores of counted rows."""
    d, o = sum((F.col(k) for k in DECISION_SCORES), F.lit(0)), sum((F.col(k) for k in OUTCOME_SCORES), F.lit(0))
    return stats.withColumns(
        {
            "decisions": d,
            "outcomes": o,
            "decision_mean": sum((F.col(k) * v for k, v in DECISION_SCORES.items()), F.lit(0.0)) / F.nullif(d, F.lit(0)),
            "outcome_mean": sum((F.col(k) * v for k, v in OUTCOME_SCORES.items()), F.lit(0.0)) / F.nullif(o, F.lit(0)),
        }
    )


def controls(stats: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """bias (Relax, Harden, Neutral) and radius_cap (1, 3, null) of rows with counters and the averages decision_ema and outcome_ema."""
    fails = F.col("regressed") + F.col("reverted")
    wl, wu = wilson(F.col("accepted"), fails)
    bl, bu = beta(F.col("accepted"), fails)
    lower, upper = F.least(wl, bl), F.greatest(wu, bu)
    combined = unit(F.col("decision_ema")) * DECISION_WEIGHT + unit(F.col("outcome_ema")) * OUTCOME_WEIGHT
    e, s = trust.estimate, trust.deviation
    rows = stats.withColumns(
        {
            "lower": lower,
            "spread": unit(upper - lower),
            "stability": unit(combined * 0.55 + lower * 0.45),
            "revert_rate": F.coalesce(F.col("reverted") / F.nullif(F.col("outcomes"), F.lit(0)), F.lit(0.0)),
        }
    )
    st, sp = F.col("stability"), F.col("spread")
    few = F.col("decisions") < LEAST_DECISIONS
    bias = (
        F.when(few, "Neutral")
        .when((st >= e * 16 / 17) & (sp < s * 0.805), "Relax")
        .when((st <= e * 11 / 17) | (sp > s * 1.966) | (F.col("revert_rate") >= s * 0.983), "Harden")
        .otherwise("Neutral")
    )
    cap = F.when(few, None).when((st < e * 8 / 17) | (F.col("lower") < e * 6 / 17), 1).when((st < e * 12 / 17) | (sp > s * 1.5625), 3)
    return rows.withColumns({"bias": bias, "radius_cap": cap})


def saturating_diff(now: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Growth of counters since a snapshot, never below 0; rows without growth are left out."""
    old = before.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    joined = now.join(old, keys, "left").select(*keys, *(F.greatest(F.col(v) - F.coalesce(f"_{v}", F.lit(0)), F.lit(0)).alias(v) for v in values))
    return joined.where(F.greatest(*values) > 0 if len(values) > 1 else F.col(values[0]) > 0)


def merge_weighted(shards: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of shards' estimates by their observations, and the observations."""
    return shards.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))
