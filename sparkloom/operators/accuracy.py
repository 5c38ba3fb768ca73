"""Accuracy: confusion matrices, gates with thresholds, and the rollout signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import unit

# Thresholds of the rollout profiles (precision, recall, match ratio; least samples).
GATE = {"strict": (0.97, 0.90, 8), "balanced": (0.92, 0.60, 6), "adaptive": (0.85, 0.35, 4)}
BENCHMARK = {"strict": (0.98, 0.94, 0.95, 16), "balanced": (0.94, 0.78, 0.85, 10), "adaptive": (0.90, 0.60, 0.72, 8)}
CONTRACT_POLICIES = ("semantic_contract", "post_edit_check")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 1 if b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0))


def confusion(files: DataFrame) -> DataFrame:
    """One row from files with booleans changed, should_change and exact. A wrong change to a file that needs one is a miss."""
    tp = F.count_if(F.col("changed") & F.col("should_change") & F.col("exact"))
    fn = F.count_if(F.col("should_change") & ~(F.col("changed") & F.col("exact")))
    fp = F.count_if(F.col("changed") & ~F.col("should_change"))
    tn = F.count_if(~F.col("changed") & ~F.col("should_change"))
    counted = files.agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), F.count_if("exact").alias("matches"), F.count("*").alias("files"))
    return counted.withColumns(
        {
            "precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6),
            "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6),
            "match_ratio": F.round(ratio(F.col("matches"), F.col("files")), 6),
        }
    )


def gate(files: DataFrame, profile: str = "balanced", fail_closed: bool = True) -> DataFrame:
    """precision, recall and status of files with attempted_edits, accepted_edits, attempted_violations and context."""
    least_p, least_r, least_n = GATE[profile]
    e, a, v = F.col("attempted_edits"), F.col("accepted_edits"), F.col("attempted_violations")
    rows = files.withColumns(
        {
            "precision": F.when(e == 0, 1.0).otherwise(unit(a / e)),
            "recall": F.when((v == 0) | (e == 0), 1.0).otherwise(unit(a / F.least(v, F.greatest(e, F.lit(1))))),
        }
    )
    misses = F.when(e + v >= least_n, (F.col("precision") + 2.220446049250313e-16 < least_p).cast("int") + (F.col("recall") + 2.220446049250313e-16 < least_r).cast("int")).otherwise(0)
    relaxed = (F.col("context") != "exact") & ~((F.col("context") == "paired") & (misses >= 2))
    status = F.when(misses == 0, "passed").when(relaxed | F.lit(not fail_closed), "warning").otherwise("failed_closed")
    return rows.withColumns({"misses": misses, "status": status})


def rollout_signal(files: DataFrame) -> DataFrame:
    """Means over files that have a gate record (failing) or no error (passing with 1)."""
    failing = F.col("gate_precision").isNotNull()
    seen = failing | F.col("error").isNull()
    n = F.count_if(seen)
    return files.agg(
        n.alias("considered"),
        F.count_if(failing).alias("failing"),
        F.round(F.sum(F.when(failing, unit(F.col("gate_precision"))).when(seen, 1.0)) / n, 6).alias("precision"),
        F.round(F.sum(F.when(failing, unit(F.col("gate_recall"))).when(seen, 1.0)) / n, 6).alias("recall"),
        F.round(F.count_if(seen & ~failing) / n, 6).alias("match_ratio"),
    )


def applied_thresholds(settings: DataFrame) -> DataFrame:
    """Benchmark thresholds under a profile: at least the profile's for strict and balanced, at most for adaptive."""
    out = settings
    for i, c in enumerate(("min_precision", "min_recall", "min_match_ratio", "min_samples")):
        own = F.col(c)
        of = F.when(F.col("profile") == "strict", F.greatest(own, F.lit(BENCHMARK["strict"][i]))).when(F.col("profile") == "balanced", F.greatest(own, F.lit(BENCHMARK["balanced"][i])))
        out = out.withColumn(c, of.otherwise(F.least(own, F.lit(BENCHMARK["adaptive"][i]))))
    return out


def meets(profile: str, precision: Column, recall: Column, match_ratio: Column) -> Column:
    p, r, m, _ = BENCHMARK[profile]
    return (unit(precision) >= p) & (unit(recall) >= r) & (unit(match_ratio) >= m)
