"""Streaming forms of the report summary and the scalar filter.

The reference semantics are in processing order without watermarks, so the
summary is a complete-mode aggregate and the filter keeps one state a key,
kept by Spark's state store and checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import LEAST, SCALAR, WINDOW
from ..session import importable


def report_stream(runs: DataFrame) -> DataFrame:
    """Running count, total and greatest time by policy; write in complete or update mode."""
    return runs.groupBy("policy").agg(F.count("*").alias("n_runs"), F.sum("elapsed_ms").alias("total_ms"), F.max("elapsed_ms").alias("max_ms"))


def observe(state: tuple, z: float) -> tuple:
    """(estimate, variance, q, r, n) after one observation."""
    e, v, q, r, n = state
    z = min(max(z, 0.0), 1.0)
    if not n:
        return z, SCALAR["r"], q, r, 1
    p = v + q
    g = p / (p + r)
    y = z - e
    new = max((1 - g) * p, 1e-12)
    if n >= LEAST:
        a, mature = 1 / min(n - 1, WINDOW), min(n / WINDOW, 1.0)
        r = min(max((1 - a) * r + a * (y * y - p), SCALAR["r_floor"]), SCALAR["r_ceil"] * (1 - mature * 0.5) + SCALAR["r_ceil"] * 0.5)
        q = min(max((1 - a) * q + a * ((g * y) ** 2 + new - v), SCALAR["q_floor"]), SCALAR["q_ceil"] * (1 - mature * 0.5) + SCALAR["q_ceil"] * 0.5)
    return min(max(e + g * y, 0.0), 1.0), new, q, r, n + 1


def kalman_stream(obs: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The filter's estimate for each key after every batch (update mode); a batch's rows go in the order of ``order``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, SCALAR["variance"], SCALAR["q"], SCALAR["r"], 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for z in rows[value].tolist():
            now = observe(now, z)
        state.update(tuple(now))
        yield pd.DataFrame([[k[0], now[0], now[1], now[4]]], columns=[key, "estimate", "variance", "n"])

    kind = dict(obs.dtypes)[key]
    return obs.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, estimate double, variance double, n int", "e double, v double, q double, r double, n int", "update", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, path: str, like: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into ``path``, with the schema of ``like``."""
    importable(spark)
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
