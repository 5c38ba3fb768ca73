from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkloom.session import importable, make_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = make_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    importable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def shown(x):
    """A value as text: numbers to six decimals, lists by element, nulls and NaN as nothing."""
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return ""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([shown(y) for y in x])
    if isinstance(x, (bool, str)):
        return str(x)
    return f"{x:.6f}".rstrip("0").rstrip(".") if hasattr(x, "__float__") else str(x)


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(shown(v) for v in r) for r in frame[cols].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return check
