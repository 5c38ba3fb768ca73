"""Every query with SQL against DuckDB, and the others against plain versions over the same tables."""

import collections
import zlib

import numpy as np
import pytest
from sparkloom.operators.folds import Kalman5
from sparkloom.plans import registry, resolution, texts

from . import test_changes


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def rows(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).collect()


def test_kalman5(spark, sf_dir):
    seen = collections.defaultdict(Kalman5)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect():
        seen[r.user_id].observe(np.array([r.value / 100, r.value / 200, 0.9 if r.event_type == "view" else 0.4, r.event_id % 10 / 10, r.value**0.5 / 20]))
    got = rows(spark, sf_dir, "kalman5")
    assert {r.user_id: r.n for r in got} == {k: f.n for k, f in seen.items()}
    for r in got:
        assert [r[f"e{i}"] for i in range(5)] == pytest.approx(list(seen[r.user_id].x)) and all(0 <= r[f"e{i}"] <= 1 for i in range(5))


def test_coverage_fingerprint(spark, sf_dir):
    n = collections.Counter(r.c_nationkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect())
    text = "|".join(sorted(f"{k}:{v}" for k, v in n.items()))
    assert [r.fingerprint for r in rows(spark, sf_dir, "coverage_fingerprint")] == [f"{zlib.crc32(text.encode()):x}-{len(text)}"]


def test_config_fingerprints(spark, sf_dir):
    lines = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        lines[r.p_brand].append(f"policy={r.p_partkey:012d}:{r.p_name}")
    want = {k: "\n".join(sorted(v)).encode() for k, v in lines.items()}
    assert {r.p_brand: r.fingerprint for r in rows(spark, sf_dir, "config_fingerprints")} == {k: f"{zlib.crc32(t):08x}-{len(t):x}" for k, t in want.items()}


def test_independent_set(spark, sf_dir):
    chosen = {r.id for r in rows(spark, sf_dir, "independent_set")}
    pairs = [(r.a, r.b) for r in rows(spark, sf_dir, "conflict_graph")]
    assert chosen and not any(a in chosen and b in chosen for a, b in pairs)
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    every = {r.id for r in rows(spark, sf_dir, "conflict_components")}
    assert chosen <= every and all(near[i] & chosen for i in every - chosen)  # nothing can be put in without a conflict
    cands = {r.id: r for r in resolution._admissible(spark, sf_dir).collect()}
    parts = collections.defaultdict(list)
    for r in rows(spark, sf_dir, "conflict_components"):
        parts[r.component].append(r.id)

    def best(ids):
        """The greatest weight of candidates without conflicts."""
        if not ids:
            return 0.0
        return max(best(ids[1:]), max(0.0, cands[ids[0]].utility) + best([j for j in ids[1:] if j not in near[ids[0]]]))

    for ids in parts.values():
        mine = chosen & set(ids)
        if len(ids) <= 16:
            assert sum(max(0.0, cands[i].utility) for i in mine) == pytest.approx(best(ids), abs=1e-5)
        else:
            want = set()
            for c in sorted((cands[i] for i in ids), key=lambda c: (-c.utility, -c.confidence, c.risk, c.line, c.policy, c.id)):
                if not near[c.id] & want:
                    want.add(c.id)
            assert mine == want


def test_order_of_batches(spark, sf_dir):
    mixed = rows(spark, sf_dir, "interleaved_batches")
    assert [(r.batch, r.lane) for r in mixed] == sorted((r.batch, r.lane) for r in mixed)


def test_keyword_operators(spark, sf_dir):
    stop = set(" \t\n\r\f\v)]};,:?")

    def plain(line):
        out, i, n = "", 0, len(line)
        words = {"&&": "and", "||": "or"}
        while i < n:
            sign = line[i : i + 2]
            if sign in words:
                before, after = line[i - 1] if i else " ", line[i + 2 : i + 3]
                out += (" " if before not in " \t\n\r\f\v([{" else "") + words[sign] + (" " if after and after not in stop and line[i + 2 : i + 4] not in words else "")
                i += 2
            else:
                out, i = out + line[i], i + 1
        return out

    src = texts.lines(spark, sf_dir, "substr(line, 1, 8) || '&&' || substr(line, 9, 4) || ' ||!' || line_no").collect()
    clean = {(r.doc, r.line_no): plain(r.line) for r in src if "&&&" not in r.line and "|||" not in r.line}
    got = {(r.doc, r.line_no): r.line for r in rows(spark, sf_dir, "keyword_operators")}
    assert len(got) == len(src) and {k: got[k] for k in clean} == clean


def test_every_query_without_sql_is_tested_here():
    here = {k[5:] for k in [*globals(), *vars(test_changes)] if k.startswith("test_")}
    assert set(registry.QUERIES) - set(registry.ORACLES) <= here


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
