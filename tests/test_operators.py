"""Fixed vectors and reference folds for what SQL does not check."""

import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names as fn
from sparkloom.operators import clusters, decisions, edits, folds, graphs, joins, lookups, ranking, resolution, scheduling, texts
from sparkloom.sources import readers, writers
from sparkloom.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reverts_and_claims(spark):
    e = spark.createDataFrame([(1, "p1", 10, "A", "B", 500), (2, "p2", 10, "B", "A", 500)], "seq int, policy string, line int, before string, after string, priority int")
    assert [tuple(r) for r in resolution.reverts(e).collect()] == [(10, "p1", "p2")]
    up = spark.createDataFrame([(1, "naming", 1, "a", "b", 700), (2, "format", 1, "b", "c", 1000)], "seq int, policy string, line int, before string, after string, priority int")
    assert {r.policy: r.status for r in resolution.line_claims(up).collect()} == {"naming": "suppressed", "format": "claimed"}
    down = spark.createDataFrame([(1, "format", 1, "a", "b", 1000), (2, "naming", 1, "b", "c", 700)], "seq int, policy string, line int, before string, after string, priority int")
    assert {r.policy: r.status for r in resolution.line_claims(down).collect()} == {"format": "claimed", "naming": "dropped"}


def test_graph_vectors(spark):
    e = spark.createDataFrame([("f", "s", "reference", 1, 1), ("f", "s", "reference", 1, 2)], "src string, dst string, kind string, weight long, last_seen long")
    assert [r.weight for r in graphs.upsert(e).collect()] == [2]
    nodes = spark.createDataFrame([("f", True, 9000), ("s", False, 9000), ("old", False, 1000)], "id string, is_file boolean, last_seen long")
    edges = spark.createDataFrame([("f", "s", "contains", 1, 9000), ("f", "old", "contains", 1, 1000)], "src string, dst string, kind string, weight long, last_seen long")
    metrics = spark.createDataFrame([("s", 3, 5), ("old", 1, 1)], "id string, n_refs long, n_files long")
    n, k, m, t = graphs.compact(nodes, edges, metrics, 10000, 2000, 100, 100)
    assert {r.id for r in n.collect()} == {"f", "s"} and k.count() == 1
    assert [(r.id, r.n_files) for r in m.collect()] == [("s", 1)] and [r.id for r in t.collect()] == ["old"]
    pairs = spark.createDataFrame([("a", "b", 3, 1000)], "loser string, winner string, n long, last_seen long")
    assert [r.n for r in graphs.decayed(pairs, 2000, 1000, 2).collect()] == [2] and not graphs.decayed(pairs, 3000, 1000, 2).collect()
    assert [r.n for r in graphs.decayed(pairs.withColumn("n", F.lit(10)), 1000, 1000, 2).collect()] == [10]


def test_impact_vectors(spark):
    edges = spark.createDataFrame([("a", "S", "contains", 1, 0), ("b", "S", "reference", 1, 0), ("c", "T", "reference", 1, 0)], "src string, dst string, kind string, weight long, last_seen long")
    none = spark.createDataFrame([], "id string, n_refs long, n_files long, consensus double")
    seed = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in graphs.impact(edges, none, seed, 1, 10).collect()] == ["b"]
    many = spark.createDataFrame([("a", "S", "contains", 1, 0)] + [(f"n{i}", "S", "reference", 1, 0) for i in range(6)], edges.schema)
    assert graphs.impact(many, none, seed, 1, 3).count() == 3


def test_blended_cost(spark):
    cost = lambda n, e, p: one(spark, scheduling.blended_cost(F.lit(100), F.lit(e), F.lit(p), F.lit(n)))
    assert cost(2, 900, 100) == 100 and cost(3, 900, 100) == 300


def test_integer_ewma(spark):
    rows = spark.createDataFrame([("p", 1, 80), ("p", 2, 160)], "k string, seq int, v long")
    assert folds.series(rows, ["k"], ["seq"], ["v"]).select(folds.integer_ewma(F.col("xs"), "v").alias("x")).first().x == 90


def test_rollout_arms_after_two_passes(spark):
    obs = [("p", i, True, 0.95, 0.90, 0.90, True, 2) for i in range(2)]
    rows = spark.createDataFrame(obs, "k string, seq int, passed boolean, precision double, recall double, match_ratio double, enough boolean, required int")
    for n, armed in ((1, False), (2, True)):
        s = folds.series(rows.where(F.col("seq") < n), ["k"], ["seq"], ["passed", "precision", "recall", "match_ratio", "enough", "required"])
        assert s.select(folds.rollout(F.col("xs")).alias("s")).first().s.armed is armed


def test_kalman5():
    f = folds.Kalman5()
    f.observe(np.full(5, 0.3))
    assert np.array_equal(f.x, np.full(5, 0.3))
    for _ in range(20):
        f.observe(np.full(5, 0.3))
    assert np.abs(f.x - 0.3).max() < 0.02
    g = folds.Kalman5()
    for _ in range(10):
        g.observe(np.full(5, 0.82))
    g.observe(np.full(5, 0.60))
    assert g.x.min() > 0.72 and np.linalg.eigvalsh(g.p)[0] > 0


def test_kalman5_ignores_row_order(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, *(rng.random() for _ in range(5))) for i in range(60)]
    schema = "k long, seq long, " + ", ".join(f"d{i} double" for i in range(5))
    run = lambda r: sorted(map(tuple, folds.kalman5(spark.createDataFrame(r, schema), "k", ["seq"], [f"d{i}" for i in range(5)]).collect()))
    first = run(rows)
    rng.shuffle(rows)
    assert run(rows) == first


def test_scalar_kalman_matches_plain_fold(spark):
    rng = random.Random(2)
    rows = [(i, rng.random()) for i in range(40)]
    got = folds.series(spark.createDataFrame([("k", *r) for r in rows], "k string, seq int, v double"), ["k"], ["seq"], ["v"]).select(folds.scalar_kalman(F.col("xs"), "v").alias("s")).first().s
    now = (0.0, 0.10, 0.0001, 0.02, 0)
    for _, z in rows:
        now = state.observe(now, z)
    assert got.e == pytest.approx(now[0], abs=1e-12) and got.v == pytest.approx(now[1], abs=1e-12) and got.n == 40


def test_controls_not_harden_when_all_is_well(spark):
    rows = spark.createDataFrame([(24, 0, 0, 24, 0, 0)], "apply long, apply_partial long, block long, accepted long, regressed long, reverted long")
    s = clusters.mean_scores(rows).withColumns({"decision_ema": F.lit(1.0), "outcome_ema": F.lit(1.0)})
    assert clusters.controls(s).first().bias != "Harden"


def test_independent_set_takes_the_two_smaller(spark):
    c = spark.createDataFrame([(1, "p", 20, 2.0, 0.5, 0), (2, "q", 21, 1.5, 0.5, 0), (3, "r", 23, 1.5, 0.5, 0)], "id long, policy string, line long, weight double, confidence double, risk int")
    e = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {r.id for r in resolution.independent_set(c, e).collect()} == {2, 3}


def test_large_components_are_solved_by_joins_alike(spark, monkeypatch):
    rng = random.Random(9)
    c = [(i, rng.choice("pq"), rng.randrange(40), float(rng.randint(0, 5)), 0.5, rng.choice([None, 0, 1])) for i in range(300)]
    e = list({(i, j) for i, j in ((rng.randrange(300), rng.randrange(300)) for _ in range(500)) if i < j} | {(i, i + 1) for i in range(299)})
    cands = spark.createDataFrame(c, "id long, policy string, line long, weight double, confidence double, risk int")
    edges = spark.createDataFrame(e, "a long, b long")
    want = sorted(map(tuple, resolution.independent_set(cands, edges).collect()))
    near = {i: {a + b - i for a, b in e if i in (a, b)} for i in range(300)}
    order = sorted(c, key=lambda x: (-x[3], -x[4], float("inf") if x[5] is None else x[5], x[2], x[1], x[0]))
    chosen = set()
    for x in order:
        if not near[x[0]] & chosen:
            chosen.add(x[0])
    assert {x[1] for x in want} == chosen
    monkeypatch.setattr(resolution, "IN_TASK", 5)
    assert sorted(map(tuple, resolution.independent_set(cands, edges).collect())) == want
    assert resolution.independent_set(cands.limit(0), edges.limit(0)).count() == 0


def test_small_components_are_no_groups_of_their_own(spark):
    rng = random.Random(4)
    c = [(i, rng.choice("pq"), rng.randrange(40), rng.choice([-1.0, 0.0, 1.0, 1.5, 2.0]), 0.5, 0) for i in range(60)]
    e = [(i, i + 1) for i in range(0, 40) if i % 4 < 3]  # chains of four, the rest alone
    cands = spark.createDataFrame(c, "id long, policy string, line long, weight double, confidence double, risk int")
    found = resolution.independent_set(cands, spark.createDataFrame(e, "a long, b long"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: r for r in found.collect()}
    assert not any(a in rows and b in rows for a, b in e) and all(rows[i].line == c[i][2] for i in rows)
    for k in [*range(10), *range(40, 60)]:
        part = c[4 * k : 4 * k + 4] if k < 10 else [c[k]]
        sets = [s for n in range(len(part) + 1) for s in itertools.combinations(part, n) if not any((x[0], y[0]) in e for x in s for y in s)]
        best = max(sum(max(0.0, x[3]) for x in s) for s in sets)
        least = min(sorted((x[2], x[1]) for x in s) for s in sets if sum(max(0.0, x[3]) for x in s) == best)
        assert sorted((c[i][2], c[i][1]) for i in rows if i in {x[0] for x in part}) == least


def test_conflicts_by_symbol_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        line = rng.randrange(400)
        rows.append((i, rng.choice("pqr"), line, line, line + rng.randrange(20), rng.sample("abc", rng.randint(0, 2)), rng.choice([0, 1, 3, 40])))
    d = spark.createDataFrame(rows, "id long, policy string, line long, s long, e long, symbols array<string>, radius int")
    want = set()
    for x, y in itertools.combinations(rows, 2):
        over, near = x[3] <= y[4] and y[3] <= x[4], abs(x[2] - y[2]) <= max(x[6], y[6], 1) and set(x[5]) & set(y[5])
        if x[2] == y[2] or x[1] != y[1] and (over or near):
            want.add((x[0], y[0]))
    assert {(r.a, r.b) for r in resolution.conflict_edges(d).collect()} == want


def test_source_consensus_against_all_pairs(spark):
    rng = random.Random(6)
    name = lambda: (rng.choice(["", "src", "lib"]), rng.choice(["", "a", "ab", "abc", "b", "bc"]), rng.choice(["", "cc", "cpp"]))
    targets = [(i, *name()) for i in range(40)]
    entries = [(i, *name(), rng.randrange(12), rng.choice(["-Isrc", "-Ilib -Isrc", ""])) for i in range(200)]
    got = lookups.source_consensus(
        spark.createDataFrame(targets, "path long, dir string, stem string, ext string"), spark.createDataFrame(entries, "path long, dir string, stem string, ext string, args long, include string")
    )
    want = set()
    for path, d, stem, ext in targets:
        best = {}
        for q, qd, qs, qe, args, include in entries:
            score = (6 if d and d == qd else 0) + (2 if ext and ext == qe else 0) + (1 if d and d in include else 0)
            if stem and qs:
                score += 10 if stem == qs else 6 if stem.startswith(qs) or qs.startswith(stem) else 0
            if score >= 12:
                best[args] = min(best.get(args, (0, 0)), (-score, q))
        want |= {(path, q, -s, args, k) for k, (s, q, args) in enumerate(sorted((s, q, args) for args, (s, q) in best.items())[:6], 1)}
    assert {(r.target, r.path, r.score, r.args, r.place) for r in got.collect()} == want


def test_places_within_keys_of_any_size(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 20 + ["a", None]), rng.randrange(5), i) for i in range(2000)]
    d = spark.createDataFrame(rows, "run string, w int, id int").repartition(7)
    got = {r.id: r.position for r in ranking.numbered(d, ["run"], [F.desc("w"), "id"]).collect()}
    for key in ("hot", "a", None):
        order = sorted((-w, i) for k, w, i in rows if k == key)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert ranking.numbered(d.limit(0), ["run"], ["w"]).count() == 0


def test_fingerprints_by_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), f"x={rng.randrange(900)}ä") for _ in range(1500)] + [("one", ""), ("a", None)]
    got = joins.fingerprint_by_key(spark.createDataFrame(rows, "k string, line string").repartition(5), "k", "line")
    want = {}
    for k in ("hot", "a", None, "one"):
        text = "\n".join(sorted(x for q, x in rows if q == k and x is not None)).encode()
        want[k] = f"{zlib.crc32(text):08x}-{len(text):x}"
    assert {r.k: r.fingerprint for r in got.collect()} == want


def test_exact_set_against_all_subsets():
    import pandas as pd

    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 8)
        w = sorted((rng.choice([0.5, 1.0, 1.5, -1.0]) for _ in range(n)), reverse=True)
        pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}
        bar = [sum(1 << j for j in range(n) if (min(i, j), max(i, j)) in pairs) for i in range(n)]
        keep = resolution.exact(pd.DataFrame({"weight": w, "line": range(n), "policy": ["p"] * n}), bar)
        best = max(sum(max(0, w[i]) for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if not any((i, j) in pairs for i, j in itertools.combinations(s, 2)))
        assert sum(max(0, w[i]) for i in keep) == pytest.approx(best)
        assert not any((i, j) in pairs for i, j in itertools.combinations(sorted(keep), 2))


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    up = list(range(60))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = resolution.components(spark.range(60).select("id"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {i: root(i) for i in range(60)}


def test_lanes_and_batches(spark):
    rng = random.Random(5)
    units = [(f"u{i:03d}", rng.randint(1, 100), 1) for i in range(50)]
    got = scheduling.lanes(spark.createDataFrame(units, "unit string, cost bigint, n_paths bigint"), 4)
    load, want = [0] * 4, {}
    for u, c, _ in sorted(units, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        want[u] = k
        load[k] += c
    assert {r.unit: r.lane for r in got.collect()} == want
    done = scheduling.batches(got, 120).groupBy("lane", "batch").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).collect()
    assert all(r.c <= 120 or r.n == 1 for r in done) and max(r.n for r in done) <= 8


def test_first_k_large(spark, monkeypatch):
    monkeypatch.setattr(ranking, "GATHERED", 10)
    rows = spark.range(0, 1000).withColumn("x", (F.col("id") * 37) % 1000)
    assert sorted(r.x for r in ranking.first_k(rows, ["x"], 300).collect()) == list(range(300))
    assert ranking.first_k(rows, ["x"], 5000).count() == 1000


def test_fingerprint(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "p string")
    t = "a:1|b:2"
    assert joins.fingerprint(rows, "p").first().fingerprint == f"{zlib.crc32(t.encode()):x}-{len(t)}"


def test_names(spark):
    assert one(spark, fn.to_snake(F.lit("HTTPServerName2X"))) == "http_server_name2_x"
    assert one(spark, fn.keyword_operators(F.lit("a&&b || (!c&&d)"))) == "a and b or (!c and d)"
    assert one(spark, fn.guard_macro(F.lit("src/my-file.hpp"))) == "SRC_MY_FILE_HPP_"
    assert one(spark, fn.consensus_stem(F.lit("Parser_benchmark"))) == "parser"
    assert one(spark, fn.rewrite_number(F.lit("1.500"), F.lit("f"), F.lit(True))) == "1.5f"


def test_empty_documents(spark):
    lines = texts.explode_lines(spark.createDataFrame([], "d long, t string"), "d", "t")
    assert texts.dash_comments(lines).count() == texts.disabled_lines(lines, "x").count() == texts.density(lines).count() == 0


def test_scan_and_globs(spark, tmp_path):
    for p in ("src/a.cpp", "src/x/b.hpp", "build/c.cpp", "readme.md"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    found = readers.scan_files(spark, str(tmp_path), ["**/*.cpp", "**/*.{hpp,h}"], ["build/**"])
    assert {r.path for r in found.collect()} == {"src/a.cpp", "src/x/b.hpp"}
    assert not readers.scan_files(spark, str(tmp_path), []).collect()


def test_reports_round_trip(spark, tmp_path):
    src = tmp_path / "in.ndjson"
    src.write_text('{"path": "a", "changed": true, "elapsed_engine_ms": 2.5, "policies": [{"policy": "p", "outcome": "Applied", "edits": [{"line": 1, "before": "x", "after": "y"}]}], "other": 1}\n\nnot json\n')
    recs = readers.read_reports(spark, str(src))
    assert [r.path for r in recs.collect()] == ["a"]
    writers.write_reports(recs, str(tmp_path / "out"))
    assert readers.read_reports(spark, str(tmp_path / "out/records.ndjson")).count() == 1
    assert spark.read.text(str(tmp_path / "out/report.txt")).first().value == "a: changed, 1 policies"


def test_compile_commands(spark, tmp_path):
    p = tmp_path / "cc.json"
    p.write_text('[{"directory": "/w", "file": "a.cpp", "arguments": ["clang", "-I", "inc", "-c", "-o", "a.o", "a.cpp"]}]')
    r = readers.read_compile_commands(spark, str(p)).first()
    assert r.file == "/w/a.cpp" and r.args == ["-I", "inc"]


def test_versions_and_journal(spark, tmp_path):
    at = str(tmp_path / "t")
    assert writers.write_version(spark.range(1), at) == 1 and writers.write_version(spark.range(2), at) == 2
    assert writers.read_version(spark, at).count() == 2 and writers.read_version(spark, at, 1).count() == 1
    j = str(tmp_path / "j")
    writers.append_run(spark, j, "r1", "RUNNING", 5)
    writers.append_run(spark, j, "r1", "SUCCESS", 5)
    writers.append_run(spark, j, "r2", "RUNNING", 6)
    assert {r.run_id: r.status for r in writers.run_states(spark, j).collect()} == {"r1": "SUCCESS", "r2": "RUNNING"}


def test_streams(spark, sf_dir, tmp_path):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = state.read_stream(spark, str(tmp_path / "in"), f"{sf_dir}/events.parquet")
    runs = stream.select(F.col("event_type").alias("policy"), F.col("value").alias("elapsed_ms"))
    q = state.report_stream(runs).writeStream.outputMode("complete").format("memory").queryName("report_out").start()
    q.processAllAvailable()
    q.stop()
    want = {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert {r.policy: r.n_runs for r in spark.table("report_out").collect()} == want
    obs = stream.select("event_type", "event_id", (F.col("value") / 100).alias("z"))
    q = state.kalman_stream(obs, "event_type", "event_id", "z").writeStream.outputMode("update").format("memory").queryName("kalman_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kalman_out").groupBy("event_type").agg(F.max("n").alias("n")).where("n > 0").count() == len(want)


def plain_lenient(lines, edits):
    """The rule, step by step."""
    out, src, offset = [], 0, 0
    for line, before, after in edits:
        index = line - 1 + offset
        adds, drops = not before and after, before and not after
        if index < 0 or (index > len(lines) if adds else index >= len(lines)):
            continue
        while src < index and src < len(lines):
            out.append(lines[src])
            src += 1
        if adds:
            out.append(after)
            offset += 1
        elif src < len(lines) and lines[src] == before:
            src += 1
            if drops:
                offset -= 1
            else:
                out.append(after)
    return "".join(out + lines[src:])


def test_lenient_edits_against_plain_rule(spark):
    rng = random.Random(20)
    rows = []
    for k in range(150):
        lines = [f"l{rng.randrange(3)}\n" for _ in range(rng.randrange(8))]
        made = sorted(((rng.randrange(1, 11), rng.choice(["", "l0\n", "l1\n", *lines]), rng.choice(["", "new\n"])) for _ in range(rng.randrange(5))), key=lambda e: e[0])
        rows.append((k, lines, made))
    df = spark.createDataFrame(rows, "k int, lines array<string>, edits array<struct<line: int, before: string, after: string>>")
    got = {r.k: r.text for r in df.select("k", edits.lenient(F.col("lines"), F.col("edits")).alias("text")).collect()}
    assert got == {k: plain_lenient(x, e) for k, x, e in rows}


def test_assignments_and_clauses(spark):
    lines = ["int x = 1;", "a == b", "f(a = b); y = 2", "std::map<int, std::vector<int>> v = w;", "x += 1; z = 2", '"a = b"', "// x = 1", "A() = delete;", "v << 2 = 3", "é = 1", "", "= default"]
    got = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", edits.assignment_at(F.col("line")), edits.clause_at(F.col("line"))).orderBy("i").collect()]
    assert [g[1] for g in got] == [6, None, 12, 34, 10, None, None, None, 7, 3, None, None]
    assert [g[2] for g in got] == [None] * 7 + [4] + [None] * 4


def test_broken_end_comments_are_put_together(spark):
    before = [(1, 1, "namespace a {\n"), (1, 2, "} // end namespace a with a long name\n"), (1, 3, "X(X) = delete;\n")]
    after = [(1, 1, "namespace a {\n"), (1, 2, "} // end namespace a\n"), (1, 3, "  // with a long name\n"), (1, 4, "X(X)=delete;\n"), (1, 5, "X(X)=delete;\n")]
    schema = "doc int, line_no bigint, line string"
    got = edits.keep_sensitive(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).orderBy("line_no").collect()
    assert [r.line for r in got] == ["namespace a {\n", "} // end namespace a with a long name\n", "X(X) = delete;\n", "X(X)=delete;\n"]


def test_filter_before_any_observation(spark):
    zero = [F.lit(0.85), F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.85)]
    found = decisions.filter_derivations(zero, [F.lit(0.05)] * 5, F.lit(0))
    r = spark.range(1).select(*(c.alias(n) for n, c in found.items())).first()
    assert r.trust_deficit_penalty == 0 and r.confidence_penalty == 0 and r.richness_multiplier == 1 and r.component_threshold == 16 and r.identity_penalty == 90
    assert (r.diagnostic_warning, r.diagnostic_error, r.diagnostic_fatal) == (3, 8, 12) and r.confidence_bp_base == 200


def test_upsert_folds_one_file_after_another(spark):
    empty = spark.createDataFrame([], "id string, consensus double"), spark.createDataFrame([], "id string, n_refs bigint, n_files bigint, score double")
    edges = spark.createDataFrame([("f1", "old", "contains", 1, 1)], "src string, dst string, kind string, weight bigint, last_seen bigint")
    parses = spark.createDataFrame([("f1", True), ("f2", False), ("f3", True)], "file string, success boolean")
    symbols = spark.createDataFrame([("f1", "s"), ("f2", "s"), ("f3", "s"), ("f3", "lone")], "file string, id string")
    refs = spark.createDataFrame([("f1", "s", 2), ("f3", "t", 0)], "file string, id string, n bigint")
    nodes, metrics, out = lookups.graph_upsert(*empty, edges, parses, symbols, refs, 9)
    value = 1.0
    for v in (0.5, 1.0):
        value = 0.85 * value + 0.15 * v
    assert {r.id: r.consensus for r in nodes.collect()} == pytest.approx({"s": value, "lone": 1.0, "t": 1.0})
    got = {r.id: (r.n_refs, r.n_files) for r in metrics.collect()}
    assert got == {"s": (2, 3), "lone": (1, 1), "t": (1, 0), "old": (0, 0)} and out.where("dst = 'old'").count() == 0


def test_checksums_of_ranges_make_that_of_the_whole(spark):
    rows = spark.createDataFrame([(f"p{i % 400}",) for i in range(1000)], "p string")
    counts = sorted(f"p{i}:{sum(j % 400 == i for j in range(1000))}" for i in range(400))
    text = "|".join(counts)
    assert joins.fingerprint(rows, "p").first().fingerprint == f"{zlib.crc32(text.encode()):x}-{len(text)}"
    assert joins.fingerprint(rows.limit(0), "p").first().fingerprint == "0-0"


def test_backups_and_state(spark, tmp_path):
    at, mirror = str(tmp_path / "table"), str(tmp_path / "kept")
    for where in (None, mirror):
        for run in ("r1", "r2", "r3"):
            writers.write_with_backup(spark.createDataFrame([(run,)], "run string"), at + str(bool(where)), run, where)
        status = {r.run_id for r in writers.backup_status(spark, at + str(bool(where)), where).collect()}
        assert status == {"r2", "r3"}
        assert writers.restore(spark, at + str(bool(where)), None, where).first().run == "r2"
        assert writers.restore(spark, at + str(bool(where)), "r2", where).first().run == "r1"
    results = spark.createDataFrame([("a", None, True, "x"), ("b", "bad", True, "y"), ("c", None, False, "z"), ("d", None, True, None)], "path string, error string, changed boolean, pending_text string")
    left = writers.write_phase(results, str(tmp_path / "texts"), "r1")
    assert {r.path: r.changed for r in left.collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "texts")).collect()] == [("a", "x")]
    state = str(tmp_path / "state")
    spark.createDataFrame([("k1", 5, 1.0), ("k2", 6, 2.0), ("k3", 7, 3.0)], "key string, schema_version int, a double").write.parquet(state)
    assert {(r.key, r.a, r.b) for r in writers.load_state(spark, state, 6, "key string, a double, b int").collect()} == {("k1", 1.0, None), ("k2", 2.0, None)}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"not a table")
    assert writers.load_state(spark, str(tmp_path / "broken"), 6, "key string").count() == 0 and (tmp_path / "broken.corrupt").exists()


def test_configuration_fingerprint(spark):
    lines = ["root=a", "check=true"]
    text = "\n".join(lines).encode()
    got = spark.range(1).select(decisions.fingerprint_lines(F.array(*map(F.lit, lines))).alias("x")).first().x
    assert got == f"{zlib.crc32(text):08x}-{len(text):x}"


def test_synthetic_compile_database(spark, tmp_path):
    writers.write_compile_commands(spark.createDataFrame([("src/a.cpp",), ("b.cpp",)], "path string"), str(tmp_path / "db"), "/inc", "c++20")
    rows = {r.file: (r.directory, list(r.arguments)) for r in spark.read.option("multiLine", True).json(str(tmp_path / "db")).collect()}
    arrays = [json.loads(p.read_text()) for p in (tmp_path / "db").glob("part-*") if p.stat().st_size]
    assert sum(map(len, arrays)) == 2 and all(isinstance(x, list) for x in arrays)
    assert {(r.file, tuple(r.args)) for r in readers.read_compile_commands(spark, str(tmp_path / "db")).collect()} == {(f, ("-std=c++20", "-x", "c++", "-fsyntax-only", "-I/inc")) for f in ("src/src/a.cpp", "/inc/b.cpp")}
    assert rows["src/a.cpp"] == ("src", ["clang++", "-std=c++20", "-x", "c++", "-fsyntax-only", "-I/inc", "src/a.cpp"]) and rows["b.cpp"][0] == "/inc"
