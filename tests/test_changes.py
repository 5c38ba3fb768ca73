"""Includes, moved blocks and aligned declarations against plain versions."""

import itertools
import os
import random
from collections import Counter

from pyspark.sql import functions as F
from sparkloom.operators import includes, layout
from sparkloom.plans import registry
from sparkloom.plans import changes, source  # isort: skip  (the registry comes first)


def test_paths_become_normal(spark):
    paths = ["a/./b/../c.h", "../x.h", "/a/../../b", "a//b/", "./a", "", "../../a/..", "a/b/../../c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", includes.normal(F.col("p")).alias("n"))
    for r in df.collect():
        want = os.path.normpath(r.p) if r.p else ""
        if r.p.startswith("/"):
            assert r.n.replace("/..", "").lstrip("/") == want.lstrip("/")
        else:
            assert r.n == want


def test_includes_take_the_first_file_on_their_path(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.h", "b/x.h", "b/y.h", "b/sub/z.h", "/abs.h")], "path string")
    rows = [("a/m.c", "x.h", True), ("c/m.c", "x.h", True), ("a/m.c", "x.h", False), ("a/m.c", "../b/y.h", True), ("a/m.c", "sub/z.h", False), ("a/m.c", "none.h", True), ("a/m.c", "/abs.h", False), (None, "x.h", True), ("a/m.c", None, True), ("a/m.c", "x.h", True)]
    got = includes.resolved(spark.createDataFrame(rows, "file string, name string, quoted boolean"), files, ["b", "a"]).collect()
    want = ["a/x.h", "b/x.h", "b/x.h", "b/y.h", "b/sub/z.h", None, "/abs.h", None, None, "a/x.h"]
    assert Counter(tuple(r[c] for c in ("file", "name", "quoted", "target")) for r in got) == Counter((*r, t) for r, t in zip(rows, want))


def test_closure_with_cycles(spark):
    rng = random.Random(5)
    edges = [(f"f{rng.randrange(25)}", f"f{rng.randrange(25)}") for _ in range(40)] + [("f1", None)]
    got = {(r.file, r.included): r.depth for r in includes.closure(spark.createDataFrame(edges, "file string, target string")).collect()}
    want = {}
    for start in {a for a, _ in edges}:
        now, depth = {start}, 0
        while now:
            depth += 1
            now = {b for a, b in edges if a in now and b and (start, b) not in want}
            want |= {(start, b): depth for b in now}
    assert got == want


def test_blocks_move_and_come_back(spark):
    rng = random.Random(8)
    rows, blocks, back = [], [], []
    want = {}
    for d in range(12):
        n = rng.randrange(1, 40)
        text = [f"{d}-{i}" for i in range(1, n + 1)]
        rows += [(d, i, x) for i, x in enumerate(text, 1)]
        spans, at = [], 1
        while at <= n:
            at += rng.randrange(3)
            end = at + rng.randrange(4)
            if end > n:
                break
            spans.append((at, end))
            at = end + 1
        order = rng.sample(range(len(spans)), len(spans))
        blocks += [(d, *s, order.index(k)) for k, s in enumerate(spans)]
        out, last, place = [], 0, []
        for k, (a, e) in enumerate(spans):
            out += text[last : a - 1]
            s, t = spans[order[k]]
            place.append((len(out) + 1, len(out) + 1 + t - s, order[k]))
            out += text[s - 1 : t]
            last = e
        want[d] = out + text[last:]
        back += [(d, *p) for p in place]
    lines = spark.createDataFrame(rows, "doc long, line_no long, line string")
    kind = "doc long, first long, last long, rank long"
    moved = layout.reordered(lines, spark.createDataFrame(blocks, kind), 4)
    got = sorted(tuple(r) for r in moved.collect())
    assert got == sorted((d, i, x) for d, t in want.items() for i, x in enumerate(t, 1))
    again = layout.reordered(moved, spark.createDataFrame(back, kind), 4)
    assert sorted(tuple(r) for r in again.collect()) == sorted(rows)


def test_alignment_keeps_order_and_is_longest_on_single_items():
    rng = random.Random(2)
    for _ in range(150):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(8))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(8))]
        pairs = layout.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
        p = rng.sample(range(9), 9)
        longest = max(len(c) for n in range(10) for c in itertools.combinations(p, n) if list(c) == sorted(c))
        run = layout.increasing(p)
        assert len(run) == longest and [p[i] for i in run] == sorted(p[i] for i in run)
        ones = rng.sample(range(12), 9)
        assert len(layout.aligned(list(map(str, range(12))), list(map(str, ones)))) >= len(layout.increasing(ones)) - 1


def versions_of(spark, sf_dir):
    declared = source.source_declared(spark, sf_dir)[1].select("doc", "at", F.concat_ws(" ", "kind", "name").alias("item"))
    versions = [{}, {}]
    for v, df in zip(versions, (declared, changes.edited_declarations(declared))):
        for r in df.collect():
            v.setdefault(r.doc, []).append((r["at"], r.item))
    return versions


def aligned_rows(spark, sf_dir):
    got = {}
    for r in registry.QUERIES["aligned_declarations"](spark, sf_dir).collect():
        got.setdefault(r.doc, []).append(r)
    return got


def test_aligned_declarations(spark, sf_dir):
    versions, got = versions_of(spark, sf_dir), aligned_rows(spark, sf_dir)
    assert set(got) == set(versions[0]) | set(versions[1])
    for d, rows in got.items():
        a, b = ([x for _, x in sorted(v.get(d, []))] for v in versions)
        assert sorted(r.i for r in rows if r.i is not None) == list(range(len(a))) and sorted(r.j for r in rows if r.j is not None) == list(range(len(b)))
        assert sorted((r.i, r.j) for r in rows if r.change == "kept") == layout.aligned(a, b)
        assert all(a[r.i] == r.item for r in rows if r.i is not None) and all(b[r.j] == r.item for r in rows if r.j is not None)
        gone, new = (Counter(r.item for r in rows if r.change == c) for c in ("removed", "added"))
        assert not gone & new


def test_validated_edits(spark, sf_dir):
    got = aligned_rows(spark, sf_dir)
    verdicts = {r.doc: r for r in registry.QUERIES["validated_edits"](spark, sf_dir).collect()}
    for d, r in verdicts.items():
        n = Counter(x.change for x in got.get(d, []))
        assert (r.kept, r.moved, r.added, r.removed) == tuple(n[c] for c in ("kept", "moved", "added", "removed"))
        assert ("declarations_removed" in r.failures) == (n["removed"] > 0) and ("errors_appeared" in r.failures) == (d % 21 == 0) and ("declarations_moved" in r.failures) == (n["moved"] > 0) and r.accepted == (r.failures == "")


def test_closure_of_long_chains_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(includes, "cut", lambda df, cut=includes.cut: cuts.append(1) or cut(df))
    rows = includes.closure(spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(20)] + [("a20", "a0")], "file string, target string")).collect()
    assert {(r.file, r.included): r.depth for r in rows} == {(f"a{i}", f"a{(i + d) % 21}"): d for i in range(21) for d in range(1, 22)}
    assert len(cuts) <= 7
