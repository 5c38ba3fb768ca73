"""Hard negatives, mixing and vector codes against plain versions, and on awkward tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import hard_negatives, mixing, product_codes, queries

VECTORS = "vec_id long, embedding array<double>, label string"


def vectors(rng, n, width=8, spread=1.0, labels=4):
    out = []
    for i in range(n):
        f = rng.choice([1, 1, 1, spread])
        out.append((i, [rng.uniform(-1, 1) * f for _ in range(width)], str(rng.randrange(labels))))
    return out


def usable(rows):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    most = Counter(len(r[1]) for r in rows)
    width = max(most, key=lambda k: (most[k], k), default=0)
    return [r for r in rows if len(r[1]) == width]


def plain_negatives(rows, every, positives=5, negatives=3, scale=256):
    rows = {(i, tuple(math.floor(scale * x) for x in v), g) for i, v, g in usable([r for r in rows if r[0] is not None and r[2] is not None])}
    out = []
    for i, v, g in rows:
        if i % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j, h) for j, w, h in rows if j != i))
        for s, p, _ in [x for x in scores if x[2] == g][:positives]:
            found = [(-t, j) for t, j, h in scores if h != g and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, p, r, j, -s, t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def mined(rows, every=5, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(rows, F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_hard_negatives_equal_brute_force_over_levels_pieces_and_blocks(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 40), ("ANCHORS", 16), ("LEVELS", 6), ("WAVES", (1, 3, 6))):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(random.Random(3), 300, spread=spread)
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert got and got == plain_negatives(rows, 5)


def test_candidates_go_to_all_blocks_beyond_the_bound_of_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "VISITED", 0)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rows = vectors(random.Random(4), 120)
    assert mined(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows, 5)


def test_hard_negatives_meet_awkward_rows(spark):
    rng = random.Random(5)
    rows = vectors(rng, 60)
    rows += [(100 + i, rows[10][1], "1") for i in range(40)]  # one vector on many ids
    rows += rows[:20] + [(0, rows[3][1], "2")]  # repeated rows, and an id twice
    rows += [(200, None, "1"), (205, [], "1"), (210, [0.0] * 8, "2"), (215, [1.0] * 7, "1"), (220, [1.0, None] * 4, "1"), (225, [math.nan] * 8, "1"), (230, [math.inf] * 8, "1"), (235, [1.0] * 8, None), (None, [1.0] * 8, "1")]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("key", "score", "norm", "level", "win", "id", "v", "w", "rank", "anchor")})
    got = mined(df)
    assert got == plain_negatives(rows, 5)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 5")) == []


def test_scores_far_beyond_the_limit_stay_whole(spark):
    rows = [(i, [10.0**i] * 4, str(i % 2)) for i in range(12)]
    assert all(isinstance(r[4], int) and r[4] < 1 << 54 for r in mined(spark.createDataFrame(rows, VECTORS), every=1))


def test_buckets_below_the_bound_are_left_out(monkeypatch):
    rng = np.random.default_rng(1)
    n, width = 64 * 20, 8
    v = rng.integers(-50, 50, (n, width)) * np.repeat(np.arange(20, 0, -1), 64)[:, None] ** 2
    v = np.vstack([v, rng.integers(-50, 50, (1, width))])
    norm = np.sqrt((v * v).sum(1).astype(float))
    whole = [{"w": 0, "lo": -np.inf, "hi": np.inf, "kth": None}]
    t = pa.table({"kind": [0] * n + [1], "id": list(range(n + 1)), "label": ["a"] * (n + 1), "v": pa.array(v.tolist(), pa.list_(pa.int32())), "norm": norm, "key": [None] * n + [7], "win": pa.array([None] * n + [whole], pa.list_(pa.struct([("w", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("kth", pa.float64())])))})
    monkeypatch.setattr(hard_negatives, "BUCKET", 64)
    seen, plain = [], hard_negatives.best
    monkeypatch.setattr(hard_negatives, "best", lambda *a: seen.append(1) or plain(*a))
    got = hard_negatives.search_unit(t, width, 5, True).to_pydict()
    s = v[:n] @ v[n]
    assert sorted(got["id"]) == sorted(np.lexsort((np.arange(n), -s))[:5].tolist()) and len(seen) < 12


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """Sizes and targets, in fractions."""
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        by[s] += n
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(size))
    while open_:
        share = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if share * w[s] > most * by[s]]
        if not over:
            target |= {s: share * w[s] for s in open_}
            break
        for s in over:
            target[s] = Fraction(most * by[s])
            rest -= target[s]
            open_.discard(s)
    return size, by, target


def texts(rng, n, sources):
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(sources)) for i in range(n)]


MIXED = "doc_id long, text string, source string"


@pytest.mark.parametrize("sources", [["a"], ["a"] * 40 + ["b", "é", "z", None, "\U0001f600", "￿"], [f"s{i}" for i in range(30)]])
def test_mixing_equals_plain_targets_and_comes_near_them(spark, sources):
    rows = texts(random.Random(7), 2000, sources)
    size, by, target = plain_mix(rows)
    got = mixing.plan(spark.createDataFrame(rows, MIXED)).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for (i, _, s), n in zip(rows, size):
        r = found[i]
        assert (r["size"], r.source_size) == (n, by[s]) and r.target == pytest.approx(float(target[s])) and r.taken == n * r.copies
        rate = target[s] / by[s] if by[s] else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate) <= 3
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s in by:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(rows[::-1], MIXED).repartition(7)).collect()}
    assert again == {i: r.copies for i, r in found.items()}


def test_mixing_meets_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "no id here", "a"), (None, "no id here", "a"), (4, "x " * 50_000, "b"), (5, "one two", ""), (5, "one two", ""), (6, " 　", "c")]
    df = spark.createDataFrame(rows, MIXED).withColumns({c: F.lit("mine") for c in ("size", "target", "at", "first", "rate", "id", "taken", "weight", "copies", "_id")})
    got = mixing.plan(df).collect()
    size, by, target = plain_mix(rows)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size)
    assert sum({r.source_size: r.target for r in got}.values()) <= sum(size) + 1e-6
    none = mixing.plan(df.where("doc_id < 4"))
    assert {(r["size"], r.target, r.taken) for r in none.collect()} == {(0, 0.0, 0)}
    assert mixing.plan(df.limit(0)).count() == 0


def test_mixing_numbers_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 10)
    df = spark.range(500).select(F.pmod(F.col("id") * 37, F.lit(11)).alias("a"), "id")
    got = [(r.a, r.id) for r in mixing.numbered(df, 500, F.col("a"), F.col("id")).orderBy("at").collect()]
    assert got == sorted(got) and [r["at"] for r in mixing.numbered(df, 500, F.col("a"), F.col("id")).orderBy("at").collect()] == list(range(500))


def test_mix_is_emitted_and_runs_no_python(spark):
    rows = texts(random.Random(8), 300, ["a"] * 20 + ["b"])
    df = spark.createDataFrame(rows, MIXED)
    planned = mixing.plan(df)
    want = {r.doc_id: r.copies for r in planned.collect() if r.copies}
    assert Counter(r.doc_id for r in mixing.emit(df, planned).collect()) == want
    plan = planned._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("BroadcastExchange")[0]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in usable(rows)]
    where = product_codes.cuts(len(rows[0][1]), parts)
    least = {}
    for i, v, _ in rows:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    firsts = [least[i] for i in sorted(least)[:entries]]
    books = [[v[s] for v in firsts] for s in where]

    def at(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, s in enumerate(where):
            got = defaultdict(list)
            for _, v, _ in rows:
                got[at(v[s], books[p])[0]].append(v[s])
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else b for e, b in enumerate(books[p])]
    out = []
    for i, v, g in rows:
        found = [at(v[s], b) for s, b in zip(where, books)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), g))
    total = Counter()
    for *_, e, g in out:
        total[g] += e
    text = ",".join(str(c) for b in books for e in b for c in e)
    return Counter((i, c, e, total[g]) for i, c, e, g in out), hashlib.sha256(text.encode()).hexdigest()


def coded(df, **kw):
    found, books = product_codes.compress(df, **kw)
    return Counter((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), product_codes.books_digest(books)


@pytest.mark.parametrize("width", [8, 19, 32])
def test_codes_equal_a_plain_version(spark, width):
    rows = vectors(random.Random(width), 200, width)
    assert coded(spark.createDataFrame(rows, VECTORS).repartition(5)) == plain_codes(rows)


def test_codes_meet_awkward_rows(spark):
    rows = vectors(random.Random(2), 40)
    rows += rows[:5] * 3 + [(0, [9.0] * 8, "1"), (1, [-9.0] * 8, None), (2, [0.0] * 8, None)]  # repeated rows and ids, null labels
    rows += [(50 + i, [0.5] * 8, "1") for i in range(60)]  # a hot vector and ties
    rows += [(-3, None, "1"), (-4, [], "1"), (-5, [1.0] * 9, "1"), (-6, [None] * 8, "1"), (-7, [math.nan] * 8, "1"), (-8, [-math.inf] * 8, "1"), (None, [1.0] * 8, "1")]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("code", "error", "id", "v", "part", "entry", "label_error", "n")})
    assert coded(df) == plain_codes(rows)
    assert coded(df.limit(0))[0] == Counter()
    assert coded(df.where("vec_id = 50")) == plain_codes([r for r in rows if r[0] == 50])
    nameless = [(None, v, g) for _, v, g in rows[:3]]
    assert sum(coded(spark.createDataFrame(nameless, VECTORS))[0].values()) == 3


def test_codes_of_huge_components_are_whole(spark):
    rows = [(i, [10.0 ** (3 * i) * (-1) ** i] * 16, "a") for i in range(40)]
    got, _ = coded(spark.createDataFrame(rows, VECTORS))
    assert sum(got.values()) == 40 and all(e >= 0 and t >= e for _, _, e, t in got)


def test_a_task_sends_a_row_for_each_entry_at_most(spark):
    df = spark.createDataFrame(vectors(random.Random(1), 400), VECTORS)
    assert queries.QUERIES["op13_vector_codes"] and coded(df.repartition(1)) == coded(df.repartition(9))
