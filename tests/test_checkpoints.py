"""Partial rollback and validation against plain versions."""

import itertools
import random

import pytest
from sparkloom.operators import checkpoints

LINES = "doc long, line_no long, line string"
EDITS = "doc long, edit long, line_no long, after string"


def plain_errors(lines):
    depth = stray = 0
    for c in "".join(lines):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if depth < 0:
            depth, stray = 0, stray + 1
    return depth + stray


def put(lines, edits, back):
    out = list(lines)
    for e, n, after in edits:
        if e not in back:
            out[n - 1] = after
    return out


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(3)
    texts, edits = {}, {}
    for d in range(12):
        texts[d] = [rng.choice(["{", "}", "x", "{ }"]) for _ in range(8)]
        edits[d] = [(e, n, rng.choice(["y", "{ y }", "{", "}", texts[d][n - 1]])) for e, n in enumerate(rng.sample(range(1, 9), rng.randrange(1, 7)))]
    lines = spark.createDataFrame([(d, n, x) for d, t in texts.items() for n, x in enumerate(t, 1)], LINES)
    found, rounds = checkpoints.least_rollback(lines, spark.createDataFrame([(d, *e) for d, t in edits.items() for e in t], EDITS))
    return texts, edits, {r.doc: r for r in found.collect()}, rounds


def test_what_is_left_has_no_more_errors_and_needs_all_that_is_taken_back(searched):
    texts, edits, found, _ = searched
    assert set(found) == set(texts)
    for d, r in found.items():
        before = plain_errors(texts[d])
        assert (r.errors_before, r.errors_after) == (before, plain_errors(put(texts[d], edits[d], [])))
        assert plain_errors(put(texts[d], edits[d], r.back)) <= before
        assert all(plain_errors(put(texts[d], edits[d], set(r.back) - {e})) > before for e in r.back)
        assert r.verdict == ("accept" if not r.back else "rollback" if len(r.back) == len(edits[d]) else "partial")


def test_rollbacks_are_as_small_as_the_least_in_nearly_all_small_sets(searched):
    texts, edits, found, _ = searched
    least = {}
    for d in texts:
        ids = [e for e, *_ in edits[d]]
        least[d] = next(n for n in range(len(ids) + 1) if any(plain_errors(put(texts[d], edits[d], set(b))) <= plain_errors(texts[d]) for b in itertools.combinations(ids, n)))
    assert sum(len(found[d].back) == least[d] for d in texts) >= 0.9 * len(texts)


def test_single_bad_edits_are_found_in_logarithmic_rounds(spark):
    n, bad = 32, {7, 8, 20}
    lines = spark.createDataFrame([(d, i, "x") for d in (1, 2) for i in range(1, n + 1)], LINES)
    edits = spark.createDataFrame([(d, i, i + 1, "{" if d == 1 and i in bad else "{}") for d in (1, 2) for i in range(n)], EDITS)
    found, rounds = checkpoints.least_rollback(lines, edits)
    got = {r.doc: (r.verdict, set(r.back)) for r in found.collect()}
    assert got == {1: ("partial", bad), 2: ("accept", set())} and rounds <= 6


def test_no_edits_give_no_verdicts(spark):
    assert checkpoints.least_rollback(spark.createDataFrame([(1, 1, "{")], LINES), spark.createDataFrame([], EDITS))[0].count() == 0


def test_tries_meet_no_edits_by_joins(spark):
    lines = spark.createDataFrame([(1, i, "x") for i in range(1, 9)], LINES)
    edits = spark.createDataFrame([(1, i, i, "{" if i == 3 else "{}") for i in range(1, 9)], EDITS)
    joins = []

    def errors(text):
        joins.append(text._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return checkpoints.bracket_errors(text)

    found, _ = checkpoints.least_rollback(lines, edits, errors)
    assert [r.back for r in found.collect()] == [[3]] and max(joins) <= 1
