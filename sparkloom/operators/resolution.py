"""Competing edits: reverts, line claims, conflict graphs, components and weighted independent sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

# Weights of the style gain, utility and hard clauses (all but macro regions, bit 5).
STYLE = (0.7058823529411765, 0.47058823529411764, 0.23529411764705882)
STABLE = {0: 0.11764705882352941, 1: 0.058823529411764705}
HARD_MASK = 0b11011111
SEMANTIC = ("semantic_rename",)


def history(edits: DataFrame) -> DataFrame:
    """Edits with the one before on the same line: prev (policy, before, after) in the order of seq."""
    w = Window.partitionBy("line").orderBy("seq")
    return edits.where("line > 0").withColumn("prev", F.lag(F.struct("policy", "before", "after")).over(w))


def reverts(edits: DataFrame) -> DataFrame:
    """Each (line, earlier policy, policy) once in which the later edit undoes the earlier one."""
    rows = history(edits).where((F.col("prev.policy") != F.col("policy")) & (F.col("after") == F.col("prev.before")) & (F.col("before") == F.col("prev.after")))
    return rows.select("line", F.col("prev.policy").alias("reverted"), "policy").distinct()


def multi_touch(edits: DataFrame, threshold: int = 2) -> DataFrame:
    """Each set of at least ``threshold`` policies that a line has been touched by so far, once."""
    first = edits.where("line > 0").groupBy("line", "policy").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("line").orderBy("seq")
    sets = first.withColumn("touched", F.array_sort(F.collect_set("policy").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    # a set is reported when an edit comes on a line that has some already; a single policy's set never reaches two
    return sets.where(F.size("touched") >= max(2, threshold)).select("line", F.array_join("touched", "|").alias("policies"))


def line_claims(edits: DataFrame) -> DataFrame:
    """status of each edit: claimed, suppressed (a later one of higher priority took the line) or dropped; empty edits are void.

    A claim wins if its priority is above all earlier ones on the line.
    """
    w = Window.partitionBy("line").orderBy("seq")
    real = (F.col("line") > 0) & (F.col("before") != F.col("after"))
    rows = edits.withColumn("_p", F.when(real, F.col("priority")))
    before = F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.max("_p").over(Window.partitionBy("line"))
    won = F.col("_p") > F.coalesce(before, F.lit(-1))
    status = F.when(~real, "void").when(~won, "dropped").when(F.col("_p") < best, "suppressed").otherwise("claimed")
    return rows.withColumn("status", status).drop("_p")


def style_gain(before: Column, after: Column, trust: float = 0.85) -> Column:
    b, a = F.trim(before), F.trim(after)
    small = 1 - F.least(F.abs(F.octet_length(b) - F.octet_length(a)) / 32.0, F.lit(1.0))
    base, blank, delta = (trust * x for x in STYLE)
    return F.when(before == after, 0.0).otherwise(base + (b == a).cast("double") * blank + small * delta)


def utility(gain: Column, confidence: Column, risk: Column, n_ranges: Column, n_symbols: Column, scope: float = 0.0, e0: float = 0.85, e2: float = 0.5, e4: float = 0.85, v3: float = 0.10) -> Column:
    """Gain and confidence with bonuses for low risk and narrow scope, less penalties for risk and footprint."""
    stable = F.when(risk == 0, e0 * STABLE[0]).when(risk == 1, e0 * STABLE[1]).otherwise(0.0)
    narrow = scope * F.when(risk == 0, e2 * 0.16).otherwise(e2 * 0.08)
    danger = F.when(risk == 2, 1 - e4).when(risk == 1, (1 - e4) / 3).otherwise(0.0)
    return gain + confidence + stable + narrow - danger - F.least(n_ranges * v3 * 0.2 + n_symbols * v3 * 0.1, F.lit(0.30))


def best_by_line(cands: DataFrame) -> DataFrame:
    """One candidate a line: by utility and confidence rounded to their tolerance, then lower risk, policy and id."""
    w = Window.partitionBy("line").orderBy(F.desc(F.round("utility", 6)), F.desc(F.round("confidence", 3)), "risk", "policy", "id")
    return cands.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def admissible(cands: DataFrame) -> DataFrame:
    """Without candidates that touch a hard clause (bits of ``mask``)."""
    return cands.where(F.col("mask").bitwiseAND(HARD_MASK) == 0)


def zone(is_macro: Column, is_comment: Column) -> Column:
    return F.when(is_macro, "preprocessor").when(is_comment, "comments").otherwise("code")


def guardian(cands: DataFrame, zones: list[str]) -> DataFrame:
    """verdict: zone_blocked, hard_blocked or allowed."""
    return cands.withColumn("verdict", F.when(~F.col("zone").isin(*zones), "zone_blocked").when(F.col("mask").bitwiseAND(HARD_MASK) != 0, "hard_blocked").otherwise("allowed"))


def conflict_edges(cands: DataFrame, bucket: int = 16) -> DataFrame:
    """Pairs (a < b) of candidates that exclude each other.

    Reasons: one policy or two on the same line, overlapping ranges (closed),
    or a common symbol within the larger radius. Each reason is an equi-join
    of its own (line, bucket of lines, symbol and bucket of lines), so nothing
    is crossed: a symbol that is everywhere meets only what is near.
    """
    # read six times
    c = cut(cands.select("id", "policy", "line", "s", "e", "symbols", "radius"))
    left, right = ({x: f"{p}_{x}" for x in c.columns} for p in "ab")
    a, b = c.withColumnsRenamed(left), c.withColumnsRenamed(right)
    pair = (F.col("a_id") < F.col("b_id"))
    other = F.col("a_policy") != F.col("b_policy")
    same = a.join(b, F.col("a_line") == F.col("b_line")).where(pair)
    cells = lambda d, p: d.withColumn("_c", F.explode(F.sequence(F.floor(F.col(f"{p}_s") / bucket), F.floor(F.col(f"{p}_e") / bucket))))
    overlap = cells(a, "a").join(cells(b, "b"), "_c").where(pair & other & (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")))
    by_symbol = lambda d, p: d.withColumn("_s", F.explode(F.array_distinct(f"{p}_symbols")))
    reach = F.greatest("a_radius", F.lit(1))
    near = F.sequence(F.floor((F.col("a_line") - reach) / bucket), F.floor((F.col("a_line") + reach) / bucket))
    # one of a pair reaches the other; which of them has the smaller id doesn't matter
    met = by_symbol(a.withColumn("_c", F.explode(near)), "a").join(by_symbol(b.withColumn("_c", F.floor(F.col("b_line") / bucket)), "b"), ["_s", "_c"])
    met = met.where(other & (F.col("a_id") != F.col("b_id")) & (F.abs(F.col("a_line") - F.col("b_line")) <= reach))
    symbol = met.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
    out = [F.col("a_id").alias("a"), F.col("b_id").alias("b")]
    return same.select(*out).union(overlap.select(*out)).union(symbol.select(*out)).distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (smallest id) of every vertex, by minimum labels that jump along themselves until nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = vertices.select("id").distinct().withColumn("component", F.col("id"))
    changed = True
    while changed:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"), "component")
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("j"))
        new = cut(step.join(jump, "c", "left").select("id", F.least("c", F.coalesce("j", "c")).alias("component"), F.col("component").alias("_old")))
        changed = not new.where("component <> _old").isEmpty()
        labels = new.select("id", "component")
    return labels


def component_threshold(richness: float) -> int:
    """How large a component is solved exactly, by the filter's estimate of richness."""
    return int(min(max(32.0 * richness, 8.0), 64.0))


#: Candidates of a component that one task takes; larger ones are solved by joins.
IN_TASK = 10_000
#: Rounds whose results are one union before they are written together.
FLAT = 16


def independent_set(cands: DataFrame, edges: DataFrame, richness: float = 0.5) -> DataFrame:
    """The candidates of greatest total weight without two that exclude each other, in every component.

    Small components are solved exactly (ties go to the smaller list of
    (line, policy)); larger ones greedily, the heaviest first, then by
    confidence, risk, line, policy and id. Negative weights count as 0 in exact
    solutions. A component of up to IN_TASK candidates is one group, with
    memory for its conflicts; of larger ones no task holds more than a part.
    """
    exact_up_to = component_threshold(richness)
    edges = cut(edges.select("a", "b"))
    of = components(cands.select("id"), edges)
    size = of.groupBy("component").agg(F.count("*").alias("_n"))
    rows = cut(cands.select("id", "line", "policy", "weight", "confidence", "risk").join(of.join(size, "component"), "id"))
    single = rows.where(F.col("_n") == 1).where("weight > 1e-6 AND NOT isnan(weight)")
    small = rows.where((F.col("_n") > 1) & (F.col("_n") <= min(exact_up_to, IN_TASK)))
    middle = rows.where((F.col("_n") > min(exact_up_to, IN_TASK)) & (F.col("_n") <= IN_TASK)).drop("_n")
    large = rows.where(F.col("_n") > IN_TASK).drop("_n")
    both = edges.union(edges.select("b", "a")).distinct()
    near = both.groupBy("a").agg(F.collect_list("b").alias("near"))
    out = ["component", "id", F.col("line").cast("bigint").alias("line"), "policy"]
    solved = single.select(*out).unionByName(_exact_rows(small, near))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "confidence", "risk", "line", "policy", "id"], ascending=[False, False, True, True, True, True]).reset_index(drop=True)
        place = {i: k for k, i in enumerate(pdf["id"])}
        bar = [[] if x is None else [place[j] for j in x] for x in pdf["near"]]
        return pdf.loc[greedy(bar), ["component", "id", "line", "policy"]]

    if not middle.isEmpty():
        solved = solved.unionByName(middle.join(near, middle.id == near.a, "left").drop("a").groupBy("component").applyInPandas(solve, CHOSEN))
    if not large.isEmpty():
        solved = solved.unionByName(large.join(greedy_by_joins(large, edges), "id", "left_semi").select(*out))
    return solved


#: What a solved component gives.
CHOSEN = "component bigint, id bigint, line bigint, policy string"


def _place() -> Column:
    """Sorts candidates by what ``greedy`` takes first."""
    last = F.lit(float("inf"))
    down = lambda c: F.coalesce(-F.col(c), last).alias(c)
    return F.struct(down("weight"), down("confidence"), F.coalesce("risk", last).alias("risk"), "line", "policy", "id")


def _exact_rows(cands: DataFrame, near: DataFrame) -> DataFrame:
    """The exact solutions of components, each one row, so that a batch holds many of them."""
    rows = cands.join(near, cands.id == near.a, "left").repartition(4 * cands.sparkSession.sparkContext.defaultParallelism, "component")
    one = F.struct(_place().alias("place"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("near"))
    whole = rows.groupBy("component").agg(F.array_sort(F.collect_list(one)).alias("x"))
    each = lambda f: F.transform("x", f)
    listed = whole.select("component", each(lambda x: x["weight"]).alias("weight"), each(lambda x: x["place"]["line"].cast("bigint")).alias("line"), each(lambda x: x["place"]["policy"]).alias("policy"), each(lambda x: x["place"]["id"].cast("bigint")).alias("id"), each(lambda x: x["near"]).alias("near"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {c: [] for c in ("component", "id", "line", "policy")}
            for r in batch.to_pylist():
                place = {i: k for k, i in enumerate(r["id"])}
                for k in exact(r, [sum(1 << j for j in {place[i] for i in x or ()}) for x in r["near"]]):
                    found["component"].append(r["component"])
                    for c in ("id", "line", "policy"):
                        found[c].append(r[c][k])
            yield pa.RecordBatch.from_pydict(found, pa.schema([("component", pa.int64()), ("id", pa.int64()), ("line", pa.int64()), ("policy", pa.string())]))

    return listed.mapInArrow(solve, CHOSEN)


def greedy(bar: list[list[int]]) -> list[int]:
    blocked, keep = set(), []
    for i, b in enumerate(bar):
        if i not in blocked:
            keep.append(i)
            blocked.update(b)
    return keep


def greedy_by_joins(cands: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids that ``greedy`` takes, for components of any size.

    Every conflict points from the candidate that comes first to the other. In a
    round, candidates that nothing points at are taken and what they point at
    goes. The rounds are half the longest chain of candidates that each come
    after the one before, not their number.
    """
    place = cands.select("id", _place().alias("rank"))
    ends = edges.select("a", "b").where("a <> b").join(place.toDF("a", "ra"), "a").join(place.toDF("b", "rb"), "b")
    first = F.col("ra") < F.col("rb")
    arcs = cut(ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    rest, taken = cut(cands.select("id").distinct()), cands.select("id").limit(0)
    n = 0
    while not rest.isEmpty():
        now = cut(rest.join(arcs, "id", "left_anti"))
        taken, n = taken.union(now), n + 1
        if n % FLAT == 0:
            taken = cut(taken)
        gone = cut(arcs.join(now.toDF("first"), "first", "left_semi").select("id").distinct())
        rest = cut(rest.join(now.union(gone), "id", "left_anti"))
        arcs = cut(arcs.join(gone, "id", "left_anti").join(gone.toDF("first"), "first", "left_anti"))
    return taken


def exact(pdf: pd.DataFrame | dict[str, list], bar: list[int]) -> list[int]:
    """Best subset by branch and bound over rows in the order of weight."""
    w = [max(0.0, x) for x in pdf["weight"]]
    keys = list(zip(pdf["line"], pdf["policy"], strict=True))
    rest = [sum(w[i:]) for i in range(len(w) + 1)]
    best: list = [-1.0, []]

    def go(i: int, total: float, blocked: int, chosen: list[int]) -> None:
        if i == len(w):
            mine, theirs = sorted(keys[k] for k in chosen), sorted(keys[k] for k in best[1])
            if total > best[0] + 1e-6 or abs(total - best[0]) <= 1e-6 and mine < theirs:
                best[:] = [total, chosen]
            return
        if total + rest[i] + 1e-6 < best[0]:
            return
        if not blocked >> i & 1:
            go(i + 1, total + w[i], blocked | bar[i], [*chosen, i])
        go(i + 1, total, blocked, chosen)

    go(0, 0.0, 0, [])
    return best[1]


def majority(votes: DataFrame, ballot: list[str], choice: str, voter: str) -> DataFrame:
    """Choices that more than half of a ballot's voters made."""
    n = votes.groupBy(*ballot).agg(F.count_distinct(voter).alias("_n"))
    counted = votes.groupBy(*ballot, choice).agg(F.count_distinct(voter).alias("votes"))
    return counted.join(n, ballot).where(F.col("votes") >= F.floor(F.col("_n") / 2) + 1).drop("_n")


def agreement(proposals: DataFrame, key: str, file: str, success: float) -> DataFrame:
    """Proposals whose share of all proposing files, weighted by ``success``, reaches the bar."""
    import math

    bar = 1 - 1 / (1 + math.exp(-5 * (success - 0.5)))
    total = proposals.agg(F.greatest(F.count_distinct(file), F.lit(1)).alias("_t"))
    counted = proposals.groupBy(key).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("_t") * success >= bar).drop("_t")  # ``total`` is one row


def consistent_renames(plans: DataFrame) -> DataFrame:
    """One row a declaration if no declaration has two different (old, new); else none at all."""
    pairs = plans.groupBy("decl").agg(F.count_distinct(F.struct("old", "new")).alias("n"), F.min("old").alias("old"), F.min("new").alias("new"))
    worst = pairs.agg(F.max("n").alias("_w"))
    return pairs.crossJoin(F.broadcast(worst)).where("_w = 1").drop("_w", "n")  # ``worst`` is one row
