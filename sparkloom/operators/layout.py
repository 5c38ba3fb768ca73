"""Moving blocks of lines within a text, and aligning what two versions declare."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import as_of, point_in_interval


def reordered(lines: DataFrame, blocks: DataFrame, bucket: int = 512) -> DataFrame:
    """``lines`` (doc, line_no, line) with blocks of them in a new order, numbered anew.

    ``blocks``: (doc, first, last, rank), ranges of lines that share none. The
    place of the nth block in the text gets the nth by rank (ties: by place); lines
    between blocks stay between the same places. Where a place begins is its old
    line and the running sum of what the places before have grown.
    """
    by_place = Window.partitionBy("doc").orderBy("first")
    rows = blocks.select("doc", "first", "last", "rank", (F.col("last") - F.col("first") + 1).alias("n"))
    rows = rows.withColumns({"slot": F.row_number().over(by_place), "to": F.row_number().over(Window.partitionBy("doc").orderBy("rank", "first"))})
    slots = rows.select("doc", F.col("slot").alias("to"), F.col("first").alias("at"), F.col("last").alias("end"), F.col("n").alias("old"))
    moved = rows.join(slots, ["doc", "to"])
    grown = F.sum(F.col("n") - F.col("old")).over(Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    moved = moved.withColumn("shift", grown).withColumn("start", F.col("at") + F.col("shift") - (F.col("n") - F.col("old")))
    inside = point_in_interval(lines, moved.select("doc", "first", "last", "start"), ["doc"], "line_no", "first", "last", bucket)
    inside = inside.select("doc", (F.col("start") + F.col("line_no") - F.col("first")).alias("line_no"), "line", F.col("line_no").alias("before"))
    rest = lines.join(inside.select("doc", F.col("before").alias("line_no")), ["doc", "line_no"], "left_anti")
    after = moved.select("doc", F.col("end").alias("line_no"), "shift", F.col("at").alias("tie"))
    rest = as_of(rest.select("doc", "line_no", "line", F.lit(0).cast("bigint").alias("tie")), after.withColumn("tie", F.col("tie").cast("bigint")), ["doc"], "line_no", "shift", "tie")
    rest = rest.select("doc", (F.col("line_no") + F.coalesce("shift", F.lit(0))).alias("line_no"), "line")
    return inside.select("doc", "line_no", "line").unionByName(rest)


def increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing run of different ``values``, by piles."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal items of both, in the order of both: items that are single on both sides first, then between them likewise."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, n, j, m = open_.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        ones, twos = Counter(a[i:n]), Counter(b[j:m])
        where = {b[k]: k for k in range(j, m)}
        pairs = [(k, where[a[k]]) for k in range(i, n) if ones[a[k]] == 1 and twos[a[k]] == 1]
        if not pairs:
            continue
        run = [pairs[k] for k in increasing([y for _, y in pairs])]
        out += run
        edges = [(i - 1, j - 1), *run, (n, m)]
        open_ += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:], strict=False) if x + 1 < z and y + 1 < w]
    return sorted(out)


def alignment(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, item, i, j, change) of two versions' items (doc, at, item): kept, moved (on both sides, but out of order), added or removed.

    ``i`` and ``j`` number a document's items from 0. The items of a document, not its text, are in one task.
    """
    lists = lambda df, name: df.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x.item).alias(name))
    both = lists(before, "a").join(lists(after, "b"), "doc", "full")
    kind = both.schema["doc"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for at, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                a, b = a or [], b or []
                rows = [(at, a[i], i, j, "kept") for i, j in aligned(a, b)]
                seen, new = {r[2] for r in rows}, {r[3] for r in rows}
                spare: dict[str, list[int]] = {}
                for j in range(len(b) - 1, -1, -1):
                    if j not in new:
                        spare.setdefault(b[j], []).append(j)
                for i in range(len(a)):
                    if i not in seen:
                        js = spare.get(a[i])
                        rows.append((at, a[i], i, js.pop(), "moved") if js else (at, a[i], i, None, "removed"))
                rows += [(at, x, None, j, "added") for x, js in spare.items() for j in js]
                for col, values in zip(out, zip(*rows, strict=True), strict=False):
                    col.extend(values)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=["doc", "item", "i", "j", "change"])

    return both.mapInArrow(run, f"doc {kind}, item string, i bigint, j bigint, change string")


def validated(changes: DataFrame, errors: DataFrame, tolerance: float, structural: bool = False) -> DataFrame:
    """(doc, kept, moved, added, removed, accepted, failures) of an edited text.

    ``errors``: (doc, before, after, n_before, n_after), error and node counts. A text fails if it had no error and
    has one now, or if its share of errors grew by more than ``tolerance``; without ``structural`` also if a declaration
    is gone or out of order.
    """
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    rows = errors.join(changes.groupBy("doc").agg(*map(n, ("kept", "moved", "added", "removed"))), "doc", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kept", "moved", "added", "removed")})
    share = lambda e, m: F.when(F.col(m) > 0, F.col(e) / F.col(m)).otherwise(0.0)
    tests = {"errors_appeared": (F.col("before") == 0) & (F.col("after") > 0), "error_share_grew": share("after", "n_after") > F.least(F.lit(1.0), share("before", "n_before") + tolerance)}
    if not structural:
        tests |= {"declarations_removed": F.col("removed") > 0, "declarations_moved": F.col("moved") > 0}
    failures = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return rows.select("doc", "kept", "moved", "added", "removed", (F.size(failures) == 0).alias("accepted"), F.array_join(failures, ",").alias("failures"))
