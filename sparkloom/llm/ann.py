"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a
cell. For a query, cells are visited by the sum of their halves' squared
distances (multi-sequence traversal with a heap) until enough entries are
gathered and the sum has left the neighbourhood of the nearest cell, how far is
learnt from a sample; the entries of those cells are reranked by the exact
distance.

Equal vectors are one entry with their smallest ids, which is all a result can
show of them, so a vector that a third of all rows share costs one entry.
Entries of a first-half centroid form a unit; a large unit is cut into blocks
and its queries into groups, so no task holds an unbounded group. An entry goes
only to groups of queries that visit its cell.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length differs from the most frequent one, or null
ids. Vectors of floats are kept as such and all others as doubles; distances
are computed in doubles, without overflow. Rows are told apart by their id: of
repeated ids each different vector is one candidate, and a query never finds
its own id. Ties go to the smaller id. Fewer candidates than asked for give
fewer rows; an empty table gives none. Columns other than the id and the vector
are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, groups_of, sample_test

#: Distinct vectors that the codebooks are fitted on, at most (about; chosen by a hash of the id).
SAMPLE = 20_000
#: Centroids of a half, at most.
CENTROIDS = 256
#: A query gathers at least so many entries, and all cells within a factor of its nearest one's sum. The factor is
#: learnt from PROBES vectors of the sample: with it they would find this share of their nearest in the sample.
GATHER = 150
RECALL = 0.97
PROBES = 200
#: Entries and queries of a unit, at most (about).
BLOCK = 16_384
QUERIES = 16_384


def usable(rows: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vectors take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size(v) == sizes[0].n) if sizes else rows.limit(0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of ``x`` (Lloyd's algorithm; empty ones keep their place)."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = squared(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T)


def traverse(d1: np.ndarray, d2: np.ndarray, size: np.ndarray, gather: int, near: float) -> list[tuple[int, int]]:
    """Occupied cells in the order of d1 + d2, as many as the query needs. ``size``: entries by cell."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    l1, l2 = o1.tolist(), o2.tolist()
    heap, out, got, first = [(s1[0] + s2[0], 0, 0)], [], 0, None
    done = [0] * len(l1)  # how many cells of each first-half centroid have been reached
    while heap:
        s, i, j = heapq.heappop(heap)
        if got >= gather and s > near * first:
            break
        n = size[l1[i], l2[j]]
        if n:
            first = s if first is None else first
            got += n
            out.append((l1[i], l2[j]))
        if j + 1 < len(l2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(l1) and not done[i + 1]:
            done[i + 1] = 1
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def nearness(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> float:
    """The factor within which probes among the rows of ``x`` find the share ``recall`` of their ``k`` nearest.

    In the whole table the nearest are closer than in a sample, so the factor is on the safe side.
    """
    if len(x) < 3:
        return math.inf
    half = books[0].shape[1]
    probes = np.random.default_rng(13).permutation(len(x))[:PROBES]
    d1, d2 = squared(x[probes, :half], books[0]), squared(x[probes, half:], books[1])
    at = [squared(x[:, :half], books[0]).argmin(1), squared(x[:, half:], books[1]).argmin(1)]
    k, ratios = min(k, len(x) - 1), []
    for i, p in enumerate(probes.tolist()):
        sums = d1[i, at[0]] + d2[i, at[1]]
        d = squared(x[p : p + 1], x)[0]
        d[p] = np.inf
        ratios.append(sums[np.argpartition(d, k - 1)[:k]] / max(float(sums.min()), 1e-300))
    return float(np.quantile(np.concatenate(ratios), recall))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 0))


def distances(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance of ``q`` to every row of ``e``; squares too large or too small for a double are avoided."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        d = np.abs(e - q)
        out = np.sqrt((d * d).sum(1))
        odd = ~((out > 1e-140) & (out < 1e140))
        if odd.any():
            most = d[odd].max(1)
            scaled = most * np.sqrt(((d[odd] / most[:, None]) ** 2).sum(1))
            out[odd] = np.where((most > 0) & np.isfinite(most), scaled, most)
    return out


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", gather: int = GATHER, recall: float = RECALL
) -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` holds: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind, numbers = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = usable(vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{numbers}>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("q")), "e")
    smallest = Window.partitionBy("e").orderBy("id")
    entries = rows.select("id", "e").distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = cut(entries)
    n = entries.count()
    queries = rows.where("q").select("id", "e")
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], out)
    asked = cut(queries.groupBy("e").agg(F.min("id").alias("key")))
    drawn = entries.where(sample_test(SAMPLE, n, "ids")).select("e").toArrow()
    x = np.array(drawn.column(0).to_pylist() or [entries.first().e], np.float64)
    scale = float(np.abs(x).max())
    half = x.shape[1] // 2
    c = max(1, min(CENTROIDS, round(n**0.5 / 4)))
    fitted = codebook(x[:, :half] / scale, c), codebook(x[:, half:] / scale, c)
    near = nearness(x / scale, fitted, k, recall)
    books = spark.sparkContext.broadcast((*fitted, scale))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2, scale = books.value
        for b in batches:
            v = np.array(b.column("e").to_pylist(), kind)
            if len(v):
                x = np.clip(v.astype(np.float64) / scale, -1e100, 1e100)
                yield pa.RecordBatch.from_pydict(
                    {
                        "c1": squared(x[:, :half], b1).argmin(1).astype(np.int32),
                        "c2": squared(x[:, half:], b2).argmin(1).astype(np.int32),
                        "v": pa.array([r.tobytes() for r in v], pa.binary()),
                        "ids": b.column("ids"),
                    }
                )

    index = cut(entries.mapInArrow(assign, "c1 int, c2 int, v binary, ids array<bigint>"))
    size = np.zeros((len(books.value[0]), len(books.value[1])), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # no more rows than there are cells
        size[r.c1, r.c2] = r["count"]
    plan = spark.sparkContext.broadcast(size)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (b1, b2, scale), size = books.value, plan.value
        for b in batches:
            v = np.array(b.column("e").to_pylist(), kind)
            if not len(v):
                continue
            x = np.clip(v.astype(np.float64) / scale, -1e100, 1e100)
            d1, d2 = squared(x[:, :half], b1), squared(x[:, half:], b2)
            cols: tuple[list, ...] = ([], [], [], [])
            for i, key in enumerate(b.column("key").to_pylist()):
                by: dict[int, list[int]] = {}
                for one, two in traverse(d1[i], d2[i], size, gather, near):
                    by.setdefault(one, []).append(two)
                for one, twos in by.items():
                    for col, value in zip(cols, (one, key, v[i].tobytes(), np.array(sorted(twos), "<i4").tobytes()), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["c1", "key", "v", "cells"])

    visits = cut(asked.mapInArrow(visit, "c1 int, key bigint, v binary, cells binary"))

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for one, raw in zip(b.column("c1").to_pylist(), b.column("cells").to_pylist(), strict=True):
                total.update((one, two) for two in np.frombuffer(raw, "<i4").tolist())
        if total:
            yield pa.RecordBatch.from_pydict({"c1": pa.array([x for x, _ in total], pa.int32()), "c2": pa.array([x for _, x in total], pa.int32())})

    # no more rows than there are cells, so they can go everywhere
    visited = visits.select("c1", "cells").mapInArrow(seen, "c1 int, c2 int").distinct()
    share = visits.groupBy("c1").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    blocks = index.groupBy("c1").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    units = cut(share.join(blocks, "c1"))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = index.join(F.broadcast(cut(visited)), ["c1", "c2"]).join(F.broadcast(units), "c1").withColumn("b", part("v", "blocks")).withColumn("g", each("groups"))
    going = visits.join(F.broadcast(units), "c1").withColumn("g", part("key", "groups")).withColumn("b", each("blocks"))
    unit = F.format_string("%d/%d/%d", "c1", "b", "g").alias("unit")
    both = held.select(unit, F.lit(None).cast("bigint").alias("key"), "v", F.lit(None).cast("binary").alias("cells"), "c2", "ids").unionByName(
        going.select(unit, "key", "v", "cells", F.lit(None).cast("int").alias("c2"), F.lit(None).cast("array<bigint>").alias("ids"))
    )
    both = both.repartition("unit").sortWithinPartitions("unit", F.col("key").asc_nulls_first(), "c2")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, "unit"):
            asking = t.filter(pa.compute.is_valid(t.column("key")))
            held = t.filter(pa.compute.is_null(t.column("key")))
            if not (asking.num_rows and held.num_rows):
                continue
            e, c2 = _matrix(held.column("v"), kind), np.array(held.column("c2").to_pylist())
            starts = np.searchsorted(c2, np.arange(c2[-1] + 2))
            ids = held.column("ids").to_pylist()
            with np.errstate(over="ignore", invalid="ignore"):
                norm = (e * e).sum(1)
            cols: tuple[list, list, list] = ([], [], [])
            for key, raw, cells in zip(asking.column("key").to_pylist(), asking.column("v").to_pylist(), asking.column("cells").to_pylist(), strict=True):
                q = np.frombuffer(raw, kind).astype(np.float64)
                cell = np.frombuffer(cells, "<i4")
                cell = cell[cell <= c2[-1]]
                at = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in cell.tolist()] or [np.zeros(0, np.int64)])
                if not len(at):
                    continue
                if len(at) > k + 1:  # those within rounding of the last place stay
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = norm[at] - 2 * (e[at] @ q)
                        most = float(np.abs(rough).max())
                    if 1e-250 < most < 1e250:
                        at = at[rough <= np.partition(rough, k)[k] + 1e-9 * max(most, float(norm[at].max()), float(q @ q))]
                exact = distances(e[at], q)
                best = heapq.nsmallest(k + 1, ((d, i) for d, x in zip(exact.tolist(), at.tolist(), strict=True) for i in ids[x]))
                cols[0].extend([key] * len(best))
                cols[1].extend(d for d, _ in best)
                cols[2].extend(i for _, i in best)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["key", "score", "vec_id"])

    found = both.mapInArrow(rerank, "key bigint, score double, vec_id bigint").distinct()
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    who = queries.join(asked, "e").select("key", F.col("id").alias("query_id")).distinct()
    pairs = who.join(top, "key").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
