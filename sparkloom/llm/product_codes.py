"""Product quantisation in integers: vectors become short codes of codebook entries.

Each component x becomes floor(scale * x). A vector is cut into ``parts``
consecutive parts of equal length, and each part position has a codebook of at
most ``entries`` integer vectors, which starts as the parts of the smallest ids.
In every round each task takes the codebooks (broadcast: no more than ``entries``
vectors in all), computes all squared distances of its Arrow batches by norm
expansion with int64 matrix products, and adds the parts up by their nearest
entry; it sends one row for each part and entry, whatever its number of
vectors, and those are added in a grouped shuffle of two levels. An entry
becomes the componentwise floor of sum over count; an unused entry stays.

All is exact: distances and sums are integers, the sums between tasks decimals.
For that a component is held within the largest number of which squared
distances fit into 64 bits (134,217,728 at 64 components, that is 32,768 before
the scale of 4096); vectors beyond are taken as if at that limit. Sums of errors
beyond 64 bits stand as the largest number.

Rows take no part if their vector is null, empty, holds a null or non-finite
component or has another length than most (of equally frequent lengths, the
longest). A length that ``parts`` doesn't divide gives the first parts one
component more; parts without a component have code 0. Rows with a null id are
coded, but don't start the codebooks; of repeated ids each row is coded, and
the least vector of an id starts the codebooks. Equal distances go to the
smaller index. Fewer ids than entries make smaller codebooks; an empty table
gives no row. Columns other than id, label and vector are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Tasks whose sums are added first, by number of the task.
SPREAD = 64


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(v) > 0)


def most_frequent_length(rows: DataFrame, v: Column) -> int:
    found = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return found[0].n if found else 0


def integers(v: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of every component, within +-limit."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), F.lit(float(scale)) * x.cast("double")))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the smaller of equal ones), and the squared distance."""
    d = (x * x).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * (x @ book.T)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def cuts(width: int, parts: int) -> list[slice]:
    short, more = divmod(width, parts)
    ends = np.cumsum([short + (i < more) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def first_books(rows: DataFrame, entries: int, where: list[slice]) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids, in their order. A task sends no more than ``entries`` rows."""
    id_kind = rows.schema["id"].dataType.simpleString()

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        most = None
        for b in batches:
            for at, i in enumerate(b.column("id").to_pylist()):
                if i is not None and (most is None or i <= most):
                    v = b.column("v")[at].as_py()
                    best[i] = min(v, best.get(i, v))
                    if len(best) > entries:
                        del best[max(best)]
                    most = max(best) if len(best) == entries else None
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), b.column("id").type), pa.array(list(best.values()), pa.list_(pa.int32()))], names=["id", "v"])

    each = rows.select("id", "v").mapInArrow(tidy(smallest), f"id {id_kind}, v array<int>")
    firsts = each.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    if not firsts:  # ids are all null
        firsts = rows.agg(F.min("v").alias("v")).collect()
    x = np.array([r.v for r in firsts], np.int64)
    return [x[:, s] for s in where]


def trained(rows: DataFrame, books: list[np.ndarray], where: list[slice]) -> list[np.ndarray]:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width, wide = where[-1].stop, max(s.stop - s.start for s in where)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), width)
            for i, s in enumerate(where):
                at, _ = nearest(x[:, s], books[i])
                np.add.at(total[i], at, x[:, s])
                count[i] += np.bincount(at, minlength=len(count[i]))
        found = [(i, e, int(count[i][e]), total[i][e].tolist()) for i in range(len(books)) for e in np.nonzero(count[i])[0].tolist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["part", "entry", "n", "total"])

    each = rows.select("v").mapInArrow(tidy(sums), "part int, entry int, n bigint, total array<bigint>")
    flat = each.select("part", "entry", (F.spark_partition_id() % SPREAD).alias("task"), "n", *[F.get("total", F.lit(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(wide)])
    add = [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)]]
    got = flat.groupBy("part", "entry", "task").agg(*add).groupBy("part", "entry").agg(*add).collect()  # a row for each entry
    out = [b.copy() for b in books]
    for r in got:
        for j in range(out[r.part].shape[1]):
            out[r.part][r.entry, j] = int(r[f"s{j}"]) // r.n
    shared.unpersist()
    return out


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(c) for b in books for row in b.tolist() for c in row)


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """Per row: ``id_col``, ``label_col``, code, error, label_error; and the final codebooks."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).where(finite(F.col("v")))
    width = most_frequent_length(kept, F.col("v"))
    out = kept.select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
    if not width:
        return out.limit(0), []
    limit = min((1 << 31) - 1, math.isqrt((1 << 62) // (4 * width)))
    rows = cut(kept.where(F.size("v") == width).withColumn("v", integers(F.col("v"), scale, limit)))
    where = cuts(width, parts)
    books = first_books(rows, entries, where)
    for _ in range(rounds):
        books = trained(rows, books, where)
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), width)
            code, error = np.full(b.num_rows, "", dtype=object), np.zeros(b.num_rows, np.int64)
            for i, s in enumerate(where):
                at, d = nearest(x[:, s], shared.value[i])
                code += digits[at].astype(object)
                error += d
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    found = cut(rows.mapInArrow(tidy(coded), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.least(most, F.sum(F.col("error").cast("decimal(38,0)"))).cast("bigint").alias("label_error"))
    found = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return found.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
