"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Equal sets are one class with a count,
so copies cost nothing. Classes that agree in a band of MinHash values are
candidates. A candidate pair's values are compared some at a time; as soon as
the posterior probability (uniform prior) that its similarity reaches the
threshold is below the tolerance, it is dropped. The pairs that are left, and
no others, are verified exactly by their common shingles.

The classes of a band's value are cut into blocks, and each pair of blocks is a
unit of its own. Pairs are never rows: a first pass over the units tells which
classes have a pair left; their shingles go to the unit, which finds these
pairs again and verifies them. A pair is looked at in the first band that it
agrees in only. A unit returns a spanning forest of its links and sums by class.

Words are those of ``decontaminate.words``. A text of fewer than five words is
one shingle of all of them; null and empty texts have none, belong to no
group, and are classes of their own. Texts of any length are read whole; a long
one counts for as many as its shingles when blocks are cut. Repeated rows are
copies of each other. A null id is a row like any other; in a group it comes
after all ids. Ties go to the smallest id. An empty table gives no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of, key_filter, let_through, scratch, tidy
from .components import connected
from .decontaminate import words

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: MinHash values of a class, and how they are banded: at the threshold a pair misses all bands with probability (1 - 0.8**4)**20 = 2.6e-5.
HASHES = 128
ROWS = 4
BANDS = 20
#: Values compared before each decision, and the posterior below which a pair is dropped.
STEP = 32
TOLERANCE = 1e-6
#: Classes of a block, and their shingles, about.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Up to so many pairs for each class of a unit are verified one by one, more by products of matrices.
SPARSE = 4

_RNG = np.random.default_rng(20240301)
_FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64)
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * _MIX[k % SHINGLE]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minhash(found: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        low = np.minimum(low, (found[None, at : at + 2048] * _FACTORS[:, None]).min(1))
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    x = np.ascontiguousarray(sig[: ROWS * BANDS].astype("<u2")).view("<u8") if ROWS == 4 else None
    x = (x + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """By how many values were compared: the fewest matches with which a pair goes on.

    With a uniform prior the posterior of the similarity after m matches of n
    is Beta(m + 1, n - m + 1); it reaches the threshold t with the probability
    that of n + 1 draws at t no more than m succeed.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


class _Forest:
    """Union-find over a unit's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join two trees."""
        out = []
        for i, j in pairs.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((i, j))
        return out


def survivors(sig: np.ndarray, side: np.ndarray, need: dict[int, int], band: int | None = None) -> np.ndarray:
    """Pairs of rows that no comparison has dropped; with ``band`` only those for which it is the first band that they agree in."""
    a, cols, within = _sides(side)
    out = []
    for lo in range(0, len(a), 256):
        rows = a[lo : lo + 256]
        same = np.zeros((len(rows), len(cols)), np.uint8)
        for h in range(STEP):
            same += sig[rows, h][:, None] == sig[cols, h][None]
        x, y = np.nonzero(same >= need[STEP])
        i, j, count = rows[x], cols[y], same[x, y].astype(np.int64)
        keep = i < j if within else slice(None)
        i, j, count = i[keep], j[keep], count[keep]
        for n in range(2 * STEP, HASHES + 1, STEP):
            count = count + (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1)
            ok = count >= need[n]
            i, j, count = i[ok], j[ok], count[ok]
        for k in range(0, -1 if band is None else band + 1):
            here = slice(k * ROWS, (k + 1) * ROWS)
            ok = (sig[i, here] == sig[j, here]).all(1) == (k == band)
            i, j = i[ok], j[ok]
        out.append(np.stack([i, j], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def linked(sets: list[np.ndarray], pairs: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Those of ``pairs`` whose sets reach the threshold, exactly."""
    if not len(pairs):
        return pairs
    size = np.array([len(s) for s in sets], np.int64)
    less, more = np.minimum(size[pairs[:, 0]], size[pairs[:, 1]]), np.maximum(size[pairs[:, 0]], size[pairs[:, 1]])
    pairs = pairs[less * threshold.denominator >= threshold.numerator * more]  # others can't reach it
    if len(pairs) <= SPARSE * len(sets):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    else:
        inter = _products(sets, pairs)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - inter
    return pairs[inter * threshold.denominator >= threshold.numerator * union]


def _products(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common shingles of pairs, by products of 0/1 matrices over the shingles that more than one row has."""
    a, at_a = np.unique(pairs[:, 0], return_inverse=True)
    b, at_b = np.unique(pairs[:, 1], return_inverse=True)
    used = np.unique(pairs)
    row = np.repeat(used, [len(sets[i]) for i in used.tolist()])
    _, col, df = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    common = np.zeros((len(a), len(b)), np.float32)
    width = 2048
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        here = slice(*np.searchsorted(col, [lo, lo + width]))
        r, c = row[here], col[here] - lo
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        m = place_a[r] >= 0
        x[place_a[r[m]], c[m]] = 1
        m = place_b[r] >= 0
        y[place_b[r[m]], c[m]] = 1
        common += x @ y.T
    return common[at_a, at_b].astype(np.int64)


def _units(rows: DataFrame, group: list[str], blocks: Column, item: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that it has a part in: unit, and side.

    Side 0: the unit is one block with itself; 1 and 2: the two of a pair.
    """
    return (
        rows.withColumn("_n", blocks.cast("int"))
        .withColumn("_m", F.pmod(F.xxhash64(item), F.col("_n")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("side", F.when(F.col("_m") == F.col("_o"), 0).when(F.col("_m") < F.col("_o"), 1).otherwise(2))
        .withColumn("unit", F.concat_ws("/", *group, F.least("_m", "_o"), F.greatest("_m", "_o")))
        .drop("_n", "_m", "_o")
    )


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with rows, and whether they are the same ones."""
    within = bool((side == 0).any())
    a = np.flatnonzero(side < 2)
    return a, a if within else np.flatnonzero(side == 2), within


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (smallest id of the texts connected by links) and n_links (rows it is linked to)."""
    spark = docs.sparkSession
    need = least_matches(float(threshold), tolerance)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs, sizes = [], [], []
            for text in b.column(1).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                keys.append(_key(found) if len(found) else None)
                sigs.append(minhash(found).astype("<u2").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "key", "sig", "n"])

    signed = _stored(source.mapInArrow(tidy(sign), "doc_id bigint, key binary, sig binary, n bigint"), "signatures")
    # within a class all signatures are equal, so any value will do
    classes = signed.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")).alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    classes = _stored(classes.select("key", F.col("rep.doc_id").alias("rep"), "copies", "sig", "n"), "classes")

    def band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs, sizes = (b.column(k).to_pylist() for k in range(3))
            found = [bands(np.frombuffer(s, "<u2")) for s in sigs]
            numbers = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), numbers, pa.array([k for k in keys for _ in range(BANDS)], pa.binary()), pa.array(np.repeat(np.array(sizes, np.int64), BANDS))], names=["value", "band", "key", "n"]
            )

    banded = classes.select("key", "sig", "n").mapInArrow(tidy(band), "value bigint, band int, key binary, n bigint")
    crowds = banded.groupBy("value", "band").agg(F.count("*").alias("size"), F.sum("n").alias("found")).where("size > 1")
    crowds = cut(crowds.select("value", "band", F.greatest(F.ceil(F.col("size") / BLOCK), F.least("size", F.ceil(F.col("found") / BLOCK_SHINGLES))).alias("blocks")))
    met = banded.drop("n").join(crowds, ["value", "band"]).join(classes.select("key", "sig"), "key")
    units = _units(met, ["band", "value"], F.col("blocks"), "key").select("unit", "side", "band", "key", "sig")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, t in groups_of(batches, "unit"):
            keys, side = t.column("key").to_pylist(), t.column("side").to_pylist()
            number = t.column("band")[0].as_py()
            left = np.unique(survivors(_signatures(t), np.array(side), need, number)).tolist()
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit] * len(left), pa.string()), pa.array([side[i] for i in left], pa.int32()), pa.array([number] * len(left), pa.int32()), pa.array([keys[i] for i in left], pa.binary())],
                    names=["unit", "side", "band", "key"],
                )

    left = _stored(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(tidy(prune), "unit string, side int, band int, key binary"), "candidates")
    wanted = classes.join(left.select("key").distinct(), "key", "left_semi").select("key", "rep", "copies", "sig")

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x) for x in b.column(1).to_pylist()]
            keys = pa.array([_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "key", "found"])

    texts = let_through(source, "doc_id", key_filter(wanted, "rep")).mapInArrow(tidy(load), "doc_id bigint, key binary, found binary")
    loaded = texts.withColumnRenamed("key", "_key").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("_key") == F.col("key"))).select("key", "copies", "sig", "found")
    blocks = left.join(loaded, "key").select("unit", "side", "band", "key", "copies", "sig", "found").repartition("unit").sortWithinPartitions("unit", "key")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, "unit"):
            keys = t.column("key").to_pylist()
            once = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]  # a row may repeat the id and the text
            keys = [keys[i] for i in once]
            t = t.take(once)
            copies = np.array(t.column("copies").to_pylist(), np.int64)
            pairs = survivors(_signatures(t), np.array(t.column("side").to_pylist()), need, t.column("band")[0].as_py())
            pairs = linked([np.frombuffer(x, np.uint64) for x in t.column("found").to_pylist()], pairs, threshold)
            links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(keys)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(keys))
            some = np.flatnonzero(links).tolist()
            tree = _Forest(len(keys)).link(pairs)
            a = [keys[i] for i in some] + [keys[i] for i, _ in tree]
            b = [None] * len(some) + [keys[j] for _, j in tree]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links[some].astype(np.int64).tolist() + [0] * len(tree), pa.int64())], names=["a", "b", "links"]
                )

    verified = _stored(blocks.mapInArrow(tidy(verify), "a binary, b binary, links bigint"), "links")
    links = verified.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = connected(verified.where("b is not null")).select(F.col("id").alias("key"), "root")
    joined = classes.select("key", "rep", "copies").join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = cut(joined.groupBy("root").agg(F.min("rep").alias("class_id")))
    of = joined.join(first, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "key").join(of, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(t.num_rows, HASHES)


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id. Rows that repeat its id and text go too."""
    groups = similar_groups(docs, id_col, text_col)
    path = scratch(docs.sparkSession, "groups")
    groups.write.parquet(path)
    groups = docs.sparkSession.read.schema("doc_id bigint, class_id bigint, n_links bigint").parquet(path)
    winners = groups.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id")).distinct()
    ids = groups.groupBy(F.col("doc_id").alias("_id")).count()
    # few ids are lost or come again: only their rows, and others by chance, are moved by the joins
    same = F.col("_id").eqNullSafe(F.col("_won"))
    odd = ids.join(winners.withColumnRenamed("_id", "_won").withColumn("_kept", F.lit(True)), same, "left").select("_id", "count", F.coalesce("_kept", F.lit(False)).alias("_kept"))
    odd = _stored(odd.where("count > 1 OR NOT _kept"), "odd")
    bits = key_filter(odd, "_id")
    rows = docs.withColumn("_id_", F.col(id_col).cast("bigint"))
    met = let_through(rows, "_id_", bits)
    same = F.col("_id_").eqNullSafe(F.col("_id"))
    kept = let_through(rows, "_id_", bits, held=False).unionByName(met.join(odd, same, "left_anti"))
    again = odd.where("count > 1 AND _kept").select("_id")
    if not again.isEmpty():
        kept = kept.unionByName(met.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.drop("_id_")
