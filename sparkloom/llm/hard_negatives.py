"""Hard negatives by norm-bucketed search: rows of other labels that score close to an anchor's positives.

Each component x becomes floor(scale * x); a score is the inner product of two
integer vectors. Candidates are sorted by norm, largest first, and cut into
levels; by Cauchy-Schwarz no candidate of a level can score more than the
anchor's norm times the level's largest. An anchor goes to a level only if that
bound reaches the least score it still needs: the lower limit of its windows,
or the kth score it has found so far in each, if that is more. Levels are
searched in waves, and kth scores are carried from wave to wave; within a task a
level's rows are again sorted by norm and cut into buckets, which are left out
by the same bound against the kth score as it runs.

Positives are the ``positives`` best rows of the anchor's label, one window
without limits. Negatives are the best ``negatives`` rows of other labels in one
window for each positive: ``lower`` * positive <= 100 * score <= ``upper`` *
positive. Higher scores come first, ties go to the smaller id.

A level is cut into pieces by a hash and the anchors into blocks, so a task
holds at most about ``BLOCK`` candidates and ``ANCHORS`` anchors, and a score is
computed once. Anchors meet candidates in blocks; only what is among the best of
a bucket leaves it. Of rows with equal label and vector only the smallest ids
that a result can show are searched, so a vector shared by many costs a few
rows. The driver gets one row for each of at most ``LEVELS`` levels.

Rows with a null id or label, or whose vector is null, empty, holds a null or
non-finite component or has another length than most take no part. Zero vectors
do; nothing can be left out for their sake. Components are held within a limit
below which scores are exact in doubles (11,863,283 at 64 components, that is
46,340 before the scale of 256); those beyond are taken as if at it. Repeated
rows are one row; rows of one id that differ are each a row, and none of them
goes with an anchor of the same id. Too few rows give fewer positives or
negatives; a positive score below 0 has no window; an empty table gives none.
Columns other than id, label and vector are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, groups_of, tidy
from .product_codes import finite, integers, matrix, most_frequent_length

#: Norm levels, at most, and how many of them a wave has searched when it ends.
LEVELS = 64
WAVES = (1, 8, LEVELS)
#: Candidates and anchors of a task, and candidates of a bucket within it (about).
BLOCK = 4096
ANCHORS = 4096
BUCKET = 1024
#: Pairs of a level and a block of anchors that may be broadcast; beyond, candidates go to all blocks.
VISITED = 100_000

WINDOW = "win array<struct<w:int,lo:double,hi:double,kth:double>>"


def prepare(rows: DataFrame, is_anchor: Column, shown: int, scale: int, id_col: str, label_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Candidates (id, label, v, norm), of equal label and vector the ``shown`` smallest ids; anchors (and key); the length of vectors."""
    kept = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    width = most_frequent_length(kept, F.col("v"))
    limit = math.isqrt((1 << 53) // max(1, width))
    kept = kept.where(F.size("v") == width).withColumn("v", integers(F.col("v"), scale, min(limit, (1 << 31) - 1)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    kept = cut(kept.withColumn("norm", norm))
    anchors = kept.where("anchor").drop("anchor").distinct().withColumn("key", F.xxhash64("id", "label", "v"))
    first = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    candidates = kept.drop("anchor").distinct().withColumn("_r", first).where(F.col("_r") <= shown).drop("_r")
    return cut(candidates), cut(anchors), width


def levels_of(candidates: DataFrame, n: int) -> tuple[DataFrame, list]:
    """Candidates with their level and piece; rows (level, norm, pieces), largest norm first."""
    want = max(1, min(LEVELS, n // BLOCK))
    bounds = sorted(set(candidates.agg(F.percentile_approx("norm", [i / want for i in range(1, want)] or [0.5], 10_000)).first()[0] or []))
    level = sum([(F.col("norm") < b).cast("int") for b in bounds], F.lit(0)) if len(bounds) < 8 else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("norm")))
    placed = candidates.withColumn("level", level)
    found = placed.groupBy("level").agg(F.max("norm").alias("norm"), F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces")).orderBy("level").collect()
    pieces = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.level, r.pieces)]), F.col("level"))
    return cut(placed.withColumn("piece", F.pmod(F.xxhash64("id", "v"), pieces).cast("int"))), found


def best(scores: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` best of each row, and of all that are equal to the kth; none below ``least``."""
    hit = (scores >= least[:, None]) & (scores > -np.inf)
    many = np.nonzero(hit.sum(1) > k)[0]
    if len(many):
        kth = np.partition(scores[many], scores.shape[1] - k, axis=1)[:, -k]
        hit[many] &= scores[many] >= kth[:, None]
    return np.nonzero(hit)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The order by group, score (highest first) and id, with the first ``k`` of each group."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < k]


def search_unit(t: pa.Table, width: int, k: int, same: bool) -> pa.RecordBatch | None:
    """The best of one unit: candidates (kind 0) by norm, and the anchors (kind 1) that came to them."""
    labels = t.column("label").combine_chunks().dictionary_encode()
    code = labels.indices.to_numpy()
    kind, norm, ids = (t.column(c).to_numpy() for c in ("kind", "norm", "id"))
    v = matrix(t.column("v").combine_chunks(), width).astype(np.float64)
    c, a = np.nonzero(kind == 0)[0], np.nonzero(kind == 1)[0]
    if not (len(c) and len(a)):
        return None
    c = c[np.lexsort((ids[c], -norm[c]))]
    wins = t.column("win").combine_chunks().take(pa.array(a)).to_pylist()
    slots = max(map(len, wins))
    lo, hi, run = (np.full((len(a), slots), x) for x in (np.inf, -np.inf, np.inf))
    number = np.zeros((len(a), slots), np.int32)
    for i, win in enumerate(wins):
        for j, w in enumerate(win):
            lo[i, j], hi[i, j], number[i, j] = w["lo"], w["hi"], w["w"]
            run[i, j] = w["lo"] if w["kth"] is None else max(w["lo"], w["kth"])
    empty = np.zeros(0, np.int64)
    held = [(empty, np.zeros(0), empty)] * slots  # by slot: anchor, score, id
    for at in range(0, len(c), BUCKET):
        rows = c[at : at + BUCKET]
        bound = norm[a] * norm[rows[0]] * (1 + 1e-9)
        active = np.nonzero(bound >= run.min(1))[0]
        if not len(active):
            if norm[rows[0]] == 0 or (run.min(1) > 0).all():
                break  # later buckets have no larger norm
            continue
        s = v[a[active]] @ v[rows].T  # exact: whole numbers below 2 ** 53
        fits = (code[a[active]][:, None] == code[rows][None]) == same
        fits &= ids[a[active]][:, None] != ids[rows][None]
        for j in range(slots):
            ok = fits & (s <= hi[active, j][:, None])
            x, y = best(np.where(ok, s, -np.inf), ids[rows], run[active, j], k)
            if not len(x):
                continue
            g, sc, di = (np.concatenate([old, new]) for old, new in zip(held[j], (active[x], s[x, y], ids[rows][y]), strict=True))
            keep = first_of_each(g, sc, di, k)
            held[j] = g, sc, di = g[keep], sc[keep], di[keep]
            n = np.bincount(g, minlength=len(a))
            last = np.full(len(a), np.inf)
            np.minimum.at(last, g, sc)
            run[:, j] = np.where(n >= k, np.maximum(run[:, j], last), run[:, j])
    key, aid = pc.fill_null(t.column("key"), 0).to_numpy()[a], ids[a]
    out = [[], [], [], [], []]
    for j, (g, sc, di) in enumerate(held):
        for col, x in zip(out, (key[g], aid[g], number[g, j], sc, di), strict=True):
            col.append(x)
    arrays = [np.concatenate(x) for x in out]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(d)) for x, d in zip(arrays, (np.int64, np.int64, np.int32, np.int64, np.int64), strict=True)], names=["key", "anchor_id", "w", "score", "id"])


FOUND = "key bigint, anchor_id bigint, w int, score bigint, id bigint"


def search(index: DataFrame, levels: list, asked: DataFrame, n_asked: int, width: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best of each window of each row of ``asked`` (id, label, v, norm, key, win): FOUND and rank."""
    blocks = max(1, math.ceil(n_asked / ANCHORS))
    asked = asked.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    spark, top, begun = index.sparkSession, None, 0
    rank = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, "unit"):
            found = search_unit(t, width, k, same)
            if found is not None and found.num_rows:
                yield found

    for end in WAVES:
        wave, begun = levels[begun:end], end
        if not wave:
            break
        if top is not None:  # what each window needs by now
            full = top.groupBy("key", "w").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") >= k)
            full = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))  # one for each window of an anchor
            kth = F.transform("win", lambda x: F.struct(x.w.alias("w"), x.lo.alias("lo"), x.hi.alias("hi"), F.coalesce(F.try_element_at("kths", x.w), x.kth).alias("kth")))
            asked = cut(asked.join(full, "key", "left").withColumn("win", kth).drop("kths"))
        need = F.array_min(F.transform("win", lambda x: F.greatest(x.lo, F.coalesce(x.kth, x.lo))))
        table = F.array(*[F.struct(F.lit(r.level).alias("level"), F.lit(r.norm).alias("norm"), F.lit(r.pieces).alias("pieces")) for r in wave])
        going = asked.withColumn("to", F.explode(F.filter(table, lambda r: r.norm * F.col("norm") * (1 + 1e-9) >= need)))
        going = going.withColumn("level", F.col("to.level")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("to.pieces") - 1)))
        pairs = going.select("level", "block").distinct()
        those = index.where(F.col("level").between(wave[0].level, wave[-1].level))
        if len(wave) * blocks <= VISITED:
            those = those.join(F.broadcast(cut(pairs)), "level")
        else:
            those = those.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        unit = F.format_string("%d/%d/%d", "level", "piece", "block").alias("unit")
        both = those.select(unit, F.lit(0).alias("kind"), "id", "label", "v", "norm", F.lit(None).cast("bigint").alias("key"), F.expr(f"CAST(NULL AS {WINDOW.split(' ', 1)[1]})").alias("win"))
        both = both.unionByName(going.select(unit, F.lit(1).alias("kind"), "id", "label", "v", "norm", "key", "win"))
        units = blocks * sum(r.pieces for r in wave)
        parts = max(1, min(2 * units, 1 << 15))
        found = both.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(tidy(run), FOUND)
        found = found if top is None else top.drop("rank").unionByName(found)
        top = cut(found.distinct().withColumn("rank", rank).where(F.col("rank") <= k))
    return top if top is not None else spark.createDataFrame([], FOUND + ", rank int")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    candidates, anchors, width = prepare(rows, is_anchor, max(positives + 1, negatives + 1), scale, id_col, label_col, vec_col)
    n, n_asked = candidates.count(), anchors.count()
    if not (n and n_asked):
        out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], out)
    index, levels = levels_of(candidates, n)
    whole = F.expr(f"CAST(array(named_struct('w', 0, 'lo', double('-infinity'), 'hi', double('infinity'), 'kth', CAST(NULL AS double))) AS {WINDOW.split(' ', 1)[1]})")
    near = search(index, levels, anchors.withColumn("win", whole), n_asked, width, positives, True)
    # lower * positive <= 100 * score <= upper * positive, in whole numbers
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    near = near.select("key", "anchor_id", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (-down(f"-{lower} * score")).cast("double").alias("lo"), down(f"{upper} * score").cast("double").alias("hi"))
    open_ = near.where(F.col("lo") <= F.col("hi"))
    windows = open_.groupBy("key").agg(F.collect_list(F.struct("w", "lo", "hi", F.lit(None).cast("double").alias("kth"))).alias("win"))  # as many as positives
    asked = cut(anchors.join(windows, "key"))
    far = search(index, levels, asked, n_asked, width, negatives, False)
    found = far.select("key", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(open_, ["key", "w"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
