"""Trees as labelled rows: structural joins, descendant searches and path patterns.

A node is (doc, start, end, kind), nested or apart from all others of its
document. ``labelled`` numbers nodes in the order in which they begin (``pre``)
and gives their depth, their number of descendants and their parent, so that a
node's descendants are the ``size`` numbers behind its own. A structural join
is then a join of points with intervals, over buckets of numbers.

Nodes of equal span are nested in the order of their kinds; repeated rows are
repeated nodes. Null and empty spans are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import point_in_interval
from .lineage import cut

#: Numbers of a bucket in structural joins.
BUCKET = 1024


def labelled(nodes: DataFrame) -> DataFrame:
    """``nodes`` with pre (from 0), level (from 0), size (number of descendants) and parent (its pre)."""
    nodes = nodes.where("start < end")
    begins = Window.partitionBy("doc").orderBy("start", F.desc("end"), "kind", "_id")
    rows = nodes.withColumn("_id", F.xxhash64(*nodes.columns)).withColumn("pre", (F.row_number().over(begins) - 1).cast("bigint")).drop("_id")
    rows = cut(rows)
    # depth: how many have begun and not ended; at one place ends come first
    marks = rows.select("doc", "pre", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(rows.select("doc", "pre", F.col("end").alias("at"), F.lit(-1).alias("step")))
    order = Window.partitionBy("doc").orderBy("at", "step", "pre").rowsBetween(Window.unboundedPreceding, 0)
    level = marks.withColumn("level", F.sum("step").over(order) - 1).where("step = 1").select("doc", "pre", "level")
    rows = rows.join(level, ["doc", "pre"])
    # the parent is the last node before of the level above; each node stands for its own level and for the one below
    both = rows.withColumn("_own", F.lit(1)).unionByName(rows.withColumn("level", F.col("level") + 1).withColumn("_own", F.lit(0)))
    above = Window.partitionBy("doc", "level").orderBy("pre", F.desc("_own")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("parent", F.last(F.when(F.col("_own") == 0, F.col("pre")), ignorenulls=True).over(above)).where("_own = 1").drop("_own")
    # of the nodes that end before a node, all but those that it holds begin before it, and so do those that hold it
    ends = Window.partitionBy("doc").orderBy("end", F.desc("pre"))
    found = found.withColumn("size", (F.row_number().over(ends) - 1) - F.col("pre") + F.col("level"))
    return cut(found.withColumn("size", F.col("size").cast("bigint")))


def descendants(above: DataFrame, below: DataFrame, itself: bool = False) -> DataFrame:
    """Pairs (doc, a, a_level, b, level, start) of labelled nodes where ``a`` holds ``b``."""
    points = below.select("doc", F.col("pre").alias("b"), "level", "start")
    first = F.col("pre") + (0 if itself else 1)
    spans = above.select("doc", F.col("pre").alias("a"), F.col("level").alias("a_level"), first.alias("_s"), (F.col("pre") + F.col("size")).alias("_e")).where("_s <= _e")
    return point_in_interval(points, spans, ["doc"], "b", "_s", "_e", BUCKET).drop("_s", "_e")


def visible(nodes: DataFrame, is_target: Column, is_stop: Column, root: bool) -> DataFrame:
    """Pairs (doc, a, b): target ``b`` in the tree of ``a`` that a search reaches which doesn't go below stop nodes.

    ``root``: ``a`` itself may be a target or a stop; otherwise only nodes below it.
    """
    targets, stops = nodes.where(is_target), nodes.where(is_stop)
    barred = descendants(stops, targets).groupBy("doc", "b").agg(F.max("a_level").alias("_bar"))
    pairs = descendants(nodes, targets, itself=root).join(barred, ["doc", "b"], "left")
    least = F.coalesce(F.col("_bar"), F.lit(-1))
    own = F.col("a") == F.col("b")
    return pairs.where(own | (F.col("a_level") > least) if root else F.col("a_level") >= least).drop("_bar", "level", "a_level")


def first_descendant(nodes: DataFrame, is_target: Column, is_stop: Column, root: bool = True) -> DataFrame:
    """(doc, a, b): the first reached target of each node that has one, in document order."""
    return visible(nodes, is_target, is_stop, root).groupBy("doc", "a").agg(F.min("b").alias("b"))


def rightmost_descendant(nodes: DataFrame, is_target: Column, is_stop: Column) -> DataFrame:
    """(doc, a, b): the reached target that starts last; of equal starts the later one."""
    return visible(nodes, is_target, is_stop, True).groupBy("doc", "a").agg(F.max_by("b", F.struct("start", "b")).alias("b"))


def children(nodes: DataFrame, kind: str) -> DataFrame:
    """(doc, a, b): the first child of a kind."""
    return nodes.where((F.col("kind") == kind) & F.col("parent").isNotNull()).groupBy("doc", F.col("parent").alias("a")).agg(F.min("pre").alias("b"))


def path_matches(nodes: DataFrame, path: list[tuple[str, str]]) -> DataFrame:
    """Matches (doc, n0, n1, ..) of a path of (axis, kind): ``//`` descendant or ``/`` child of the step before.

    The nodes of a document are read once in order. Each step keeps a stack of
    the open nodes of its kind; a node of the last step gives the matches that
    the stacks hold, so nodes that don't lead to a match are never paired.
    """
    kinds = [k for _, k in path]
    axes = [a for a, _ in path]
    rows = nodes.where(F.col("kind").isin(kinds)).select("doc", "pre", "size", "level", "kind")
    rows = rows.repartition("doc").sortWithinPartitions("doc", "pre")
    doc_kind = nodes.schema["doc"].dataType.simpleString()
    names = [f"n{i}" for i in range(len(path))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stacks = None, [[] for _ in kinds]
        for b in batches:
            out: list[tuple] = []
            for doc, pre, size, level, kind in zip(*(b.column(c).to_pylist() for c in ("doc", "pre", "size", "level", "kind")), strict=True):
                if doc != now:
                    now, stacks = doc, [[] for _ in kinds]
                for s in stacks:
                    while s and s[-1][1] < pre:
                        s.pop()
                # from the last step: a node must not stand on a stack that it is about to be joined with
                for i in range(len(kinds) - 1, -1, -1):
                    if kinds[i] != kind or (i and not any(axes[i] == "//" or above == level - 1 for *_, above in stacks[i - 1])):
                        continue
                    if i == len(kinds) - 1:
                        out.extend((doc, *m) for m in _spelled(stacks, axes, i, pre, level))
                    else:
                        stacks[i].append((pre, pre + size, level))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.schema.field("doc").type, *[pa.int64()] * len(names)), strict=True)], names=["doc", *names])

    return rows.mapInArrow(run, f"doc {doc_kind}, " + ", ".join(f"{n} bigint" for n in names))


def _spelled(stacks: list[list[tuple]], axes: list[str], i: int, pre: int, level: int) -> Iterator[tuple]:
    """All ways up the stacks from a node of step ``i``."""
    if i == 0:
        yield (pre,)
        return
    for p, _, above in stacks[i - 1]:
        if p < pre and (axes[i] == "//" or above == level - 1):
            for m in _spelled(stacks, axes, i - 1, p, above):
                yield (*m, pre)


def twig_matches(nodes: DataFrame, stem: list[tuple[str, str]], branches: list[list[tuple[str, str]]], changed: DataFrame | None = None) -> DataFrame:
    """Matches of a stem whose last node has every branch: columns n0.. of the stem, then of each branch.

    ``changed`` (doc, start, end): only matches whose outermost node shares a byte
    with one of these ranges; other outermost nodes and what only they hold are
    left out before any match is made.
    """
    if changed is not None:
        nodes = _touched(nodes, stem[0][1], {k for p in [stem, *branches] for _, k in p}, changed)
    found, n = path_matches(nodes, stem), len(stem)
    stem_names = [f"n{i}" for i in range(n)]
    for branch in branches:
        more = path_matches(nodes, [*stem, *branch])
        renamed = {f"n{n + i}": f"n{len(found.columns) - 1 + i}" for i in range(len(branch))}
        more = more.select("doc", *stem_names, *[F.col(a).alias(f"_{b}") for a, b in renamed.items()])
        found = found.join(more, ["doc", *stem_names])
        found = found.withColumnsRenamed({f"_{b}": b for b in renamed.values()})
    return found


def _touched(nodes: DataFrame, outer: str, kinds: set[str], changed: DataFrame) -> DataFrame:
    """The nodes of ``kinds`` below nodes of kind ``outer`` that a range touches, and these."""
    size = 4096  # bytes of a bucket
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.greatest(F.col(s), F.col(e) - 1) / size)))
    spans = changed.select("doc", F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s < _e").withColumn("_b", buckets("_s", "_e"))
    tops = nodes.where(F.col("kind") == outer).withColumn("_b", buckets("start", "end")).join(spans, ["doc", "_b"]).where("start < _e AND _s < end")
    tops = cut(tops.select("doc", "pre", "size", "level").distinct())
    rows = nodes.where(F.col("kind").isin(*kinds))
    inside = descendants(tops, rows.where(F.col("kind") != outer)).select("doc", F.col("b").alias("pre")).distinct()
    return rows.join(inside.unionByName(tops.select("doc", "pre")), ["doc", "pre"], "left_semi")
