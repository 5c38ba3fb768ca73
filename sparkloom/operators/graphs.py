"""The weighted file-symbol graph as node, edge and metric tables.

edges(src, dst, kind, weight, last_seen): a file contains or references a
symbol. nodes(id, is_file, last_seen). Times are integers; 0 is unknown and
never stale. Limits are features (capacity caps), applied by a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut
from .ranking import first_k

#: Ids that are sent to every task; more are joined by a shuffle.
FEW = 200_000


def upsert(edges: DataFrame) -> DataFrame:
    """One row an edge: weights added (each at least 1), the latest time kept."""
    return edges.groupBy("src", "dst", "kind").agg(F.sum(F.greatest("weight", F.lit(1))).alias("weight"), F.max("last_seen").alias("last_seen"))


def replace_edges(edges: DataFrame, files: DataFrame, fresh: DataFrame, kind: str) -> DataFrame:
    """Delete the edges of a kind from ``files`` (src) and put in ``fresh``."""
    own = F.col("kind") == kind
    kept = edges.where(~own).unionByName(edges.where(own).join(files.select("src"), "src", "left_anti"))
    return kept.unionByName(fresh)


def reference_counts(edges: DataFrame) -> DataFrame:
    """Reference weight and containing files of each symbol; a symbol seen without references counts 1."""
    refs = F.sum(F.when(F.col("kind") == "reference", F.col("weight")))
    return edges.groupBy(F.col("dst").alias("id")).agg(F.greatest(F.coalesce(refs, F.lit(0)), F.lit(1)).alias("n_refs"), F.count_if(F.col("kind") == "contains").alias("n_files"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def without_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def fresh(last_seen: Column, cutoff: int) -> Column:
    return (last_seen == 0) | (last_seen >= cutoff)


def prune_stale(nodes: DataFrame, edges: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Drop stale edges, then nodes that are stale and without edges."""
    kept = without_orphans(edges.where(fresh(F.col("last_seen"), cutoff)), nodes)
    linked = endpoints(kept).withColumn("linked", F.lit(True))
    left = nodes.join(linked, "id", "left").where(F.col("linked") | fresh(F.col("last_seen"), cutoff)).drop("linked")
    return left, kept


def cap_edges(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` latest edges; then the heavier, then by name."""
    return first_k(edges, [F.desc("last_seen"), F.desc("weight"), "src", "dst", "kind"], most)


def cap_nodes(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """All but the surplus nodes. First go unconnected ones, then those that are no files, then the rest; the oldest first.

    The surplus is cut by ranges of the removal order, so no single task sorts all nodes.
    """
    nodes = cut(nodes)  # read three times
    surplus = max(0, nodes.count() - most)
    if not surplus:
        return nodes
    linked = endpoints(edges).withColumn("linked", F.lit(True))
    tier = F.when(F.col("linked").isNull(), 0).when(~F.col("is_file"), 1).otherwise(2)
    gone = first_k(nodes.join(linked, "id", "left").select("id", "last_seen", tier.alias("tier")), ["tier", "last_seen", "id"], surplus)
    return nodes.join(gone.select("id"), "id", "left_anti")


def tombstones(before: DataFrame, after: DataFrame, metrics: DataFrame, now: int) -> DataFrame:
    """Metrics of removed nodes, with the time of removal."""
    return before.select("id").join(after.select("id"), "id", "left_anti").join(metrics, "id").withColumn("removed", F.lit(now).cast("bigint"))


def file_counts(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Metrics with n_files counted anew from containing edges; 0 without any."""
    counts = edges.where("kind = 'contains'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"))
    return metrics.join(counts, "id", "left").withColumn("n_files", F.coalesce("_n", F.lit(0))).drop("_n")


def quality(consensus: Column, refs: Column, files: Column, fanout: Column) -> Column:
    """How much a symbol says about its files, between 0.05 and 1.30; without metrics by its fan-out alone."""

    def held(x: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))

    spread = F.least(held(1 / F.sqrt(F.greatest(files, F.lit(1))), 0.05, 1.0), held(1 / F.sqrt(F.greatest(fanout, F.lit(1))), 0.05, 1.0))
    known = held(held(0.35 + held(consensus, 0.0, 1.0) * 0.65, 0.2, 1.0) * held(F.log1p(refs.cast("double")) / 5.0, 0.25, 1.3) * (0.35 + 0.65 * spread), 0.05, 1.3)
    return F.when(consensus.isNull(), held(1 / F.sqrt(F.greatest(fanout, F.lit(1))), 0.08, 0.6)).otherwise(known)


def impact(edges: DataFrame, metrics: DataFrame, changed: DataFrame, hops: int, max_files: int) -> DataFrame:
    """Files reached from ``changed`` (id) over shared symbols: id, hop, score; the nearest and best ``max_files``.

    Caps per file, symbol and frontier are features; each is a window over its
    own key. Frontiers are small by their cap, so a hop joins a bounded side.
    """
    frontier_cap = min(max(max_files * 8, 64), 4096)
    file_cap, symbol_cap = min(max(max_files * 4, 24), 768), min(max(max_files * 3, 32), 1024)
    q = quality(F.col("consensus"), F.col("n_refs"), F.col("n_files"), F.col("fanout"))
    linked = lambda e: e.groupBy("src", "dst").agg(F.max(F.greatest("weight", F.lit(1))).alias("weight"))
    few = lambda rows, n: F.broadcast(rows) if n <= FEW else rows
    # edges are met through the ids that a hop needs, so that of a graph of any size only their links are moved
    visited = cut(changed.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("score")))
    frontier, n = visited, visited.count()
    for hop in range(1, hops + 1):
        from_ids = few(frontier.select(F.col("id").alias("src")).distinct(), n)
        own = linked(edges.join(from_ids, "src", "left_semi"))
        by_file = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        out = own.join(few(frontier.select(F.col("id").alias("src"), F.col("score").alias("base")), n), "src").withColumn("r", F.row_number().over(by_file)).where(F.col("r") <= file_cap)
        steps = cut(out.select(F.col("src").alias("via"), "dst", "base", F.col("weight").alias("w1")))
        met = cut(steps.select("dst").distinct())
        to_ids = few(met, n * file_cap)
        near = cut(linked(edges.join(to_ids, "dst", "left_semi")))
        known = metrics.join(few(met.withColumnRenamed("dst", "id"), n * file_cap), "id", "left_semi").withColumnRenamed("id", "dst")
        symbols = near.groupBy("dst").agg(F.count("*").alias("fanout")).join(known, "dst", "left").select("dst", "fanout", q.alias("quality"))
        others = near.join(visited.select(F.col("id").alias("src")), "src", "left_anti")
        by_symbol = Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
        others = others.withColumn("r", F.row_number().over(by_symbol)).where(F.col("r") <= symbol_cap)
        penalty = F.least(F.greatest(1 / F.sqrt(F.greatest("fanout", F.lit(1))), F.lit(0.06)), F.lit(1.0))
        score = F.col("base") + (F.col("w1") + F.col("weight")) * 0.5 * F.col("quality") * penalty
        reached = steps.join(others, "dst").join(symbols, "dst").groupBy(F.col("src").alias("id")).agg(F.max(score).alias("score"))
        frontier, n = cut(reached.orderBy(F.desc("score"), "id").limit(frontier_cap).select("id", F.lit(hop).alias("hop"), "score")), frontier_cap
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0").orderBy("hop", F.desc("score"), "id").limit(max_files)


def aliased(edges: DataFrame, aliases: DataFrame, rows_a_task: int = 500_000) -> DataFrame:
    """Edges with ends renamed by ``aliases`` (old, new), and merged again; ``edges`` need not be merged before.

    Edges are counted first and dealt into as many tasks as their number asks
    for, so that a task's memory doesn't grow with them. Only aliases are held
    by the joins, edges are not sorted.
    """
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.count() // rows_a_task + 1)
    a = aliases.select(F.col("old").alias("src"), F.col("new").alias("_s")).hint("shuffle_hash")
    b = aliases.select(F.col("old").alias("dst"), F.col("new").alias("_d")).hint("shuffle_hash")
    moved = edges.repartition(n, "src").join(a, "src", "left").repartition(n, "dst").join(b, "dst", "left")
    moved = moved.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "kind", "weight", "last_seen")
    return upsert(moved.repartition(n, "src", "dst"))


def decayed(pairs: DataFrame, now: int, half_life: int, floor: int) -> DataFrame:
    """Counts halved every ``half_life``, rounded half up; those below ``floor`` go."""
    age = F.greatest(F.lit(now) - F.col("last_seen"), F.lit(0))
    n = F.floor(F.col("n") * F.pow(F.lit(2.0), -age / half_life) + 0.5)
    return pairs.withColumn("n", n).where(F.col("n") >= max(1, floor)).withColumn("last_seen", F.lit(now).cast("bigint"))


def top(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    return first_k(rows, [F.desc(by), key], most)


def compact(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, now: int, retention: int, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, metrics and tombstones after pruning, caps and recounting, in that order."""
    # each step's tables are read several times by the next ones, so they are cut
    nodes = cut(nodes)
    left, kept = prune_stale(nodes, cut(edges), now - max(1, retention))
    kept = cut(cap_edges(kept, max_edges))
    left = cut(cap_nodes(cut(left), kept, max_nodes))
    kept = without_orphans(kept, left)
    return left, kept, file_counts(metrics.join(left.select("id"), "id", "left_semi"), kept), tombstones(nodes, left, metrics, now)


def symbol_id(usr: Column, scope: Column, kind: Column, name: Column) -> Column:
    """The most precise id that can be built; bars within parts are escaped."""

    def part(c: Column) -> Column:
        return F.replace(c, F.lit("|"), F.lit("%7C"))

    blank = lambda c: c.isNull() | (c == "")
    return (
        F.when(~blank(usr), F.concat(F.lit("usr|"), part(usr)))
        .when(~blank(scope), F.concat_ws("|", F.lit("scoped"), part(kind), part(scope), part(name)))
        .otherwise(F.concat_ws("|", F.lit("bucket"), part(kind), part(name)))
    )
