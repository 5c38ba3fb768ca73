"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`. The sources, in
order of code points and null last, weigh ``weights`` in turn and share the
whole size of the table; a target stops at ``most`` times its source's size and
what is above goes to the others by weight, until none is above. A document's
expected number of copies is its source's target over its source's size. Within
a source, documents stand in order of size: the expected copies are summed up
in that order, one offset for the source is added, and a document is taken once
for each integer that its stretch of the sum crosses. The order by size keeps
the words taken within about one document's size of the target.

Neither a source nor a size is one task: documents are numbered by a range sort
of their ids, sources and sizes (texts are read once and not shuffled), with
the rows before each range from a table of one row a range. Sources are
numbered alike, so their number isn't bounded, and the targets are found by
aggregates over them, whose scalars alone reach the driver.

Offsets come from a hash of the source and the seed, ties of size are ordered
by a hash of the id, so reruns agree. A null text, a text without words and a
source without words have size 0: their documents are taken 0 words. A null
source is a source of its own. Null ids and repeated rows are documents as any
other; equal rows can't be told apart, so which of them is taken once more
makes no difference. An empty table gives none. Columns other than the id, the
source and the text are not looked at by ``plan``; ``emit`` keeps them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows of a range, about.
RANGE = 1 << 20
#: Ranges, at least.
RANGES = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """``rows`` with their place in ``order`` (from 0) as column ``at``. Rows equal in all of it may stand in any order."""
    ranges = max(RANGES, n // RANGE)
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", before.alias("_start"))  # one row a range
    placed = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("at", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` (source_size, weight) with the column target.

    Each round shares what the stopped sources leave among the others by weight;
    those above their limit stop as well. It ends as soon as none is above.
    """
    whole = sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0]
    share, limit = Fraction(0), F.lit(most) * F.col("source_size")
    over = F.lit(False)
    stopped = -1
    while True:
        r = sources.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, limit.cast("decimal(38,0)"))).alias("given"),
            F.sum(F.when(~over, F.col("weight").cast("decimal(38,0)"))).alias("weight"),
        ).first()
        if r.n == stopped or not r.weight:
            break
        stopped, share = r.n, Fraction(int(whole or 0) - int(r.given or 0), int(r.weight))
        # a source stays stopped: the share only grows
        over = limit.cast("decimal(38,0)") * F.lit(share.denominator).cast("decimal(38,0)") < F.col("weight") * F.lit(share.numerator).cast("decimal(38,0)")
    even = (F.col("weight") * F.lit(float(share.numerator))) / F.lit(float(share.denominator))
    return sources.withColumn("target", F.when(over, limit.cast("double")).otherwise(even))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, size, source_size, target, copies and taken (copies times size)."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    by_name = F.col("source").asc_nulls_last()
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    sources = cut(numbered(sources, sources.count(), by_name).withColumn("weight", turn).drop("at"))
    sources = targets(sources, most)
    text = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = by_name, F.col("size"), F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.col("id")
    placed = numbered(rows, rows.count(), *order)
    first = placed.groupBy(F.col("source").alias("_source")).agg(F.min("at").alias("first"))
    known = sources.join(first, F.col("source").eqNullSafe(F.col("_source")))
    known = cut(known.select("_source", "source_size", "target", "first", rate.alias("rate"), offset.alias("offset")))
    # what is left of the whole copies is a rate below 1, so that whole rates are exact at any place
    part = F.col("rate") - F.floor("rate")
    k = F.col("at") - F.col("first")
    crossed = F.least(F.lit(1), F.floor((k + 1) * part + F.col("offset")) - F.floor(k * part + F.col("offset")))
    found = placed.join(known, F.col("source").eqNullSafe(F.col("_source")))
    copies = (F.floor("rate") + crossed).cast("bigint")
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` (of distinct ids) as often as ``planned`` takes it."""
    taken = planned.where(F.col("copies") > 0).select(F.col(id_col).alias("_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return docs.join(taken, docs[id_col].eqNullSafe(taken["_id"])).drop("_id", "_copy")
