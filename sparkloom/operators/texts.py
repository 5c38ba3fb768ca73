"""Operators on text lines: exploding, islands, alignment, policies, diffs and edits.

A lines table is (doc, line_no from 1, line). Window operators partition by
document; a document's lines are together in one task, as a text is anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import indent, strip


def explode_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("i", "line")).select("doc", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def by_doc(*more: str) -> Window:
    return Window.partitionBy("doc", *more).orderBy("line_no")


def islands(hits: DataFrame, breaks: Column) -> DataFrame:
    """``hits`` with ``island``: a running number that grows at rows where ``breaks`` (over lag and lead) holds."""
    return hits.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(by_doc()))


def offsets(lines: DataFrame) -> DataFrame:
    """Byte place at which each line starts."""
    before = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))


def is_dashes(c: Column) -> Column:
    return strip(c).rlike("^//-+$")


def is_title(c: Column) -> Column:
    """A comment that is neither empty nor dashes alone."""
    body = strip(F.regexp_replace(strip(c), "^//", ""))
    return strip(c).startswith("//") & (body != "") & ~body.rlike("^-+$")


def dash_comments(lines: DataFrame, auto: bool = True, long: int = 64, short: int = 28, threshold: int = 50, least: int = 28) -> DataFrame:
    """Edits that give dash comments one of two lengths; with ``auto`` at least that of the title next to them, the one before first."""
    size = F.octet_length(strip(F.col("line")))
    rows = lines.withColumn("_t", F.when(is_title(F.col("line")), size))
    title = F.coalesce(F.lag("_t").over(by_doc()), F.lead("_t").over(by_doc()))
    rows = rows.withColumn("_n", title).where(is_dashes(F.col("line")))
    target = F.when(size >= threshold, long).otherwise(short)
    if auto:
        target = F.when(F.col("_n").isNotNull(), F.greatest(target, F.col("_n"), F.lit(least))).otherwise(target)
    after = F.concat(indent(F.col("line")), F.lit("//"), F.repeat(F.lit("-"), target - 2))
    return rows.select("doc", "line_no", F.col("line").alias("before"), after.alias("after")).where("before <> after")


def section_titles(lines: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Edits that replace comment titles by their mapped form; keys in lower case."""
    key = F.lower(strip(F.regexp_replace(strip(F.col("line")), "^//", "")))
    to = F.lit(None).cast("string")
    for k, v in mapping.items():
        to = F.when(key == k.lower(), v).otherwise(to)
    after = F.concat(indent(F.col("line")), F.lit("// "), to)
    return lines.where(is_title(F.col("line"))).select("doc", "line_no", F.col("line").alias("before"), after.alias("after")).where("before <> after")


def blanks_after(lines: DataFrame, marker: Column) -> DataFrame:
    """Blank lines that directly follow each document's first marked line: doc, line_no, blanks."""
    first = lines.where(marker).groupBy("doc").agg(F.min("line_no").alias("at"))
    after = lines.join(first, "doc").where(F.col("line_no") > F.col("at"))
    full = after.groupBy("doc", "at").agg(F.min(F.when(strip(F.col("line")) != "", F.col("line_no"))).alias("stop"), F.max("line_no").alias("last"))
    ends = first.join(full.drop("at"), "doc", "left")
    blanks = F.coalesce(F.col("stop") - F.col("at") - 1, F.col("last") - F.col("at"), F.lit(0))
    return ends.select("doc", F.col("at").alias("line_no"), blanks.cast("bigint").alias("blanks"))


def macro_headers(lines: DataFrame, title: str = "user defined macros") -> DataFrame:
    """Places of blank lines to insert: before a define that directly follows a title between dash comments."""
    w = by_doc()
    dashes = lambda c: strip(c).rlike("^//-*$")
    rows = lines.withColumns({"_a": F.lag("line").over(w), "_b": F.lead("line").over(w), "_c": F.lead("line", 2).over(w)})
    hit = F.lower("line").contains(title) & dashes(F.col("_a")) & dashes(F.col("_b")) & F.regexp_replace(F.col("_c"), r"^\s+", "").startswith("#define")
    return rows.where(F.coalesce(hit, F.lit(False))).select("doc", (F.col("line_no") + 2).alias("line_no"))


def disabled_lines(lines: DataFrame, policy: str) -> DataFrame:
    """Lines on which directives switch ``policy`` off: from a disable to the next enable, both included, and single ignores.

    Lines hold at most one directive here; its targets are a comma list or *.
    """
    mark = r"mjf:\s*(?i:(disable|enable|ignore))\s+([^\r\n]*)"
    action, targets = F.lower(F.regexp_extract("line", mark, 1)), F.lower(F.regexp_extract("line", mark, 2))
    hit = F.exists(F.split(targets, ","), lambda t: F.trim(t).isin("*", policy.strip().lower()))
    rows = lines.withColumn("_a", F.when(hit & (action != ""), action))
    state = F.last(F.when(F.col("_a") != "ignore", F.col("_a")), ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_s", state).where(F.coalesce(F.col("_s") == "disable", F.lit(False)) | F.coalesce(F.col("_a").isin("disable", "ignore"), F.lit(False))).select("doc", "line_no")


def align_groups(lines: DataFrame, hit: Column, at: Column, gap: int = 2) -> DataFrame:
    """Edits that bring ``=`` of neighbouring hit lines into one column.

    Hits join if no more than ``gap`` lines apart with only blank or dash
    comment lines between; groups of one are left. ``at``: bytes before the sign.
    """
    w = by_doc()
    clean = (strip(F.col("line")) == "") | strip(F.col("line")).rlike("^//(-|$)")
    rows = lines.withColumns({"_h": F.coalesce(hit, F.lit(False)), "_dirty": F.sum(F.when(~F.coalesce(hit, F.lit(False)) & ~clean, 1).otherwise(0)).over(w)})
    hits = rows.where("_h")
    apart = (F.col("line_no") - F.lag("line_no").over(w) > gap) | (F.col("_dirty") > F.lag("_dirty").over(w))
    grouped = islands(hits, F.coalesce(apart, F.lit(True)))
    g = Window.partitionBy("doc", "island")
    prefix = F.regexp_replace(F.substring("line", F.lit(1), at), r"\s+$", "")
    sized = grouped.withColumn("_p", prefix).withColumns({"_max": F.max(F.octet_length("_p")).over(g), "_n": F.count("*").over(g)})
    rest = F.substring("line", at + 1, F.length("line"))
    after = F.concat("_p", F.repeat(F.lit(" "), F.col("_max") + 1 - F.octet_length("_p")), rest)
    return sized.where("_n >= 2").select("doc", "line_no", F.col("line").alias("before"), after.alias("after")).where("before <> after")


def runs_of(lines: DataFrame, key: Column, least: int = 3) -> DataFrame:
    """Runs of consecutive lines with an equal key (null: none): doc, first line, length and the lines joined."""
    w = by_doc()
    rows = lines.withColumn("_k", key).where("_k IS NOT NULL")
    broken = (F.lag("line_no").over(w) != F.col("line_no") - 1) | (F.lag("_k").over(w) != F.col("_k"))
    grouped = islands(rows, F.coalesce(broken, F.lit(True)))
    return grouped.groupBy("doc", "island").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "|").alias("merged")).where(F.col("n") >= least).drop("island")


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, adjacent: int = 0) -> DataFrame:
    """Intervals that overlap or touch (or lie ``adjacent`` apart) as one, by key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, start, end, F.when(F.col(start) <= reach + adjacent, 0).otherwise(1).alias("_new"))
    numbered = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def line_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits between two versions of documents: what their common first and last lines leave, matched by place.

    Lines of ``before`` without a counterpart become empty and the other way
    round; rows whose lines are equal are no edits.
    """
    b = before.select("doc", "line_no", F.col("line").alias("old"))
    a = after.select("doc", "line_no", F.col("line").alias("new"))
    nb, na = b.groupBy("doc").agg(F.max("line_no").alias("nb")), a.groupBy("doc").agg(F.max("line_no").alias("na"))
    sizes = nb.join(na, "doc")
    front = b.join(a, ["doc", "line_no"]).where("old <> new").groupBy("doc").agg(F.min("line_no").alias("p"))
    sizes = sizes.join(front, "doc", "left").withColumn("p", F.coalesce(F.col("p") - 1, F.least("nb", "na")))
    rb = b.join(sizes, "doc").select("doc", (F.col("nb") - F.col("line_no")).alias("r"), "old", "nb", "na", "p")
    ra = a.join(sizes.select("doc", "na"), "doc").select("doc", (F.col("na") - F.col("line_no")).alias("r"), "new")
    back = rb.join(ra, ["doc", "r"]).where("old <> new").groupBy("doc").agg(F.min("r").alias("s"))
    sizes = sizes.join(back, "doc", "left").withColumn("s", F.least(F.coalesce("s", F.lit(1 << 40)), F.least("nb", "na") - F.col("p")))
    bm = b.join(sizes, "doc").where("line_no > p AND line_no <= nb - s").select("doc", "line_no", "old")
    am = a.join(sizes, "doc").where("line_no > p AND line_no <= na - s").select("doc", "line_no", "new")
    out = bm.join(am, ["doc", "line_no"], "full").select("doc", "line_no", F.coalesce("old", F.lit("")).alias("before"), F.coalesce("new", F.lit("")).alias("after"))
    return out.where("before <> after")


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts after edits of lines (doc, line_no, before, after); null where an edit's before doesn't match."""
    joined = lines.join(edits.withColumnRenamed("before", "_b").withColumnRenamed("after", "_a"), ["doc", "line_no"], "left")
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("_a", "line").alias("line"))))
    text = F.array_join(F.transform(parts, lambda x: x["line"]), "\n")
    bad = F.bool_or(F.coalesce(F.col("_b") != F.col("line"), F.lit(False)))
    return joined.groupBy("doc").agg(F.when(~bad, text).alias("text"), F.count("_a").alias("n_edits"))


def reverted(lines: DataFrame, originals: DataFrame, chosen: DataFrame) -> DataFrame:
    """``lines`` with those in ``chosen`` (doc, line_no) as they were in ``originals``."""
    old = originals.select("doc", "line_no", F.col("line").alias("_o")).join(chosen, ["doc", "line_no"], "left_semi")
    return lines.join(old, ["doc", "line_no"], "left").select("doc", "line_no", F.coalesce("_o", "line").alias("line"))


def density(lines: DataFrame) -> DataFrame:
    """Lines of each document, and the shares of preprocessor and comment lines in basis points."""
    t = strip(F.col("line"))
    n = F.count("*")
    return lines.groupBy("doc").agg(n.alias("lines"), F.floor(F.count_if(t.startswith("#")) * 10000 / n).cast("bigint").alias("macro_bp"), F.floor(F.count_if(t.startswith("//")) * 10000 / n).cast("bigint").alias("comment_bp"))
