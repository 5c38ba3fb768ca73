"""Checks of edited texts: partial rollback and validation against the text before.

``least_rollback`` looks for the edits to take back so that a text has no more
errors than before. All documents are searched at once: each round halves the
parts of every document's rollback, tries to do without each part, and then
without all that weren't needed one by one. So the rounds grow with the
logarithm of the number of edits, and only documents whose text has errors
take part. What is left can't do without any of its edits; where errors come
from single edits that is the least set of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

Errors = Callable[[DataFrame], DataFrame]


def bracket_errors(lines: DataFrame) -> DataFrame:
    """(doc, try, errors): closers without opener and openers without closer of ``lines`` (doc, try, line_no, line); strings are not looked at."""
    key = ["doc", "try"]
    sums = F.aggregate(
        F.regexp_extract_all("line", F.lit("[{}]"), 0),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("low")),
        lambda a, x: F.struct((a.s + F.when(x == "{", 1).otherwise(-1)).alias("s"), F.least(a.low, a.s + F.when(x == "{", 1).otherwise(-1)).alias("low")),
    )
    rows = lines.select(*key, "line_no", sums.alias("_a"))
    before = F.coalesce(F.sum("_a.s").over(Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_low", before + F.col("_a.low"))
    stray = F.greatest(F.lit(0), -F.min("_low"))
    return rows.groupBy(*key).agg(stray.alias("_stray"), F.sum("_a.s").alias("_sum")).select(*key, (2 * F.col("_stray") + F.col("_sum")).cast("bigint").alias("errors"))


def applied(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with the edits (keys, line_no, after) in place of their lines; of several on a line the last by ``edit``."""
    last = edits.groupBy(*keys, "line_no").agg(F.max_by("after", "edit").alias("_after"))
    return lines.join(last, [*keys, "line_no"], "left").withColumn("line", F.coalesce("_after", "line")).drop("_after")


def _edited(lines: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """(doc, try, line_no, line): ``lines`` (doc, try, line_no, line, edits: in order, with edit and after) with the last of the edits to ``keep``."""
    last = F.try_element_at(F.filter("edits", keep), F.lit(-1))
    return lines.select("doc", "try", "line_no", F.coalesce(last["after"], "line").alias("line"))


def least_rollback(lines: DataFrame, edits: DataFrame, errors: Errors = bracket_errors) -> tuple[DataFrame, int]:
    """(doc, verdict, back, errors_before, errors_after) and the number of rounds.

    ``lines`` (doc, line_no, line), ``edits`` (doc, edit, line_no, after), ``errors``: from lines with a column ``try`` to (doc, try, errors).
    Verdicts: accept, partial (``back`` are taken back) or rollback (all are).
    Lines meet their edits once. In a round each line gets the parts that its edits are in, and then one row a try.
    """
    every = edits.groupBy("doc").agg(F.array_sort(F.collect_set("edit")).alias("all"))
    none = F.array().cast(every.schema["all"].dataType)
    there = edits.where("edit IS NOT NULL").groupBy("doc", "line_no").agg(F.array_sort(F.collect_list(F.struct("edit", "after"))).alias("edits"))
    base = cut(lines.select("doc", "line_no", "line").join(every.select("doc"), "doc", "left_semi").join(there, ["doc", "line_no"], "left"))
    # with all edits (0) and with none (1)
    seen = errors(_edited(base.withColumn("try", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("edits", F.when(F.col("try") == 0, F.col("edits"))), lambda x: F.lit(True)))
    seen = seen.groupBy("doc").agg(F.max(F.when(F.col("try") == 1, F.col("errors"))).alias("before"), F.max(F.when(F.col("try") == 0, F.col("errors"))).alias("after"))
    start = cut(every.join(seen, "doc"))
    # what each document takes back, and into how many parts that is cut next
    state = cut(start.where("after > before").select("doc", "before", F.col("all").alias("back"), F.lit(2).alias("parts")))
    base = cut(base.join(state.select("doc"), "doc", "left_semi"))
    n = F.size("back")
    # the part of the edit at a place (from 0) of ``back``: part i begins at floor(i * n / parts)
    part = lambda place: F.floor(((place + 1).cast("bigint") * F.col("parts") - 1) / n).cast("int")
    rounds, done = 0, []
    while True:
        done.append(state.where("parts = 0").select("doc", "back"))
        state = state.where("parts > 0")
        if state.isEmpty():
            break
        rounds += 1
        state = state.withColumn("parts", F.greatest(F.lit(1), F.least(F.col("parts"), n)))
        # -1: not in ``back``
        parted = F.transform("edits", lambda x: F.named_struct(F.lit("part"), F.when(F.array_contains("back", x["edit"]), part(F.array_position("back", x["edit"]) - 1)).otherwise(-1), F.lit("after"), x["after"]))
        text = base.join(state, "doc").select("doc", "line_no", "line", parted.alias("edits"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("try"))
        tested = errors(_edited(text, lambda x: (x["part"] == -1) | (x["part"] == F.col("try"))))
        free = tested.join(state.select("doc", "before"), "doc").where("errors <= before").groupBy("doc").agg(F.array_sort(F.collect_set("try")).alias("free"))
        found = state.join(free, "doc", "left").withColumn("free", F.coalesce("free", F.array().cast("array<int>")))
        without = lambda ids: F.filter("back", lambda x, i: ~F.array_contains(ids, part(i)))
        found = cut(found.withColumns({"one": without(F.slice("free", 1, 1)), "many": without(F.col("free"))}))
        both = found.where(F.size("free") > 1).select("doc", F.lit(0).alias("try"), "many")
        fits = errors(_edited(base.join(both, "doc"), lambda x: ~F.array_contains("many", x["edit"]))).select("doc", F.col("errors").alias("_e"))
        found = found.join(fits, "doc", "left")
        back = F.when(F.size("free") == 0, F.col("back")).when(F.col("_e") <= F.col("before"), F.col("many")).otherwise(F.col("one"))
        smaller = F.size("free") > 0
        found = found.withColumn("_b", back)
        whole = F.col("parts") >= n
        # parts of one edit that were all needed end the search; after a smaller rollback, parts stay as large as they were
        left = F.greatest(F.lit(1), F.ceil(F.col("parts") * F.size("_b") / F.greatest(F.lit(1), n)).cast("int"))
        nxt = F.when(F.size("_b") == 0, 0).when(smaller & whole, F.size("_b")).when(smaller, F.least(2 * left, F.size("_b"))).when(whole, 0).otherwise(F.least(2 * F.col("parts"), n))
        state = cut(found.select("doc", "before", F.col("_b").alias("back"), nxt.alias("parts")))
    taken = done[0]
    for d in done[1:]:
        taken = taken.unionByName(d)
    found = start.join(cut(taken), "doc", "left").withColumn("back", F.coalesce("back", none))
    verdict = F.when(F.size("back") == 0, "accept").when(F.size("back") == F.size("all"), "rollback").otherwise("partial")
    return found.select("doc", verdict.alias("verdict"), "back", F.col("before").alias("errors_before"), F.col("after").alias("errors_after")), rounds
