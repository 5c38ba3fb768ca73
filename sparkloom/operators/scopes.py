"""Scopes of source text from its tokens: bracket matching by running depth.

A tokens table is (doc, line_no, at, token) as ``scanning.tokens`` gives it.
The depth behind a bracket is a running sum, less its least value so far where
that is below 0, so closers without opener count for nothing. At one depth an
opener is followed by its closer, the nearest place where the depth falls below
the opener's; one without closer ends with the last token of its text.

What stands between the last ``;``, ``{`` or ``}`` and an opening brace is the
head of a scope; semicolons within parentheses don't end a head. Its kind comes
from the head's words: namespace, type, function (lambdas too), block (control
flow and bare blocks) or list (an initialiser). A head that begins with
``template`` is a template scope as well. Directives stand on lines that begin
with ``#``: conditions reach to their ``#endif``, alternatives to its start,
definitions over their line. This is a reading of the text, not a parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

_CONTROL = r"^(else|if|for|while|switch|do|try|catch)\b"
_LAMBDA = r"\[[^\[\]]*\]( \(.*\))?( mutable| noexcept| -> .*)*$"


def _running(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)


def depths(rows: DataFrame, step: Column, *keys: str) -> DataFrame:
    """``rows`` with the depth behind each, and whether it closes nothing. ``step``: 1, -1 or 0."""
    rows = rows.withColumn("_sum", F.sum(step).over(_running(*keys)))
    low = F.least(F.lit(0), F.min("_sum").over(_running(*keys)))
    before = F.least(F.lit(0), F.min("_sum").over(_running(*keys).rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumns({"depth": F.col("_sum") - low, "stray": F.col("_sum") < F.coalesce(before, F.lit(0))}).drop("_sum")


def matched(brackets: DataFrame, opens: Column) -> DataFrame:
    """Openers of ``brackets`` (doc, at, ..) with ``close``, the place of their closer (null: none)."""
    rows = depths(brackets.withColumn("_open", opens), F.when(opens, 1).otherwise(-1), "doc").where("NOT stray")
    level = F.col("depth") + F.when(F.col("_open"), 0).otherwise(1)
    rows = rows.withColumn("depth", level)
    after = Window.partitionBy("doc", "depth").orderBy("at")
    rows = rows.withColumn("close", F.when(~F.lead("_open").over(after), F.lead("at").over(after)))
    return rows.where("_open").drop("_open", "stray")


def unmatched(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``bad``: braces, brackets and parentheses, each kind by itself, that close nothing or are never closed."""
    token = F.col("token")
    pair = F.when(token.isin("{", "}"), "{").when(token.isin("(", ")"), "(").when(token.isin("[", "]"), "[").otherwise("")
    opens = token.isin("{", "(", "[")
    step = F.when(F.col("_pair") == "", 0).when(opens, 1).otherwise(-1)
    tokens = tokens.withColumn("_pair", pair).withColumn("_cell", F.when(F.col("_pair") == "", F.col("line_no")))
    key = ["doc", "_pair", "_cell"]  # what is no bracket is not sorted with a text's others
    rows = depths(tokens, step, *key)
    rows = rows.withColumn("depth", F.col("depth") + F.when(step < 0, 1).otherwise(0))
    behind = F.lead(opens).over(Window.partitionBy(*key, "stray", "depth").orderBy("at"))
    bad = (F.col("_pair") != "") & (F.col("stray") | (opens & F.coalesce(behind, F.lit(True))))
    return rows.withColumn("bad", bad).drop("_pair", "_cell", "depth", "stray")


def statements(tokens: DataFrame) -> DataFrame:
    """(doc, seg, at, stop, line_no, stop_line, n, tokens, text, ends): runs of tokens up to and without ``;``, ``{`` or ``}``; ``ends`` is that token (null at the end)."""
    # places grow with lines, so a line's first token comes from the order of the text, which the sums below need as well
    begins = F.col("_p").isNull() | (F.col("_p") != F.col("line_no"))
    code = tokens.withColumn("_p", F.lag("line_no").over(Window.partitionBy("doc").orderBy("at")))
    first = F.last(F.when(begins, F.col("token")), ignorenulls=True).over(_running("doc"))
    code = code.withColumn("_d", first).where("_d <> '#'").drop("_d", "_p")
    brace = F.col("token").isin("{", "}")
    code = code.withColumn("_b", F.sum(brace.cast("int")).over(_running("doc")) - brace.cast("int"))
    code = depths(code, F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0), "doc", "_b")
    ends = brace | ((F.col("token") == ";") & (F.col("depth") == 0))
    code = code.withColumn("_ends", ends).withColumn("seg", F.sum(F.col("_ends").cast("int")).over(_running("doc")) - F.col("_ends").cast("int"))
    within = lambda c: F.when(~F.col("_ends"), c)
    size = F.octet_length("token")
    found = code.groupBy("doc", "seg").agg(
        F.min(within(F.col("at"))).alias("at"),
        F.max(within(F.col("at") + size)).alias("stop"),
        F.min(within(F.col("line_no"))).alias("line_no"),
        F.max(within(F.col("line_no"))).alias("stop_line"),
        F.count_if(~F.col("_ends")).alias("n"),
        F.array_sort(F.collect_list(within(F.struct("at", "token")))).alias("_list"),
        F.max(F.when(F.col("_ends"), F.struct("at", "line_no", "token"))).alias("_end"),
    )
    text = F.array_join(F.transform("_list", lambda x: x.token), " ")
    return found.select("doc", "seg", "at", "stop", "line_no", "stop_line", "n", F.col("_list").alias("tokens"), text.alias("text"), F.col("_end.token").alias("ends"), F.col("_end.at").alias("end_at"), F.col("_end.line_no").alias("end_line"))


def head_kind(text: Column) -> tuple[Column, Column]:
    """Kind and name of a scope by its head."""
    plain = F.regexp_replace(text, r"^template < [^(){}]*? > (?=\w)", "")
    words = F.regexp_replace(plain, r"^((inline|static|export|typedef|extern|constexpr|const) )+", "")
    is_type = words.rlike(r"^(class|struct|union|enum)\b") & ~words.contains("(")
    is_lambda = text.rlike(_LAMBDA)
    is_list = words.rlike(r"(=|return|,|\()$") | ((words != "") & ~words.contains("(") & ~words.rlike(_CONTROL))
    called = words.contains("(") & ~words.rlike(_CONTROL)
    kind = (
        F.when(words.rlike(r"^namespace\b"), "namespace").when(is_type, "type").when(words.rlike(_CONTROL) | (words == ""), "block").when(is_lambda, "lambda").when(is_list, "list").when(called, "function").otherwise("block")
    )
    type_name = F.regexp_extract(words, r"^(?:class |struct |union |enum )+(?:\[ \[.*\] \] )?([A-Za-z_]\w*)", 1)
    space_name = F.regexp_extract(words, r"^namespace ([A-Za-z_]\w*(?: :: \w+)*)", 1)
    function_name = F.regexp_extract(words, r"^[^(]*?((?:~ )?[A-Za-z_]\w*|operator[^(]*?) \(", 1)
    name = F.when(kind == "namespace", space_name).when(kind == "type", type_name).when(kind == "function", function_name)
    return kind, F.nullif(F.replace(name, F.lit(" "), F.lit("")), F.lit(""))


def scopes(tokens: DataFrame, found: DataFrame | None = None, conditions: bool = True) -> DataFrame:
    """(doc, start, end, body, start_line, end_line, kind, name); ``body`` is the place of the brace.

    ``found``: ``statements(tokens)``, where they are at hand. Without ``conditions`` directives have no scopes.
    """
    heads = (statements(tokens) if found is None else found).where("ends = '{'")
    last = tokens.groupBy("doc").agg(F.max(F.col("at") + F.octet_length("token")).alias("_last"), F.max("line_no").alias("_last_line"))
    braces = tokens.where("token IN ('{', '}')")
    lined = matched(braces, F.col("token") == "{").select("doc", F.col("at").alias("end_at"), "close")
    closers = braces.where("token = '}'").select("doc", F.col("at").alias("close"), F.col("line_no").alias("close_line"))
    rows = heads.join(lined, ["doc", "end_at"]).join(closers, ["doc", "close"], "left").join(last, "doc")
    kind, name = head_kind(F.col("text"))
    rows = rows.select(
        "doc",
        F.coalesce("at", "end_at").alias("start"),
        F.coalesce(F.col("close") + 1, "_last").alias("end"),
        F.col("end_at").alias("body"),
        F.coalesce("line_no", "end_line").alias("start_line"),
        F.coalesce("close_line", "_last_line").alias("end_line"),
        kind.alias("kind"),
        name.alias("name"),
        F.col("text").startswith("template ").alias("_template"),
    )
    rows = rows.withColumn("kind", F.when(F.col("_template"), F.array(F.lit("template"), "kind")).otherwise(F.array("kind"))).withColumn("kind", F.explode("kind"))
    rows = rows.withColumn("name", F.when(F.col("kind") != "template", F.col("name"))).drop("_template")
    return rows.unionByName(directives(tokens, last)) if conditions else rows


def directives(tokens: DataFrame, last: DataFrame) -> DataFrame:
    """Scopes of conditions, their alternatives and definitions."""
    line = Window.partitionBy("doc", "line_no").orderBy("at")
    rows = tokens.withColumns({"_r": F.row_number().over(line), "word": F.lead("token").over(line), "_name": F.lead("token", 2).over(line), "_stop": F.max(F.col("at") + F.octet_length("token")).over(Window.partitionBy("doc", "line_no"))})
    rows = cut(rows.where("_r = 1 AND token = '#'").drop("_r", "token"))
    opens = F.col("word").isin("if", "ifdef", "ifndef")
    conditions = matched(rows.where(opens | (F.col("word") == "endif")), opens)
    ends = rows.where("word = 'endif'").select("doc", F.col("at").alias("close"), F.col("_stop").alias("_e"), F.col("line_no").alias("_l"))
    whole = conditions.join(ends, ["doc", "close"], "left").join(last, "doc")
    whole = whole.select("doc", F.col("at").alias("start"), F.coalesce("_e", "_last").alias("end"), "at", "line_no", F.coalesce("_l", "_last_line").alias("end_line"))
    # an alternative belongs to the innermost condition around it, whose #endif is the first one behind at its depth
    step = F.when(opens, 1).when(F.col("word") == "endif", -1).otherwise(0)
    others = depths(rows.where(opens | F.col("word").isin("endif", "elif", "else")), step, "doc").where("NOT stray")
    at_level = F.col("depth") + F.when(F.col("word") == "endif", 1).otherwise(0)
    behind = Window.partitionBy("doc", "_level").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    others = others.withColumn("_level", at_level).withColumn("_c", F.first(F.when(F.col("word") == "endif", F.struct("at", "line_no")), ignorenulls=True).over(behind))
    others = others.where("word IN ('elif', 'else') AND _level > 0").join(last, "doc")
    others = others.select("doc", F.col("at").alias("start"), F.coalesce("_c.at", "_last").alias("end"), "at", "line_no", F.coalesce("_c.line_no", "_last_line").alias("end_line"))
    defined = rows.where("word = 'define'").select("doc", F.col("at").alias("start"), F.col("_stop").alias("end"), "at", "line_no", F.col("line_no").alias("end_line"), F.col("_name").alias("name"))
    every = whole.unionByName(others).withColumn("name", F.lit(None).cast("string")).unionByName(defined)
    return every.select("doc", "start", "end", F.col("at").alias("body"), F.col("line_no").alias("start_line"), "end_line", F.lit("preprocessor").alias("kind"), "name")
