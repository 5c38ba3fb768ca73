"""Edits applied and measured: lenient application, byte extents, coverage, sensitive lines, and finders within lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .texts import apply_edits, line_edits

# Literal suffixes of integer and floating types.
KIND_SUFFIX = {
    "Float": "f", "Double": "", "LongDouble": "L", "Float16": "", "Half": "", "Float128": "Q", "SChar": "", "Short": "", "Int": "", "Long": "L", "LongLong": "LL",
    "UChar": "U", "UShort": "U", "UInt": "U", "ULong": "UL", "ULongLong": "ULL", "Int128": "LL", "UInt128": "ULL",
}
PRIMITIVE_SUFFIX = {"float": "f", "double": "", "int": "", "short": "", "char": ""}


def kept_ends(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.regexp_extract_all(text, F.lit("[^\\n]*\\n|[^\\n]+"), 0)


def lenient(lines: Column, edits: Column) -> Column:
    """The text after edits (line, before, after; by line) of lines with their ends.

    Edits that don't match are passed over. An insertion moves the places of
    later edits down by one and a deletion up, though they are looked up in the
    original lines.
    """
    n = F.size(lines)
    part = lambda frm, to: F.array_join(F.slice(lines, frm + 1, F.greatest(to - frm, F.lit(0))), "")

    def state(src: Column, offset: Column, out: Column) -> Column:
        return F.struct(src.cast("int").alias("src"), offset.cast("int").alias("offset"), out.alias("out"))

    def step(s: Column, e: Column) -> Column:
        index = (e["line"] - 1 + s["offset"]).cast("int")
        adds, drops = (e["before"] == "") & (e["after"] != ""), (e["before"] != "") & (e["after"] == "")
        at = F.greatest(s["src"], F.least(index, n))
        out = F.concat(s["out"], part(s["src"], at))
        same = (at < n) & F.coalesce(F.get(lines, at) == e["before"], F.lit(False))
        return (
            F.when((index < 0) | (adds & (index > n)) | (~adds & (index >= n)), s)
            .when(adds, state(at, s["offset"] + 1, F.concat(out, e["after"])))
            .when(~same, state(at, s["offset"], out))
            .when(drops, state(at + 1, s["offset"] - 1, out))
            .otherwise(state(at + 1, s["offset"], F.concat(out, e["after"])))
        )

    start = state(F.lit(0), F.lit(0), F.lit(""))
    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], part(s["src"], n)))


EXTENT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "old_end", "new_end", "start_row", "start_column", "old_row", "old_column", "new_row", "new_column")])


@F.pandas_udf(EXTENT)
def byte_extent(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """What differs between two texts, as bytes and as (row, column) points: behind their common prefix, before their common suffix."""

    def point(raw: bytes, at: int) -> tuple[int, int]:
        return raw.count(b"\n", 0, at), at - (raw.rfind(b"\n", 0, at) + 1)

    rows = []
    for a, b in zip(old, new, strict=True):
        if a is None or b is None:
            rows.append((None,) * 9)
            continue
        a, b = a.encode(), b.encode()
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        m = min(len(x), len(y))
        other = np.flatnonzero(x[:m] != y[:m])
        front = int(other[0]) if len(other) else m
        m -= front
        other = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
        back = int(other[0]) if len(other) else m
        rows.append((front, len(a) - back, len(b) - back, *point(a, front), *point(a, len(a) - back), *point(b, len(b) - back)))
    return pd.DataFrame(rows, columns=EXTENT.names, dtype="Int32")


def coverage(before: DataFrame, after: DataFrame, declared: DataFrame) -> DataFrame:
    """By document what becomes of declared edits: doc, status, n_declared and n_actual (lines).

    kept: they give the new text, or stand on exactly the lines that changed;
    cleared: nothing changed; normalized: replaced by the actual edits.
    """
    actual = line_edits(before, after)
    text = lambda d: d.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("new"))
    applied = apply_edits(before, declared).select("doc", "text")
    sets = declared.select("doc", "line_no", F.lit(1).alias("d"), F.lit(0).alias("a")).unionAll(actual.select("doc", "line_no", F.lit(0), F.lit(1))).groupBy("doc", "line_no").agg(F.max("d").alias("d"), F.max("a").alias("a"))
    sets = sets.groupBy("doc").agg(F.sum("d").alias("n_declared"), F.sum("a").alias("n_actual"), F.count_if(F.col("a") > F.col("d")).alias("uncovered"))
    rows = before.select("doc").distinct().join(sets, "doc", "left").join(applied, "doc").join(text(after), "doc")
    d, a = (F.coalesce(c, F.lit(0)) for c in ("n_declared", "n_actual"))
    status = F.when((a == 0) & (d > 0), "cleared").when((a == 0) | ((d > 0) & (F.col("text") == F.col("new"))), "kept").when((d == 0) | (F.col("uncovered") > 0) | (d != a), "normalized").otherwise("kept")
    return rows.select("doc", status.alias("status"), d.alias("n_declared"), a.alias("n_actual"))


def stabilized(before: Column, after: Column, n_edits: Column) -> Column:
    """The new text, unless no edit stands for it."""
    return F.when(n_edits == 0, before).otherwise(after)


def commented(line: Column) -> Column:
    return F.ltrim(line).startswith("//") | F.ltrim(line).startswith("#")


def clause_at(line: Column) -> Column:
    """Byte place of the last ``= delete``, or else ``= default``, behind a parenthesis; null without one."""
    found = F.lit(None).cast("int")
    for word in ("default", "delete"):
        head = F.regexp_extract(line, f"(?s)^(.*)= {word}", 1)
        found = F.when(line.contains(f"= {word}") & head.contains("("), F.octet_length(head)).otherwise(found)
    return F.when(~commented(line), found)


def assignment_at(line: Column) -> Column:
    """Byte place of the first ``=`` that assigns: outside strings, parentheses, braces and angle brackets, and no part of another operator."""
    chars = F.split(line, "")
    n = F.size(chars)
    # a struct a character: itself, its neighbours, what follows, and its byte place
    sizes = F.transform(chars, lambda c: F.octet_length(c))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(chars, i).alias("c"), F.get(chars, i + 1).alias("next"), F.get(chars, i - 1).alias("prev"), i.alias("i")))

    def state(par, ang, bra, quote, skip, found):
        cast = [c.cast("int").alias(k) for k, c in (("par", par), ("ang", ang), ("bra", bra), ("skip", skip), ("found", found))]
        return F.struct(*cast, quote.alias("quote"))

    def step(s: Column, x: Column) -> Column:
        c, following = x["c"], x["next"]
        with_ = lambda **k: state(*(k.get(f, s[f]) for f in ("par", "ang", "bra", "quote", "skip", "found")))
        flat = (s["par"] == 0) & (s["bra"] == 0)
        rest = F.ltrim(F.array_join(F.slice(chars, x["i"] + 2, n), ""))
        operator = x["prev"].isin("!", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^")
        clause = rest.startswith("delete") | rest.startswith("default")
        equals = (c == "=") & flat & (s["ang"] <= 0)
        return (
            F.when(s["found"] >= 0, s)
            .when(s["skip"] > 0, with_(skip=s["skip"] - 1))
            .when((s["quote"] != "") & (c == "\\"), with_(skip=F.lit(1)))
            .when(s["quote"] != "", with_(quote=F.when(c == s["quote"], "").otherwise(s["quote"])))
            .when(c.isin('"', "'"), with_(quote=c))
            .when(c == "(", with_(par=s["par"] + 1))
            .when(c == ")", with_(par=s["par"] - 1))
            .when(c == "{", with_(bra=s["bra"] + 1))
            .when(c == "}", with_(bra=s["bra"] - 1))
            .when((c == "<") & flat & (following == "<"), with_(skip=F.lit(1)))
            .when((c == "<") & flat, with_(ang=s["ang"] + 1))
            .when((c == ">") & flat & (s["ang"] > 0) & (following == ">"), with_(ang=F.greatest(s["ang"] - 2, F.lit(0)), skip=F.lit(1)))
            .when((c == ">") & flat & (s["ang"] > 0), with_(ang=s["ang"] - 1))
            .when(equals & (following == "="), with_(skip=F.lit(1)))
            .when(equals & ~F.coalesce(operator, F.lit(False)) & ~clause, with_(found=x["i"]))
            .otherwise(s)
        )

    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(""), F.lit(0), F.lit(-1))
    at = F.aggregate(steps, start, step, lambda s: s["found"])
    place = F.transform(F.array(at), lambda k: F.when(k >= 0, F.aggregate(F.slice(sizes, 1, F.greatest(k, F.lit(0))), F.lit(0), lambda a, b: a + b)))[0]
    return F.when(~commented(line) & line.contains("="), place)


def kind_suffix(kind: Column) -> Column:
    """Suffix of literals of a type kind; null for kinds without literals."""
    return F.create_map(*(F.lit(x) for kv in KIND_SUFFIX.items() for x in kv))[kind]


def type_suffix(name: Column) -> Column:
    """Suffix of literals of a type as it is written (words apart by spaces); null for types without literals."""
    words = F.split(F.trim(name), "\\s+")
    has = lambda w: F.array_contains(words, w)
    longs = F.size(F.filter(words, lambda w: w == "long"))
    single = F.create_map(*(F.lit(x) for kv in PRIMITIVE_SUFFIX.items() for x in kv))[name]
    sized = F.concat(F.when(has("unsigned"), "U").otherwise(""), F.repeat(F.lit("L"), longs))
    return (
        F.when(F.size(words) == 1, F.coalesce(single, F.when(has("unsigned") | has("long"), sized)))
        .when(has("double"), F.when(longs >= 1, "L").otherwise(""))
        .when(longs > 2, None)
        .when(has("unsigned") | has("signed") | has("short") | (longs > 0), sized)
    )


def match_key(line: Column) -> Column:
    return F.regexp_replace(line, "[ \\t\\n\\f\\r]", "")


def is_sensitive(line: Column) -> Column:
    """Lines that a formatter must leave: ends of blocks with their name, and deleted or defaulted functions."""
    key = match_key(line)
    return is_end(line) | (~commented(line) & (key.contains(")=delete;") | key.contains(")=default;")) & key.contains("("))


def is_end(line: Column) -> Column:
    return line.contains("// end ") & line.contains("}")


def keep_sensitive(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines (doc, line_no, line) of a formatted text with the sensitive ones as they were.

    The k-th sensitive line of a text (white space apart) takes the place of the
    k-th equal line of the formatted one. An end comment that was broken over
    comment lines is matched as a whole; the lines that it went on in go.
    """
    w = Window.partitionBy("doc").orderBy("line_no")
    note = F.ltrim("line").startswith("//")
    rows = after.withColumn("_note", note).withColumn("_run", F.sum((~note).cast("int")).over(w))
    # comment lines that follow a line directly, in order, belong to its run
    tails = rows.where("_note").groupBy("doc", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace(F.ltrim("line"), "^//\\s*", "").alias("more")))).alias("xs"))
    heads = rows.where(~F.col("_note") & F.col("line").contains("} // end ")).join(tails, ["doc", "_run"])
    merged = heads.select("doc", "line_no", match_key(F.concat("line", F.array_join(F.transform("xs", lambda x: x["more"]), ""))).alias("key"), F.transform("xs", lambda x: x["line_no"]).alias("gone"))
    plain = after.select("doc", "line_no", match_key(F.col("line")).alias("key"), F.array().cast("array<bigint>").alias("gone"))
    places = plain.unionByName(merged).where("key <> ''").withColumn("r", F.row_number().over(Window.partitionBy("doc", "key").orderBy("line_no", F.size("gone"))))
    kept = before.where(is_sensitive(F.col("line"))).select("doc", match_key(F.col("line")).alias("key"), F.col("line").alias("old"), F.col("line_no").alias("_n"))
    kept = kept.where("key <> ''").withColumn("r", F.row_number().over(Window.partitionBy("doc", "key").orderBy("_n")))
    found = places.join(kept, ["doc", "key", "r"])
    gone = found.select("doc", F.explode("gone").alias("line_no")).distinct()
    out = after.join(found.select("doc", "line_no", "old"), ["doc", "line_no"], "left").join(gone, ["doc", "line_no"], "left_anti")
    return out.select("doc", "line_no", F.coalesce("old", "line").alias("line"))


def line_bounds(lines: DataFrame) -> DataFrame:
    """First and last byte (exclusive, without the line's end) of every line."""
    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("start", F.coalesce(before, F.lit(0)))
    return rows.withColumn("stop", F.col("start") + F.octet_length("line"))


def identifier_at(line: Column, column: Column) -> Column:
    """The first identifier that begins at a byte column (from 1) of a line or later; null without one. For lines of ASCII."""
    found = F.regexp_extract(F.substring(line, column, F.length(line)), "[A-Za-z_][A-Za-z0-9_]*", 0)
    return F.when((column > 0) & (found != ""), found)


def occurrences_of(text: Column, part: str) -> Column:
    """Places (from 0) at which ``part`` begins, also where it overlaps itself."""
    size = F.greatest(F.length(text) - len(part) + 1, F.lit(0))
    return F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (size > 0) & (F.substring(text, i + 1, F.lit(len(part))) == part))


def whole_word(text: Column, word: str) -> Column:
    """Whether an identifier stands in a text with no identifier character beside it."""
    return text.rlike(f"(^|[^A-Za-z0-9_]){word}($|[^A-Za-z0-9_])")


OPENER = r"^\s*(namespace|class|struct)\b[ \t]*([A-Za-z_][A-Za-z0-9_:]*)?[^;{}]*\{[^{}]*$"


def block_ends(lines: DataFrame) -> DataFrame:
    """Lines that end a namespace, class or struct, with the label of its end: doc, line_no, line, label.

    A text approximation: blocks are told by their braces, line by line, those
    in comments and strings too. An opening line and the next one that closes
    its depth are neighbours among the openings and closings of that depth.
    """
    count = lambda sign: F.length("line") - F.length(F.replace("line", F.lit(sign)))
    w = Window.partitionBy("doc").orderBy("line_no")
    rows = lines.withColumn("after", F.sum(count("{") - count("}")).over(w)).withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))
    label = F.rtrim(F.concat_ws(" ", F.regexp_extract("line", OPENER, 1), F.regexp_extract("line", OPENER, 2)))
    opens = rows.where(F.col("line").rlike(OPENER) & (F.col("after") > F.col("before"))).select("doc", F.col("after").alias("depth"), "line_no", label.alias("label"), F.lit(None).cast("string").alias("line"))
    closes = rows.where("after < before").select("doc", F.explode(F.sequence(F.col("after") + 1, F.col("before"))).alias("depth"), "line_no", F.lit(None).cast("string").alias("label"), "line")
    both = opens.unionByName(closes)
    at = Window.partitionBy("doc", "depth").orderBy("line_no")
    found = both.withColumn("label", F.lag("label").over(at)).where("line IS NOT NULL AND label IS NOT NULL")
    return found.groupBy("doc", "line_no").agg(F.min_by(F.struct("line", "label"), "depth").alias("x")).select("doc", "line_no", "x.*")


def end_comments(lines: DataFrame) -> DataFrame:
    """Edits that put ``// end <label>`` behind what ends a namespace, class or struct, where no comment stands there."""
    rows = block_ends(lines).where(F.col("line").contains("}") & ~F.col("line").contains("//"))
    return rows.select("doc", "line_no", F.col("line").alias("before"), F.concat(F.regexp_replace("line", r"\s+$", ""), F.lit(" // end "), "label").alias("after"))


def include_guards(lines: DataFrame, macro: DataFrame, inserts: DataFrame, mode: str) -> DataFrame:
    """Lines put in (doc, line_no, after) so that a header has ``#pragma once`` (pragma), a guard (guard) or both.

    ``macro``: doc, macro; ``inserts``: doc, line_no at which a pragma goes. A
    guard is an ``#ifndef`` with a ``#define`` of the same name behind it.
    """
    text = F.regexp_replace("line", r"\s+", " ")
    once = lines.where(F.trim(text).rlike("^# ?pragma once$")).select("doc").distinct()
    named = lambda word: lines.select("doc", "line_no", F.regexp_extract(F.trim(text), f"^# ?{word} ([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where("name <> ''")
    tests, defines = named("ifndef"), named("define").groupBy("doc", "name").agg(F.max("line_no").alias("_d"))
    guarded = tests.join(defines, ["doc", "name"]).where("_d > line_no").select("doc").distinct()
    out = []
    if mode in ("pragma", "both"):
        out.append(inserts.join(once, "doc", "left_anti").select("doc", F.col("line_no").cast("bigint").alias("line_no"), F.lit("#pragma once").alias("after")))
    if mode in ("guard", "both"):
        out.append(macro.join(guarded, "doc", "left_anti").select("doc", F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("#ifndef "), "macro").alias("after")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


EMPTY_PARAMETERS = r"^(\s*(?:[A-Za-z_][A-Za-z0-9_:<>,*&]*\s+[*&]*)+)(~?[A-Za-z_][A-Za-z0-9_:]*)\s*\(\s*(?:void)?\s*\)(\s*(?:const|noexcept|override|final|->|\{|;|=|$))"


#: The same lines for Java, whose groups recurse once a repetition: nothing is given back, so a line of any length needs no stack.
#: A word stands in the loop only if no bracket follows it; the one before a bracket is the name.
_EMPTY_PARAMETERS = r"^(\s*+(?:[A-Za-z_][A-Za-z0-9_:<>,*&]*+\s++[*&]*+(?!\())++)(~?[A-Za-z_][A-Za-z0-9_:]*+)\s*+\(\s*+(?:void)?+\s*+\)(\s*+(?:const|noexcept|override|final|->|\{|;|=|$))"


def void_parameters(line: Column, require_void: bool = True) -> Column:
    """A declaration's empty parameter list in one form, with no space before it; a text approximation that leaves operators and statements alone."""
    statement = line.rlike(r"^\s*(return|else|new|delete|throw|case|goto|using|typedef)\b") | line.contains("operator")
    return F.when(statement, line).otherwise(F.regexp_replace(line, _EMPTY_PARAMETERS, "$1$2" + ("(void)" if require_void else "()") + "$3"))


def suggested_name(name: Column, prefix: Column) -> Column:
    """The name that conventions ask for (prefix and snake case), or null where it may stay: keywords, constants, and what follows them."""
    from ..functions import names

    bare = F.when((prefix != "") & name.startswith(prefix), F.substring(name, F.length(prefix) + 1, F.length(name))).otherwise(name)
    new = F.concat(prefix, names.to_snake(bare))
    return F.when(names.is_keyword(name) | names.is_constant_like(name) | (new == name), None).otherwise(new)
