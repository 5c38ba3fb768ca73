"""Gates, traces and small lookups between the larger operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import strip

LADDER = ("Advisory", "Soft", "Hard", "Must")


def error_lines(regions: DataFrame) -> DataFrame:
    """Every line of the diagnostic regions (file, s, e), once."""
    return regions.select("file", F.explode(F.sequence("s", "e")).alias("line")).distinct()


def understood(edits: DataFrame, errors: DataFrame) -> DataFrame:
    """Edits of lines that have no parse error."""
    return edits.join(errors.select("file", "line"), ["file", "line"], "left_anti")


def within_scope(edits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edits of allowed lines; a policy that rewrites loses all its edits of a file if one lies outside."""
    marked = edits.join(allowed.select("file", "line", F.lit(True).alias("_in")), ["file", "line"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    whole = F.bool_and("_in").over(Window.partitionBy("file", "policy"))
    return marked.withColumn("_all", whole).where(F.col("_in") & (~F.col("rewrite") | F.col("_all"))).drop("_in", "_all")


def may_vote(symbols: Column, success: Column, fatal: Column, errors: Column) -> Column:
    """A parse with symbols that succeeded or has at most one fatal and six errors."""
    return (symbols > 0) & (success | ((fatal <= 1) & (errors <= 6)))


def candidate_outcome(kept: Column, zone: Column, hard: Column, dropped: Column) -> Column:
    return F.when(kept, "Selected").when(zone, "BlockedZone").when(hard, "BlockedHardConstraint").when(dropped, "DroppedConflict").otherwise("DroppedConvergence")


def step_enforcement(level: Column, harden: bool) -> Column:
    """One step on the ladder; Must stays, and the ends hold."""
    out = level
    for i, name in enumerate(LADDER):
        to = LADDER[min(i + 1, 3)] if harden else name if name == "Must" else LADDER[max(i - 1, 0)]
        out = F.when(level == name, to).otherwise(out)
    return out


def rename_confidence(has_id: Column, expected: Column, least: Column) -> Column:
    return F.when(~has_id, 0.5).when(expected <= 0, 0.6).when(least >= expected, 1.0).otherwise(0.8)


def occurrences(decls: DataFrame, refs: DataFrame) -> DataFrame:
    """Declarations (id, name) with expected (references, at least 1) and least (safe ones, at least 1) occurrences."""
    n = refs.groupBy("id").agg(F.count("*").alias("_n"), F.count_if("safe").alias("_s"))
    return decls.join(n, "id", "left").select("id", "name", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("expected"), F.greatest(F.coalesce("_s", F.lit(0)), F.lit(1)).alias("least"))


def named_elsewhere(decls: DataFrame, lines: DataFrame) -> DataFrame:
    """Declarations whose name stands on another line of the file too."""
    other = lines.select("file", "name", F.col("line").alias("_l"))
    return decls.join(other, (decls["file"] == other["file"]) & (decls["name"] == other["name"]) & (decls["line"] != other["_l"]), "left_semi")


def best_signal(rows: DataFrame, key: str) -> DataFrame:
    """The greatest (refs, files, consensus, not from a tombstone) of each key."""
    return rows.groupBy(key).agg(F.max(F.struct("n_refs", "n_files", "consensus", (~F.col("tombstone")).alias("live"))).alias("x")).select(key, "x.*")


def stub_nodes(decls: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Nodes with those declarations that had none, seen now."""
    new = decls.select("id").distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "last_seen").unionByName(new.withColumn("last_seen", F.lit(now).cast("bigint")))


def snapshot(decls: DataFrame, refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per file: distinct declared ids, references, and scopes of each kind."""
    d = decls.groupBy("file").agg(F.count_distinct("id").alias("n_ids"))
    r = refs.groupBy("file").agg(F.count("*").alias("n_refs"))
    s = scopes.groupBy("file").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("function", "type", "namespace", "preprocessor")))
    out = d.join(r, "file", "full").join(s, "file", "full")
    return out.select("file", *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "file"))


def section_breaks(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``breaks``: whether the value differs from the one before (false for the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("breaks", F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(False)))


def top_insert(lines: DataFrame) -> DataFrame:
    """First line of each document that is neither blank, a comment nor a script header; behind the last if there is none."""
    t = strip(F.col("line"))
    code = ~((t == "") | t.startswith("//") | t.startswith("/*") | t.startswith("*") | t.startswith("#!"))
    return lines.groupBy("doc").agg(F.coalesce(F.min(F.when(code, F.col("line_no"))), F.max("line_no") + 1).alias("line_no"))


def main_headers(path: Column, extensions: list[str]) -> Column:
    """Lower-case header names that belong to a source file."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.array(*(F.lower(F.concat(stem, F.lit(e))) for e in extensions))


def declaration_id(usr: Column, path: Column, kind: Column, scope: Column, line: Column, name: Column) -> Column:
    """The parser's id, or one from the place (before hashing, so that it can be compared)."""
    return F.when(F.trim(usr) != "", F.concat(F.lit("usr:"), F.trim(usr))).otherwise(F.concat(F.lit("loc:"), F.concat_ws("|", path, kind, F.coalesce(scope, F.lit("-")), line.cast("string"), name)))


def resolved_profiles(catalog: DataFrame, settings: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Catalog rows with the settings' values in place of theirs where set."""
    s = settings.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return catalog.join(s, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def applied_gate(files: DataFrame) -> DataFrame:
    """What a gate's status (passed, warning, failed_closed) leaves: warnings, violations and errors."""
    s = F.col("status")
    return files.select("file_id", (s == "warning").cast("int").alias("warnings"), (s != "passed").cast("int").alias("violations"), (s == "failed_closed").cast("int").alias("errors"))


def retry_effort(retries: Column, validations: Column, scans: Column) -> Column:
    return 8 * retries + 4 * validations + scans
