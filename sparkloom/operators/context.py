"""Line context: profiles, roles, safety, clusters, impact ranges, modifiers and filter-derived numbers.

Inputs are interval tables by file (scopes, macros) and point tables
(declarations, references, diagnostics); a profile is one row a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import innermost, point_in_interval
from .texts import merge_intervals

# Tolerances by context (reference drop, scope drift) and diagnostic weights per severity.
TOLERANCES = {"exact": (2, 1), "paired": (28, 7), "header": (10, 7), "source": (8, 5), "none": (6, 3)}
BLOCK_KINDS = {"namespace": 0, "type": 1, "function": 2, "preprocessor": 3, "template": 5}
SEVERITY_SHARES = (120 / 27, 320 / 27, 480 / 27)
BUCKETS = 8


def counts_by_line(points: DataFrame, name: str) -> DataFrame:
    return points.groupBy("file", "line").agg(F.count("*").alias(name))


def profiles(lines: DataFrame, scopes: DataFrame, macros: DataFrame, decls: DataFrame, refs: DataFrame, errors: DataFrame, bucket: int = 16) -> DataFrame:
    """file, line, scope (innermost, or global), n_decls, n_refs, in_macro, has_error."""
    keys = ["file", "line"]
    scope = innermost(point_in_interval(lines, scopes, ["file"], "line", "s", "e", bucket), keys, "s", "e").select(*keys, "kind")
    macro = point_in_interval(lines, macros, ["file"], "line", "s", "e", bucket).select(*keys).distinct().withColumn("in_macro", F.lit(True))
    bad = errors.select(*keys).distinct().withColumn("has_error", F.lit(True))
    out = lines.join(scope, keys, "left").join(counts_by_line(decls, "n_decls"), keys, "left").join(counts_by_line(refs, "n_refs"), keys, "left").join(macro, keys, "left").join(bad, keys, "left")
    return out.select(
        *keys, F.coalesce("kind", F.lit("global")).alias("scope"), F.coalesce("n_decls", F.lit(0)).alias("n_decls"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
        F.coalesce("in_macro", F.lit(False)).alias("in_macro"), F.coalesce("has_error", F.lit(False)).alias("has_error"),
    )


def role(n_decls: Column, n_refs: Column, scope: Column) -> Column:
    return (
        F.when((n_decls > 0) & (n_refs > 0), "mixed").when(n_decls > 0, "declaration").when(n_refs > 0, "reference").when(scope.isNotNull(), "structural").otherwise("unknown")
    )


def safe_edit() -> Column:
    """Of a profile: outside macros, and on an error line only where nothing is declared or referenced and no preprocessor scope is."""
    quiet = (F.col("n_decls") == 0) & (F.col("n_refs") == 0) & (F.col("scope") != "preprocessor")
    return ~F.col("in_macro") & (~F.col("has_error") | quiet)


def safe_global() -> Column:
    """Of a profile: no error, and in a macro or outside every scope."""
    return ~F.col("has_error") & (F.col("in_macro") | (F.col("scope") == "global"))


def share_bucket(n: Column, total: Column) -> Column:
    return F.least(F.floor(n * BUCKETS / F.greatest(total, F.lit(1))), F.lit(BUCKETS)).cast("int")


def clusters(found: DataFrame) -> DataFrame:
    """Per file: number of lines, first, last, and eighths of lines by property."""
    n = F.count("*")
    of = {"macro": F.col("in_macro"), "error": F.col("has_error"), "decl": F.col("n_decls") > 0, "ref": F.col("n_refs") > 0}
    of |= {k: F.col("scope") == k for k in ("function", "type", "namespace", "preprocessor")}
    return found.groupBy("file").agg(n.alias("n_lines"), F.min("line").alias("first"), F.max("line").alias("last"), *(share_bucket(F.count_if(c), n).alias(f"b_{k}") for k, c in of.items()))


def impact_ranges(edits: DataFrame, scopes: DataFrame, bucket: int = 16, most: int = 6) -> DataFrame:
    """Up to ``most`` merged ranges (adjacent ones too) of the scopes around edited lines, and lines alone outside scopes."""
    hit = innermost(point_in_interval(edits, scopes, ["file"], "line", "s", "e", bucket), ["file", "line"], "s", "e")
    alone = edits.join(hit.select("file", "line"), ["file", "line"], "left_anti").select("file", F.col("line").alias("s"), F.col("line").alias("e"))
    ranges = merge_intervals(hit.select("file", "s", "e").unionByName(alone).distinct(), ["file"], "s", "e", adjacent=1)
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"))
    return listed.select("file", F.explode(F.slice("x", 1, most)).alias("x")).select("file", "x.s", "x.e")


def modifier(ema: Column, n: Column) -> Column:
    """From 0.5 over 1 (at one half) to 1.3; 1 before three observations."""
    x = F.least(F.greatest(ema, F.lit(0.0)), F.lit(1.0))
    return F.when(n < 3, 1.0).when(x <= 0.5, 0.5 + x).otherwise(1.0 + 0.6 * (x - 0.5))


def block_index(kind: Column) -> Column:
    out = F.lit(4)
    for k, v in BLOCK_KINDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def tolerance(context: Column, which: int) -> Column:
    out = F.lit(TOLERANCES["none"][which])
    for k, v in TOLERANCES.items():
        out = F.when(context == k, v[which]).otherwise(out)
    return out


def diagnostic_score(counts: list[Column], e0: Column, e1: Column) -> Column:
    """Weighted sum of notes, warnings, errors and fatals; weights scale with the mean of two estimates."""
    mean = (e0 + e1) / 2
    weights = [F.lit(1), *(F.floor(mean * s + 0.5) for s in SEVERITY_SHARES)]
    return sum((c * w for c, w in zip(counts, weights, strict=True)), F.lit(0)).cast("bigint")


def retry_batch(e0: Column, deviation: Column) -> Column:
    """Batch size between 512 and 131072, by how surely the estimate is above 0.7."""
    return F.floor(512 + (131072 - 512) / (1 + F.exp(-(10 / (deviation + 0.05)) * (e0 - 0.7)))).cast("bigint")


def consensus_update(nodes: DataFrame, seen: DataFrame, keep: float = 0.85) -> DataFrame:
    """Nodes (id, consensus) after a parse's scores (id, score): kept in part, new ones as seen."""
    joined = nodes.join(seen, "id", "full")
    mixed = F.col("consensus") * keep + F.col("score") * (1 - keep)
    return joined.select("id", F.coalesce(mixed, "consensus", "score").alias("consensus"))


def structural_only(edits: DataFrame) -> DataFrame:
    """Files all of whose edits are structural and no rewrite."""
    return edits.groupBy("file").agg((F.bool_and(F.col("structural") & ~F.col("rewrite")) & (F.count("*") > 0)).alias("safe"))


def best_parse(rows: DataFrame, key: str) -> DataFrame:
    """The parse of each key that succeeded, with least weight, then most symbols, then the first."""
    return rows.groupBy(key).agg(F.min_by("parse", F.struct((~F.col("ok")).cast("int"), F.col("weight"), -F.col("symbols"), F.col("parse"))).alias("parse"))
