"""Sources: text corpora by glob, report NDJSON, compile commands, settings."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDIT = T.StructType([T.StructField("line", T.LongType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
_HELD = T.StructType([T.StructField("line", T.LongType()), T.StructField("reason", T.StringType())])
_POLICY = T.StructType(
    [T.StructField("policy", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("reason", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("elapsed_ms", "parse_ms", "execute_ms", "checkpoint_ms")]
    + [T.StructField("edits", T.ArrayType(_EDIT)), T.StructField("blocked_lines", T.ArrayType(_HELD))]
    + [T.StructField(c, T.DoubleType()) for c in ("confidence_score", "confidence_threshold")]
)
REPORT = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.DoubleType()) for c in ("elapsed_engine_ms", "elapsed_total_ms", "boot_parse_ms")]
    + [T.StructField("policies", T.ArrayType(_POLICY))]
)
COMMANDS = T.StructType([T.StructField("directory", T.StringType()), T.StructField("file", T.StringType()), T.StructField("command", T.StringType()), T.StructField("arguments", T.ArrayType(T.StringType()))])


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression of a glob: ** crosses folders, * and ? don't, {a,b} are choices."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def scan_files(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """path (below ``root``) and whole text of files that an include glob matches and no exclude glob does; no include, no file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("uri", "^file:/*", "/"), "^" + re.escape(base), "")
    wanted, banned = F.lit(False), F.lit(False)
    for g in include:
        wanted = wanted | path.rlike(glob_regex(g))
    for g in exclude or []:
        banned = banned | path.rlike(glob_regex(g))
    return files.select(path.alias("path"), "text").where(wanted & ~banned)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report records; blank and broken lines are left out, unknown fields ignored."""
    return spark.read.schema(REPORT).option("mode", "DROPMALFORMED").json(path).where("path IS NOT NULL")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """file (absolute) and its sanitized arguments."""
    rows = spark.read.schema(COMMANDS).option("multiLine", True).json(path)
    args = sanitized(F.coalesce("arguments", F.split(F.trim("command"), r"\s+")), F.col("file"))
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    return rows.withColumn("args", args).select(full.alias("file"), "args")


def sanitized(args, file):
    """Arguments without the compiler, -c, -o with its value, and the source itself."""
    before = F.concat(F.array(F.lit("")), args)
    pairs = F.filter(F.arrays_zip(args.alias("arg"), before.alias("prev")), lambda p: p["arg"].isNotNull())
    first = lambda p: (p["prev"] == "") & ~p["arg"].startswith("-")
    keep = F.filter(pairs, lambda p: ~first(p) & ~p["arg"].isin("-c", "-o") & (p["prev"] != "-o") & (p["arg"] != file))
    return F.transform(keep, lambda p: p["arg"])


def read_settings(path: str, profile_defaults: dict | None = None, overrides: dict | None = None) -> dict:
    """Settings of a TOML file over profile defaults, under overrides; tables merge key by key."""

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    with open(path, "rb") as f:
        return merged(merged(profile_defaults or {}, tomllib.load(f)), overrides or {})
