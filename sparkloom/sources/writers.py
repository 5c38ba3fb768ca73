"""Sinks: report fan-out, versioned tables, the run journal and the result cache.

All are written by Spark's own writers, whose commit makes a version appear
whole or not at all. A version is a folder named by its number; the latest is
found by listing through Hadoop's file system, so any store serves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(records: DataFrame, path: str) -> None:
    """records.ndjson, trace.ndjson (a row for each policy), report.txt and summary.json below ``path``."""
    records.write.mode("overwrite").json(f"{path}/records.ndjson")
    trace = records.select("path", F.explode("policies").alias("p")).select("path", "p.*")
    trace.write.mode("overwrite").json(f"{path}/trace.ndjson")
    text = records.select(F.format_string("%s: %s, %d policies", "path", F.when(F.col("changed"), "changed").otherwise("unchanged"), F.size("policies")).alias("value"))
    text.write.mode("overwrite").text(f"{path}/report.txt")
    one = records.agg(F.count("*").alias("files"), F.count_if("changed").alias("changed"), F.count("error").alias("errors"), F.sum("elapsed_engine_ms").alias("total_engine_ms"))
    one.write.mode("overwrite").json(f"{path}/summary.json")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in whole)


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version and return its number; earlier ones stay for ``read_version``."""
    number = (versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v{number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version, or the latest."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version below {path}")
    return spark.read.parquet(f"{path}/v{number or found[-1]}")


def append_run(spark: SparkSession, path: str, run_id: str, status: str, at_ms: int) -> None:
    """A line of the run journal."""
    spark.createDataFrame([(run_id, status, at_ms)], "run_id string, status string, at_ms bigint").coalesce(1).write.mode("append").parquet(path)


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """Latest status of each run; of one time the later word (RUNNING before others)."""
    last = F.struct("at_ms", (F.col("status") != "RUNNING").cast("int"))
    return spark.read.parquet(path).groupBy("run_id").agg(F.max_by("status", last).alias("status"), F.max("at_ms").alias("at_ms"))


def update_cache(cache: DataFrame | None, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with fresh rows in place of those of the same key."""
    return fresh if cache is None else cache.join(fresh, keys, "left_anti").unionByName(fresh)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_with_backup(df: DataFrame, path: str, run_id: str, backups: str | None = None) -> None:
    """Write a table; what stood there is moved to a backup of the run: beside it with a suffix, or mirrored below ``backups``.

    The manifest (``<path>.manifest``, or below ``backups``) lists run, backup and time.
    """
    spark = df.sparkSession
    at, fs = _fs(spark, path)
    name = at.getName()
    df.write.mode("overwrite").parquet(f"{path}.new-{run_id}")
    kept = f"{backups}/{run_id}/{name}" if backups else f"{path}.bak-{run_id}"
    if fs.exists(at):
        to, _ = _fs(spark, kept)
        fs.mkdirs(to.getParent())
        fs.rename(at, to)
        n = spark.createDataFrame([(run_id, kept)], "run_id string, backup string").withColumn("at", F.current_timestamp())
        n.coalesce(1).write.mode("append").parquet(f"{backups}/{name}.manifest" if backups else f"{path}.manifest")
    fs.rename(_fs(spark, f"{path}.new-{run_id}")[0], at)


def restore(spark: SparkSession, path: str, run_id: str | None = None, backups: str | None = None) -> DataFrame:
    """Put the backup of a run, or the latest, back in place, and read it."""
    at, fs = _fs(spark, path)
    manifest = backup_status(spark, path, backups)
    found = (manifest.where(F.col("run_id") == run_id) if run_id else manifest).orderBy(F.desc("at"), F.desc("run_id")).first()
    if found is None:
        raise FileNotFoundError(f"no backup of {path}" + (f" by run {run_id}" if run_id else ""))
    spark.read.parquet(found.backup).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def backup_status(spark: SparkSession, path: str, backups: str | None = None) -> DataFrame:
    """The manifest: run_id, backup and at."""
    at, _ = _fs(spark, path)
    return spark.read.parquet(f"{backups}/{at.getName()}.manifest" if backups else f"{path}.manifest")


def write_phase(results: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write the texts of results (path, text) that may be written, with a backup; return the results with what is left to say.

    Rows with an error, or without a change or a text, hold nothing to write.
    """
    from ..operators.decisions import held_back

    done = held_back(results)
    write_with_backup(done.where("changed").select("path", F.col("pending_text").alias("text")), path, run_id)
    return done.drop("pending_text")


def append_telemetry(batches: DataFrame, path: str) -> None:
    """Batch telemetry as lines of JSON, behind those of earlier runs."""
    batches.write.mode("append").json(path)


def load_state(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """A stored table of state as this version reads it: missing columns are null, later schemas start empty.

    A folder that can't be read is put aside as ``<path>.corrupt`` and an empty state begins.
    """
    from ..operators.decisions import migrated

    empty = spark.createDataFrame([], schema)
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return empty
    try:
        found = spark.read.parquet(path)
        found.limit(1).collect()
    except Exception:  # whatever the reader says of a damaged file
        fs.rename(at, _fs(spark, f"{path}.corrupt")[0])
        return empty
    names = set(empty.columns)
    found = found.select(*(c for c in found.columns if c in names | {"schema_version"}))
    read = migrated(found, version).where("status <> 'reset'").drop("status")
    return empty.unionByName(read.drop("schema_version") if "schema_version" not in names else read, allowMissingColumns=True)


def write_compile_commands(files: DataFrame, path: str, include_root: str, standard: str) -> None:
    """A compile database for ``files`` (path): an entry a file, with its folder and plain arguments.

    Every file in ``path`` is one JSON array; each task writes its own.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    arguments = F.array(*(F.lit(x) for x in ("clang++", f"-std={standard}", "-x", "c++", "-fsyntax-only", f"-I{include_root}")), F.col("path"))
    entry = F.to_json(F.struct(F.when(folder == "", include_root).otherwise(folder).alias("directory"), F.col("path").alias("file"), arguments.alias("arguments")))

    def array(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            lines = b.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([mark + lines[0], *("," + x for x in lines[1:])])], names=["value"])
                mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    files.select(entry.alias("value")).mapInArrow(array, "value string").write.mode("overwrite").text(path)
