"""Queries on edited texts: includes, moved blocks, aligned declarations and partial rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints, includes, layout
from ..operators.lineage import cut
from ..session import table
from . import source, texts
from .registry import query

#: Parts stand for headers in seven folders. Each includes that of half its key, every tenth the next one, and part 1 closes a cycle.
_FILES = """f AS (SELECT p_partkey AS k, 'd' || (p_partkey % 7) || '/h' || p_partkey || '.h' AS path FROM part),
i AS (
  SELECT path AS file, CASE WHEN k % 2 = 0 THEN 'h' || (k // 2) || '.h' ELSE '../d' || ((k // 2) % 7) || '/./h' || (k // 2) || '.h' END AS name, k % 3 < 2 AS quoted, k FROM f
  UNION ALL SELECT path, 'h' || (k + 1) || '.h', false, k FROM f WHERE k % 10 = 0
  UNION ALL SELECT path, 'h3.h', true, k FROM f WHERE k = 1),
t AS (
  SELECT i.*, r, CASE WHEN r = -1 THEN 'd' || (k % 7) ELSE 'd' || r END AS dir FROM i, (SELECT unnest(range(-1, 7)) AS r) WHERE r >= 0 OR quoted),
p AS (SELECT *, CASE WHEN starts_with(name, '../') THEN replace(substr(name, 4), '/./', '/') ELSE dir || '/' || name END AS tried FROM t),
best AS (SELECT file, name, quoted, min_by(path, r) AS target FROM p JOIN f ON f.path = tried GROUP BY ALL)"""


def _includes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    half = F.floor(k / 2).cast("bigint")
    header = lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit(".h"))
    files = table(spark, sf_dir, "part", "p_partkey").select(k, F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), header(k)).alias("path"))
    far = F.concat(F.lit("../d"), (half % 7).cast("string"), F.lit("/./"), header(half))
    rows = files.select(F.col("path").alias("file"), F.when(k % 2 == 0, header(half)).otherwise(far).alias("name"), (k % 3 < 2).alias("quoted"))
    rows = rows.unionByName(files.where("p_partkey % 10 = 0").select(F.col("path").alias("file"), header(k + 1).alias("name"), F.lit(False).alias("quoted")))
    rows = rows.unionByName(files.where("p_partkey = 1").select(F.col("path").alias("file"), F.lit("h3.h").alias("name"), F.lit(True).alias("quoted")))
    return rows, files


@query(f"WITH {_FILES} SELECT i.file, i.name, i.quoted, target FROM i LEFT JOIN best ON best.file = i.file AND best.name = i.name AND best.quoted = i.quoted")
def include_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = _includes(spark, sf_dir)
    return includes.resolved(rows, files, [f"d{i}" for i in range(7)])


@query(
    f"""WITH RECURSIVE {_FILES}, e AS (SELECT DISTINCT file, target FROM best),
    reach AS (SELECT file, target AS included, 1 AS depth FROM e UNION SELECT r.file, e.target, depth + 1 FROM reach r JOIN e ON e.file = r.included WHERE depth < 40)
    SELECT file, included, min(depth) AS depth FROM reach GROUP BY ALL"""
)
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = _includes(spark, sf_dir)
    return includes.closure(includes.resolved(rows, files, [f"d{i}" for i in range(7)]))


#: Blocks of one to three lines, six lines apart.
_BLOCKS = f"""{texts._L}, b AS (SELECT doc, line_no AS first, line_no + (line_no // 6) % 3 AS last, (line_no // 6 * 7) % 5 AS rank FROM l WHERE line_no % 6 = 2),
whole AS (SELECT b.* FROM b JOIN (SELECT doc, max(line_no) AS n FROM l GROUP BY doc) USING (doc) WHERE last <= n)"""


@query(
    f"""WITH {_BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first) AS slot, row_number() OVER (PARTITION BY doc ORDER BY rank, first) AS place FROM whole),
    m AS (SELECT l.doc, l.line_no, l.line, s.slot, s.first, s.place FROM l LEFT JOIN s ON s.doc = l.doc AND l.line_no BETWEEN s.first AND s.last),
    k AS (SELECT m.doc, m.line, coalesce(t.first, m.line_no) AS major, m.line_no FROM m LEFT JOIN s t ON t.doc = m.doc AND t.slot = m.place)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY major, line_no) AS line_no, line FROM k"""
)
def moved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cut(texts.lines(spark, sf_dir))
    n = lines.groupBy("doc").agg(F.max("line_no").alias("n"))
    sixth = F.floor(F.col("line_no") / 6).cast("bigint")
    blocks = lines.where("line_no % 6 = 2").select("doc", F.col("line_no").alias("first"), (F.col("line_no") + sixth % 3).alias("last"), (sixth * 7 % 5).alias("rank"))
    return layout.reordered(lines, blocks.join(n, "doc").where("last <= n").drop("n"))


@query()
def aligned_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of every document and of a version in which some are gone, renamed or stand elsewhere."""
    declared = cut(source.source_declared(spark, sf_dir)[1].select("doc", "at", F.concat_ws(" ", "kind", "name").alias("item")))
    return layout.alignment(declared, edited_declarations(declared))


def edited_declarations(declared: DataFrame) -> DataFrame:
    at = F.when(F.col("at") % 11 == 0, F.col("at") + 150).otherwise(F.col("at"))
    item = F.when(F.col("at") % 13 == 0, F.concat("item", F.lit("_new"))).otherwise(F.col("item"))
    return declared.where("at % 17 <> 0").select("doc", at.alias("at"), item.alias("item"))


@query()
def validated_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the edits of ``aligned_declarations``; every seventh document's errors grow."""
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    errors = docs.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 3).alias("before"), (F.col("doc_id") % 3 + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0)).alias("after"), F.col("n_chars").alias("n_before"), F.col("n_chars").alias("n_after"))
    return layout.validated(aligned_declarations(spark, sf_dir), errors, 0.01)


@query(
    f"""WITH {texts._L}, e AS (SELECT doc, line_no, (doc + line_no) % 30 = 0 AS bad FROM l WHERE line_no % 3 = 0)
    SELECT doc, CASE WHEN sum(bad::INT) = 0 THEN 'accept' WHEN bool_and(bad) THEN 'rollback' ELSE 'partial' END AS verdict, coalesce(list_sort(list(line_no) FILTER (bad)), []) AS back, 0::BIGINT AS errors_before, sum(bad::INT)::BIGINT AS errors_after
    FROM e GROUP BY doc"""
)
def partial_rollbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line gets new text; some of it leaves a bracket open, and those edits have to go."""
    lines = cut(texts.lines(spark, sf_dir, "CAST(length(line) AS STRING)"))
    after = F.when((F.col("doc") + F.col("line_no")) % 30 == 0, "{").otherwise("{ }")
    edits = lines.where("line_no % 3 = 0").select("doc", F.col("line_no").alias("edit"), "line_no", after.alias("after"))
    found, _ = checkpoints.least_rollback(lines, edits)
    return found.withColumn("back", F.array_sort("back"))
