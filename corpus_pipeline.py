"""The corpus pipeline: documents through five training-data operators.

Each stage takes all that the one before kept, as written Parquet, and returns
the columns of documents (the last: the ids of the texts in place of the texts).

For all stages: any column may be null. Texts of any length are read whole.
Columns beyond those of documents are kept, also if they are named like a
column of an operator's result. An empty table gives an empty one. Rows that
repeat others are treated alike, except that the second stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, near_duplicates, pieces, suffix_dedup
from sparkloom.llm.common import discard, scratch, scratch_scope, small_batches, table
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.queries import PIECES
from sparkloom.llm.sentencepiece_codec import encode_documents


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns as one, so that none of their names can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(True).alias("_")).alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are labelled ``und`` go: null and empty texts, and those without a letter.

    Texts of any other kind stay, whatever their language or mix of languages.
    Ties between languages decide nothing here.
    """
    small_batches(spark)
    found = langid.identify(packed(docs), langid.fit(docs.select("doc_id", "text", "lang")))
    return unpacked(found.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five words, 0.8) the one of the smallest id stays; of rows that repeat its id and text one.

    Null and empty texts, and texts without words, are in no group and stay. A
    null id comes after all ids.
    """
    small_batches(spark)
    return unpacked(near_duplicates.keep_one(packed(docs)), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are cut out, wherever they stand; bytes of a character that is cut through go with it, and texts that nothing is left of.

    A cut text's number of characters is counted anew. Null texts stay null and
    empty ones empty: nothing was cut from them. Rows that repeat others are
    copies of each other and go altogether if they are long enough.
    """
    small_batches(spark)
    rows = packed(docs).withColumn("_row", F.col("_row").withField("_", F.col("text").isNull()))
    found = suffix_dedup.dedup(rows, with_text=True)
    kept = found.where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
    kept = kept.withColumn("text", F.when(F.col("n_removed") > 0, whole_characters(F.col("kept"))).when(~F.col("_row._"), F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        anew = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("_row", F.when(F.col("n_removed") > 0, F.col("_row").withField("n_chars", anew)).otherwise(F.col("_row")))
    return unpacked(kept, docs)


def whole_characters(raw):
    """Text of bytes; what is no UTF-8 is left out."""
    shown = F.call_function("make_valid_utf8", raw.cast("string"))
    return F.regexp_replace(shown, "�", "")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go of which a twentieth of the words, at least one, lie in a window of a benchmark item.

    Null and empty texts have no words and stay. Without benchmark items all
    texts stay. A null id is judged like any other; rows of one id go together.
    """
    small_batches(spark)
    found = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("_id")).distinct()
    return unpacked(packed(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"), docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids (``ids``, ``n_ids``, ``ids_sha256``, ``round_trip``); null texts have null ids and empty ones none.

    Of equally probable segmentations the one found first from the left is taken.
    """
    small_batches(spark)
    return encode_documents(docs, pieces.load(PIECES)).drop("text", "n_chars")


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_join", near_duplicate_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage needed on the way is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
