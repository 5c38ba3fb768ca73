"""The whole pipeline against a plain version of its stages, on a small table that every stage takes something from."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F
from sparkloom.llm import near_duplicates, pieces
from sparkloom.llm.common import key_filter, let_through
from sparkloom.llm.queries import PIECES

import corpus_pipeline

from .helpers import DOCS, words_text
from .test_structures import plain_groups
from .test_texts import plain_contamination


def removed(texts, length=200):
    raw = [t.encode() for t in texts]
    n = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if n[x[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    passage, bench = words_text(rng, 70), words_text(rng, 40)
    texts = [words_text(rng, 150) for _ in range(8)]
    texts += [texts[0], texts[1] + " tail", " ".join(texts[2].split()[:-1] + ["other"])]  # copies and near copies
    texts += [f"{words_text(rng, 60)} {passage} {words_text(rng, 60)}" for _ in range(3)]  # a passage that repeats
    texts += [f"{words_text(rng, 30)} {bench} {words_text(rng, 30)}", "?! 12 -- 34", "", None]  # contaminated; no language
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, bench), (2, words_text(rng, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    groups = plain_groups([t for _, t in kept])
    kept = [kept[i] for i, root, _ in groups if i == root]
    kept = [(i, t) for (i, _), t in zip(kept, removed([t for _, t in kept])) if t]
    judged = plain_contamination([t for _, t in kept], items)
    kept = [x for x, (n, hit, _) in zip(kept, judged) if not (hit and 20 * hit >= n)]
    v = pieces.load(PIECES)
    want = {i: pieces.encode(v, t) for i, t in kept}

    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert len(want) < len(texts) - 5


def test_language_stage_keeps_mixed_texts(spark):
    words = {"en": "the plain words of this text are english", "de": "die einfachen worte hier sind deutsch", "fr": "les mots simples de cette phrase sont en notre langue"}
    docs = [(100 * k + i, f"{t} {i}", g, "s", 0) for k, (g, t) in enumerate(words.items()) for i in range(20)]
    docs += [(900, " ".join([words["en"]] * 9 + [words["de"]] * 7 + [words["fr"]] * 4), "en", "s", 0), (901, words["en"] + " кириллица" * 6, "en", "s", 0), (902, "日本語", "ja", "s", 0), (903, "12 !?", "en", "s", 0)]
    docs = [(i, t, None if i > 900 else g, s, n) for i, t, g, s, n in docs]
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    assert got == {d[0] for d in docs} - {903}


def test_few_texts_are_moved_for_few_losers(spark):
    """keep_one with joins that can't broadcast: of long texts only those that meet the filter of lost ids are shuffled."""
    rng = np.random.default_rng(5)
    texts = [words_text(random.Random(i), 20) + " " + rng.bytes(20_000).hex() for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, texts[0]), (300, texts[0]), (1, texts[1]), (2, texts[3]), (None, texts[5])], "doc_id int, text string")
    docs = near_duplicates._stored(docs.repartition(4), "rows")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_duplicates.keep_one(docs)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        kept = sorted((r.doc_id, texts.index(r.text)) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == sorted([(i, i) for i in range(300) if i != 3] + [(2, 3)])
    assert "Union" in plan and plan.count("MapInArrow") >= 2  # rows that the filter doesn't hold are in no join


def test_a_filter_parts_the_rows(spark):
    rows = spark.range(2000).withColumn("text", F.col("id").cast("string"))
    bits = key_filter(spark.range(0, 2000, 40), "id")
    held, rest = ({r.id for r in let_through(rows, "id", bits, h).collect()} for h in (True, False))
    assert held | rest == set(range(2000)) and not held & rest and held >= set(range(0, 2000, 40)) and len(rest) > 1500
    assert let_through(rows, "id", None, held=False).count() == 0 and let_through(rows, "id", None).count() == 2000
