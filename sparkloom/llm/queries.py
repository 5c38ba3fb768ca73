"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, langid, lm_score, mixing, near_duplicates, pieces, product_codes, quality, suffix_dedup, urls, warc
from .common import remainder, table
from .decontaminate import decontaminate
from .sentencepiece_codec import encode_documents

#: The subword vocabulary of the queries: a public tokenizer's file.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its group) and n_links (documents of similarity 0.8 or more)."""
    return near_duplicates.similar_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
best AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN best ON best.a = doc_id LEFT JOIN deg ON deg.a = doc_id
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near_ids").cast("bigint").alias("n_near"),
    )


ORACLES["op4_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dwin d JOIN win i ON d.n = i.n AND d.s = i.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
dpos AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw),
freq AS (SELECT t, count(*) AS c FROM dpos GROUP BY t),
ipos AS (SELECT item_id, w, p, unnest(w[p : p + least(13, len(w)) - 1]) AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM iw WHERE len(w) > 0)),
rare AS (SELECT item_id, w, p, list_sort(list(c)) AS cs FROM ipos LEFT JOIN freq USING (t) GROUP BY ALL HAVING count(c) = count(*)),
pick AS (SELECT item_id, w, p FROM rare QUALIFY row_number() OVER (PARTITION BY item_id, w ORDER BY cs, p) = 1),
need AS (SELECT item_id, w, t, count(*) AS need, least(13, len(w)) + 5 AS reach FROM ipos SEMI JOIN pick USING (item_id, w, p) GROUP BY ALL),
occ AS (SELECT item_id, w, doc_id, p, t, need, reach FROM need JOIN dpos USING (t)),
have AS (
  SELECT s.item_id, s.w, s.doc_id, s.p, o.t FROM occ s JOIN occ o ON s.item_id = o.item_id AND s.w = o.w AND s.doc_id = o.doc_id AND o.p >= s.p AND o.p < s.p + s.reach
  GROUP BY ALL HAVING count(*) >= max(o.need)),
full_ AS (SELECT item_id, w, doc_id, p, count(*) AS n FROM have GROUP BY ALL),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM full_ JOIN (SELECT item_id, w, count(*) AS n FROM need GROUP BY ALL) USING (item_id, w, n) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN near USING (doc_id)
"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS b, sha1(h) AS s FROM p),
k AS (SELECT s, max(page_id) AS m FROM d WHERE b >= 1000 GROUP BY s)
SELECT page_id, b AS payload_bytes, d.s AS payload_digest,
  CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM d LEFT JOIN k ON d.s = k.s AND b >= 1000
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_sha256 (null text: null) and round_trip."""
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.load(PIECES), with_ids=False).drop("text")


#: Host, path and verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op8_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
k AS (SELECT s FROM (SELECT md5_number(s) AS s, count(*) AS n FROM w GROUP BY 1) WHERE n > 1),
r AS (SELECT doc_id, p FROM w SEMI JOIN k ON md5_number(w.s) = k.s),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM g),
spans AS (SELECT doc_id, i, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, i),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT d.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = lm_score.score_documents(docs, docs.where(remainder("doc_id", 7) != 2), pieces.load(PIECES))
    return found.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(remainder("doc_id", 5) != 0)
    found = quality.score_documents(docs, labels)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS s
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b)::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= 3
"""


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op12_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
-- sources stop in order of what they hold by weight; the share is that of the first place where the next one doesn't stop
o AS (SELECT *, coalesce(sum(3 * n) OVER a, 0) AS given, sum(w) OVER b AS others, (SELECT sum(n) FROM s) AS whole FROM s
  WINDOW a AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT whole - given AS num, others AS den FROM o WHERE 3 * n * others >= w * (whole - given) ORDER BY n / w, source LIMIT 1),
t AS (SELECT source, n, CASE WHEN 3 * n * den < w * num THEN (3 * n)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM s, e),
r AS (
  SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
    ('0x' || substr(md5('1/' || coalesce('=' || t.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS u,
    row_number() OVER (PARTITION BY t.source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, rate - floor(rate) AS part FROM r)
SELECT doc_id, size, n AS source_size, target, (size * (floor(rate) + least(1, floor((k + 1) * part + u) - floor(k * part + u))))::BIGINT AS taken FROM f
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = product_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(product_codes.books_digest(books)).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One pair of tables for each round: what the parts are assigned to, and the entries after it."""
    sql = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, i, v[i * len(v) // {parts} + 1 : (i + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(i)),
c0 AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS e, v AS c FROM p QUALIFY e < {entries})"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (
  SELECT vec_id, label, i, v, min(d * 1000 + e) % 1000 AS e, min(d) AS d
  FROM (SELECT p.*, e, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM p JOIN c{n} USING (i)) GROUP BY ALL)"""
        if n < rounds:
            sql += f""",
s{n} AS (SELECT i, e, q, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT i, e, unnest(v) AS x, unnest(range(len(v))) AS q FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (
  SELECT i, e, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT i, e, list((s - ((s % n) + n) % n) // n ORDER BY q) AS m FROM s{n} GROUP BY i, e) USING (i, e))"""
    return sql + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', e::INTEGER), '' ORDER BY i) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, e)) FROM c{rounds}) AS codebooks_sha256
FROM r
"""


ORACLES["op13_vector_codes"] = _codes_sql()
