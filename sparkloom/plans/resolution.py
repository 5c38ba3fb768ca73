"""Edit resolution: events as edits (line = user, policy = type), line items as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution as op
from ..operators.lineage import cut
from ..session import table
from .registry import query

EDIT = """event_id AS seq, event_type AS policy, user_id AS line, CASE event_type WHEN 'view' THEN 300 WHEN 'click' THEN 500 WHEN 'purchase' THEN 700 WHEN 'signup' THEN 500 ELSE 1000 END AS priority,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS before, CASE WHEN event_id % 2 = 0 OR event_id % 13 = 0 THEN 'B' ELSE 'A' END AS after"""
_ED = f"ed AS (SELECT {EDIT} FROM events)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import _split

    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr(*(x.strip() for x in _split(EDIT)))


@query(
    f"""WITH {_ED}, p AS (SELECT *, lag(policy) OVER w AS pp, lag(before) OVER w AS pb, lag(after) OVER w AS pa FROM ed WHERE line > 0 WINDOW w AS (PARTITION BY line ORDER BY seq))
    SELECT DISTINCT line, pp AS reverted, policy FROM p WHERE pp <> policy AND after = pb AND before = pa"""
)
def revert_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.reverts(_edits(spark, sf_dir))


@query(
    f"""WITH {_ED}, f AS (SELECT line, policy, min(seq) AS seq FROM ed WHERE line > 0 GROUP BY ALL),
    s AS (SELECT line, list_sort(list(policy) OVER (PARTITION BY line ORDER BY seq)) AS t FROM f) SELECT line, array_to_string(t, '|') AS policies FROM s WHERE len(t) >= 3"""
)
def multi_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.multi_touch(_edits(spark, sf_dir), 3)


_CL = f"""{_ED}, r AS (SELECT *, CASE WHEN line > 0 AND before <> after THEN priority END AS p FROM ed),
m AS (SELECT *, max(p) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, max(p) OVER (PARTITION BY line) AS best FROM r),
st AS (SELECT *, CASE WHEN p IS NULL THEN 'void' WHEN NOT p > coalesce(b, -1) THEN 'dropped' WHEN p < best THEN 'suppressed' ELSE 'claimed' END AS status FROM m)"""


@query(f"WITH {_CL} SELECT seq, status FROM st")
def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.line_claims(_edits(spark, sf_dir)).select("seq", "status")


@query(f"WITH {_CL} SELECT policy, count(*) FILTER (status IN ('claimed', 'suppressed')) AS claimed, count(*) FILTER (status = 'suppressed') AS suppressed, count(*) FILTER (status = 'dropped') AS dropped FROM st GROUP BY policy")
def claims_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return op.line_claims(_edits(spark, sf_dir)).groupBy("policy").agg(
        F.count_if(s.isin("claimed", "suppressed")).alias("claimed"), F.count_if(s == "suppressed").alias("suppressed"), F.count_if(s == "dropped").alias("dropped")
    )


CAND = """l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id, 'p' || l_suppkey % 6 AS policy, CAST(floor(l_partkey / 5) AS BIGINT) * 40 + l_partkey % 5 * 2 AS line, CAST(floor(l_partkey / 5) AS BIGINT) * 40 + l_partkey % 5 * 2 - CAST(l_quantity AS BIGINT) % 4 AS s, CAST(floor(l_partkey / 5) AS BIGINT) * 40 + l_partkey % 5 * 2 + l_linenumber % 3 AS e,
  l_suppkey % 50 AS sym, l_discount * 5 + 0.5 AS confidence, l_linenumber % 3 AS risk, CASE WHEN l_orderkey % 9 = 0 THEN 4 WHEN l_orderkey % 9 = 1 THEN 32 ELSE 0 END AS mask, l_tax * 10 AS gain, CAST(l_linenumber % 3 AS BIGINT) AS radius,
  CASE WHEN l_linenumber % 5 = 0 THEN 'preprocessor' WHEN l_linenumber % 5 = 1 THEN 'comments' ELSE 'code' END AS zone"""
_U = "gain + confidence + CASE risk WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0.0 END - CASE risk WHEN 2 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0.0 END - least(0.02 + 0.01, 0.30)"
_CA = f"ca AS (SELECT *, {_U} AS utility FROM (SELECT {CAND} FROM lineitem))"
_BEST = f"""{_CA}, be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY round(utility, 6) DESC, round(confidence, 3) DESC, risk, policy, id) AS r FROM ca) WHERE r = 1),
ad AS MATERIALIZED (SELECT * FROM be WHERE mask & 223 = 0),
ce AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM ad a JOIN ad b ON a.id < b.id AND (a.line = b.line OR (a.policy <> b.policy AND
  ((a.s <= b.e AND b.s <= a.e) OR (a.sym = b.sym AND abs(a.line - b.line) <= greatest(a.radius, b.radius, 1))))))"""


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item proposes an edit; five parts share a neighbourhood of lines."""
    from .reports import _split

    cols = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem", *cols).selectExpr(*(x.strip() for x in _split(CAND)))
    u = op.utility(F.col("gain"), F.col("confidence"), F.col("risk"), F.lit(1), F.lit(1))
    return rows.withColumns({"symbols": F.array("sym"), "utility": u})


@query(f"WITH {_CA} SELECT id, round(utility, 6) AS utility FROM ca")
def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cands(spark, sf_dir).select("id", F.round("utility", 6).alias("utility"))


@query(f"WITH {_BEST} SELECT line, id FROM be")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.best_by_line(_cands(spark, sf_dir)).select("line", "id")


@query(f"WITH {_BEST} SELECT id FROM ad")
def hard_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.admissible(op.best_by_line(_cands(spark, sf_dir))).select("id")


@query(f"WITH {_CA} SELECT id, CASE WHEN zone NOT IN ('code', 'comments') THEN 'zone_blocked' WHEN mask & 223 <> 0 THEN 'hard_blocked' ELSE 'allowed' END AS verdict FROM ca")
def guardian_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.guardian(_cands(spark, sf_dir), ["code", "comments"]).select("id", "verdict")


def _admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.admissible(op.best_by_line(_cands(spark, sf_dir)))


@query(f"WITH {_BEST} SELECT a, b FROM ce")
def conflict_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conflict_edges(_admissible(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_BEST}, x AS MATERIALIZED (SELECT a, b FROM ce UNION SELECT b, a FROM ce), r AS (SELECT id AS a, id AS b FROM ad UNION SELECT r.a, x.b FROM r JOIN x ON r.b = x.a)
    SELECT a AS id, min(b) AS component FROM r GROUP BY a"""
)
def conflict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_admissible(spark, sf_dir))
    return op.components(found.select("id"), op.conflict_edges(found))


@query()
def independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch and bound or greedy in each component; tested against all subsets."""
    found = cut(_admissible(spark, sf_dir).withColumn("weight", F.col("utility")))
    return op.independent_set(found, op.conflict_edges(found)).select("component", "id", "line", "policy")


@query("SELECT p_partkey, round(CASE WHEN b = a THEN 0.0 ELSE 0.6 + (trim(b) = trim(a))::INT * 0.4 + (1 - least(abs(octet_length(encode(trim(b))) - octet_length(encode(trim(a)))) / 32.0, 1.0)) * 0.2 END, 6) AS gain FROM (SELECT p_partkey, p_name AS b, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '  ' || p_name ELSE p_name || p_type END AS a FROM part)")
def style_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    k = F.col("p_partkey") % 3
    after = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("  "), "p_name")).otherwise(F.concat("p_name", "p_type"))
    return p.select("p_partkey", F.round(op.style_gain(F.col("p_name"), after), 6).alias("gain"))


@query(
    """WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), v AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_orderkey) AS votes FROM lineitem GROUP BY ALL)
    SELECT l_partkey, l_returnflag, votes FROM v JOIN n USING (l_partkey) WHERE votes >= n // 2 + 1"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    return op.majority(li, ["l_partkey"], "l_returnflag", "l_orderkey")


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (SELECT count(DISTINCT user_id) AS t FROM events) WHERE n / t * 0.4 >= 1 - 1 / (1 + exp(-5 * (0.4 - 0.5)))")
def proposer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.agreement(table(spark, sf_dir, "events", "user_id", "event_type"), "event_type", "user_id", 0.4)


@query("SELECT c_nationkey AS decl, min(c_mktsegment) AS old, min(c_mktsegment) || '_x' AS new FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1")
def rename_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").where("c_mktsegment = 'MACHINERY'")
    return op.consistent_renames(c.select(F.col("c_nationkey").alias("decl"), F.col("c_mktsegment").alias("old"), F.concat("c_mktsegment", F.lit("_x")).alias("new")))


@query(f"WITH {_CA} SELECT id, CASE WHEN risk = 0 THEN 'preprocessor' WHEN risk = 1 THEN 'comments' ELSE 'code' END AS zone FROM ca")
def zone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cands(spark, sf_dir).select("id", op.zone(F.col("risk") == 0, F.col("risk") == 1).alias("zone"))
