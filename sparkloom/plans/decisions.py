"""Queries that decide on proposed edits, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as op
from ..operators.joins import fingerprint_by_key
from ..session import table
from .registry import query

_ED = "ed AS (SELECT event_id AS id, user_id AS file, event_id % 40 AS line, event_type AS policy, 'a' || (event_id % 7) || repeat(' ', (event_id % 3)::INT) AS before, 'a' || (event_id % 5) AS after FROM events)"
_LN = "ln AS (SELECT o_custkey % 150 AS file, o_orderkey % 40 AS line, bool_or(o_orderpriority = '1-URGENT') AS macro, bool_or(o_orderpriority = '2-HIGH') AS unsafe, bool_or(o_orderpriority = '3-MEDIUM') AS comment FROM orders GROUP BY 1, 2)"
_SY = "sy AS (SELECT file, line, list_sort(list(DISTINCT symbol)) AS symbols FROM (SELECT l_suppkey AS file, l_orderkey % 40 AS line, l_partkey % 30 AS symbol FROM lineitem WHERE l_linenumber = 1) GROUP BY 1, 2)"
_RG = "rg AS (SELECT l_suppkey AS file, l_orderkey % 40 AS line, min(l_partkey % 20) AS s, max(l_partkey % 20) AS e FROM lineitem WHERE l_linenumber = 2 GROUP BY 1, 2)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").selectExpr(
        "event_id AS id", "user_id AS file", "event_id % 40 AS line", "event_type AS policy", "'a' || (event_id % 7) || repeat(' ', int(event_id % 3)) AS before", "'a' || (event_id % 5) AS after"
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    flag = lambda v: F.bool_or(F.col("o_orderpriority") == v)
    return rows.groupBy((F.col("o_custkey") % 150).alias("file"), (F.col("o_orderkey") % 40).alias("line")).agg(flag("1-URGENT").alias("macro"), flag("2-HIGH").alias("unsafe"), flag("3-MEDIUM").alias("comment"))


@query("SELECT event_id FROM events WHERE event_id % 40 > 0 AND 'a' || (event_id % 7) || repeat(' ', (event_id % 3)::INT) <> 'a' || (event_id % 5)")
def effective_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.effective(_edits(spark, sf_dir)).select(F.col("id").alias("event_id"))


@query(
    f"""WITH {_ED}, {_LN}, {_SY}, {_RG}, c AS (SELECT ed.*, file % 4 AS n, (file % 13) / 40 AS sd1, (file % 9) / 20 AS sd4, (file % 21) / 10 AS e3, file % 11 <> 0 AS ok FROM ed WHERE line > 0 AND before <> after)
    SELECT id, file, line, round(least(greatest(0.9 - (CASE n WHEN 0 THEN 0 ELSE least(sd1, 0.3) END + CASE n WHEN 0 THEN 0 ELSE least(sd4, 0.3) END), 0), 1), 9)::DOUBLE AS confidence,
      greatest(1, least(greatest(floor(least(greatest(e3 * 2, 0.5), 3) + 0.5), 1), 3))::INT AS radius,
      coalesce(macro, false)::INT * 32 + coalesce(unsafe, false)::INT * 128 + (NOT ok)::INT AS mask, CASE WHEN macro THEN 'preprocessor' WHEN comment THEN 'comments' ELSE 'code' END AS zone,
      coalesce(symbols, []) AS symbols, coalesce(s, line) AS s, coalesce(e, line) AS e,
      round(0.85 * 12 / 17 + (trim(before) = trim(after))::INT * 0.85 * 8 / 17 + (1 - least(abs(length(trim(before)) - length(trim(after))) / 32, 1)) * 0.85 * 4 / 17, 9) AS gain
    FROM c LEFT JOIN ln USING (file, line) LEFT JOIN sy USING (file, line) LEFT JOIN rg USING (file, line)"""
)
def candidate_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    symbols = li.where("l_linenumber = 1").selectExpr("l_suppkey AS file", "l_orderkey % 40 AS line", "l_partkey % 30 AS symbol")
    ranges = li.where("l_linenumber = 2").groupBy(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 40).alias("line")).agg(F.expr("min(l_partkey % 20) AS s"), F.expr("max(l_partkey % 20) AS e"))
    f = F.col("file")
    state = F.struct((f % 4).alias("n"), (f % 13 / 40).alias("sd1"), (f % 9 / 20).alias("sd4"), (f % 21 / 10).alias("e3"), (f % 11 != 0).alias("available"))
    found = op.propose(_edits(spark, sf_dir), _lines(spark, sf_dir), symbols, ranges, state, 0.9, 1)
    return found.withColumns({"confidence": F.round("confidence", 9), "gain": F.round("gain", 9)})


_SG = """sg AS (SELECT user_id AS file, (user_id % 17) / 10 AS e1, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 3 = 0 END AS parsed, user_id % 5 = 0 AS tree_error, count(*) FILTER (event_type = 'error') AS n_errors,
  count(*) FILTER (event_type = 'signup') AS n_usr, sum(event_id % 90)::BIGINT AS n_refs, count(*) AS n_edits, CASE WHEN user_id % 4 = 0 THEN user_id % 3 END AS cap, user_id % 6 AS fails FROM events GROUP BY user_id)"""


@query(
    f"""WITH {_SG}, b AS (SELECT *, floor(least(greatest(e1 * 400, 50), 500))::INT AS x FROM sg),
    c AS (SELECT *, CASE WHEN parsed IS NULL THEN greatest(x - 100, 0) ELSE
      CASE WHEN n_errors = 0 THEN x + parsed::INT * 200 + (NOT tree_error)::INT * 150 + 150 ELSE greatest(x + parsed::INT * 200 + (NOT tree_error)::INT * 150 - least(n_errors, 10) * 20, 0) END + (n_usr > 0)::INT * 100 END AS y FROM b),
    d AS (SELECT *, CASE WHEN fails IN (1, 4) THEN greatest(y - 80, 0) ELSE y END AS z FROM c), e AS (SELECT *, CASE WHEN fails IN (2, 4) THEN greatest(z - 60, 0) ELSE z END AS w FROM d),
    f AS (SELECT *, CASE WHEN fails IN (3, 4) THEN greatest(w - 40, 0) ELSE w END AS v, greatest(CASE WHEN parsed IS NULL THEN 0 WHEN n_refs > 2000 THEN 3 WHEN n_refs > 500 THEN 2 ELSE 1 END, CASE WHEN n_edits > 40 THEN 3 WHEN n_edits > 10 THEN 2 ELSE 1 END, CASE WHEN fails IN (1, 2, 4) THEN 2 ELSE 0 END) AS r FROM e)
    SELECT file, least(v, 1000)::INT AS confidence_bp, (CASE WHEN cap IS NULL THEN r ELSE least(r, greatest(cap, 1)) END)::INT AS radius FROM f"""
)
def convergence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    u = F.col("file")
    rows = ev.groupBy(F.col("user_id").alias("file")).agg(
        F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("event_type") == "signup").alias("n_usr"), F.sum(F.col("event_id") % 90).alias("n_refs"), F.count("*").alias("n_edits")
    )
    failed = F.when(u % 6 == 1, F.array(F.lit("symbol_identity"))).when(u % 6 == 2, F.array(F.lit("scope_integrity"))).when(u % 6 == 3, F.array(F.lit("edit_safety")))
    failed = failed.when(u % 6 == 4, F.array(*map(F.lit, ("declaration_reference_integrity", "scope_integrity", "edit_safety")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"e1": u % 17 / 10, "parsed": F.when(u % 7 != 0, u % 3 == 0), "tree_error": u % 5 == 0, "cap": F.when(u % 4 == 0, u % 3), "failed": failed})
    return op.convergence_signal(rows).select("file", "confidence_bp", "radius")


_LEVEL = "CASE {} % 4 WHEN 0 THEN 'Must' WHEN 1 THEN 'Hard' WHEN 2 THEN 'Soft' ELSE 'Advisory' END"
_DC = f"""dc AS (SELECT c_custkey AS file, ['Apply', 'ApplyPartial', 'Block'][1 + (c_custkey % 3)::INT] AS outcome, {_LEVEL.format('c_nationkey')} AS base, {_LEVEL.format('(c_custkey // 3)')} AS effective,
  CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['LowConsensus'] WHEN 2 THEN ['ClusterAdaptiveRelaxed'] ELSE ['LowConsensus', 'CoverageLow'] END AS reasons,
  ['Neutral', 'Relax', 'Harden'][1 + (c_nationkey % 3)::INT] AS bias, c_custkey % 97 / 97 AS score, 0.5 AS threshold FROM customer)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda c: F.element_at(F.array(*map(F.lit, ("Must", "Hard", "Soft", "Advisory"))), (c % 4 + 1).cast("int"))
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    k = F.col("c_custkey")
    reasons = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("LowConsensus"))).when(k % 4 == 2, F.array(F.lit("ClusterAdaptiveRelaxed"))).otherwise(F.array(F.lit("LowConsensus"), F.lit("CoverageLow")))
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(
        k.alias("file"), pick(k, "Apply", "ApplyPartial", "Block").alias("outcome"), level(F.col("c_nationkey")).alias("base"), level(F.floor(k / 3)).alias("effective"), reasons.alias("reasons"),
        pick(F.col("c_nationkey"), "Neutral", "Relax", "Harden").alias("bias"), (k % 97 / 97).alias("score"), F.lit(0.5).alias("threshold"),
    )


@query(
    f"""WITH {_DC} SELECT file, CASE WHEN bias = 'Relax' AND base <> 'Must' AND outcome = 'Block' THEN 'Apply' ELSE outcome END AS outcome,
      CASE bias WHEN 'Relax' THEN CASE effective WHEN 'Must' THEN 'Must' WHEN 'Hard' THEN 'Soft' ELSE 'Advisory' END WHEN 'Harden' THEN CASE effective WHEN 'Advisory' THEN 'Soft' WHEN 'Soft' THEN 'Hard' ELSE 'Must' END ELSE effective END AS effective,
      array_to_string(CASE WHEN bias = 'Relax' AND NOT list_contains(reasons, 'ClusterAdaptiveRelaxed') THEN list_append(reasons, 'ClusterAdaptiveRelaxed') WHEN bias = 'Harden' THEN list_append(reasons, 'ClusterAdaptiveHardened') ELSE reasons END, ',') AS reasons FROM dc"""
)
def cluster_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cluster_bias(_decisions(spark, sf_dir)).select("file", "outcome", "effective", F.array_join("reasons", ",").alias("reasons"))


_DP = f"{_ED}, {_DC}, dp AS (SELECT file, policy, min_by(line, id) AS first FROM ed GROUP BY 1, 2)"


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edits = _edits(spark, sf_dir)
    d = edits.select("file", "policy").distinct().join(_decisions(spark, sf_dir), "file").withColumn("dropped", F.array((F.col("file") % 40).cast("bigint"), (F.col("file") % 40 + 3).cast("bigint")))
    return op.apply_decisions(edits, d, ["file", "policy"])


@query(f"WITH {_ED}, {_DC} SELECT id FROM ed JOIN dc USING (file) WHERE outcome = 'Apply' OR (outcome = 'ApplyPartial' AND line <> file % 40 AND line <> file % 40 + 3)")
def decided_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0].select("id")


@query(
    f"""WITH {_DP}, w AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'stable' ELSE array_to_string(reasons, ',') END AS why FROM dp JOIN dc USING (file)),
    m AS (SELECT file, policy, first AS line, CASE WHEN outcome = 'Apply' AND base <> effective THEN format('Adaptive tier for ''{{}}'': {{}}->{{}} ({{}})', policy, base, effective, why)
      WHEN outcome = 'ApplyPartial' THEN format('Adaptive partial apply for ''{{}}'' (dropped_lines=2, score={{:.2f}}, threshold={{:.2f}}, reasons={{}})', policy, score, threshold::DOUBLE, why)
      WHEN outcome = 'Block' THEN format('Adaptive decision blocked for ''{{}}'' (score={{:.2f}}, threshold={{:.2f}}, effective={{}}, reasons={{}})', policy, score, threshold::DOUBLE, effective, why) END AS message FROM w)
    SELECT * FROM m WHERE message IS NOT NULL"""
)
def decision_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[1]


_SM = f"""{_ED}, {_LN}, sm AS (SELECT ed.*, NOT coalesce(unsafe, false) AND id % 6 <> 0 AS safe, id % 4 = 0 AS safe_global, coalesce(comment, false) AS error, coalesce(macro, false) AS macro, id % 3 AS n_decl, id % 2 AS n_ref,
  policy = 'error' AS rewrite, policy IN ('click', 'view') AS structural, policy = 'view' AS preprocessor, policy = 'purchase' AS comments, ['exact', 'paired', 'header', 'source', 'none'][1 + (file % 5)::INT] AS context, file % 2 = 0 AS soft FROM ed LEFT JOIN ln USING (file, line)),
s2 AS (SELECT *, safe OR (NOT rewrite AND ((preprocessor AND safe_global) OR (comments AND NOT error) OR (context IN ('paired', 'header', 'source') AND error AND NOT macro AND n_decl = 0 AND n_ref = 0 AND structural))) AS pass FROM sm),
bad AS (SELECT file, policy, list_sort(list(DISTINCT line)) AS lines, first(soft) AS soft FROM s2 WHERE line > 0 AND before <> after AND NOT pass GROUP BY 1, 2)"""


def _guided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i, p, f = F.col("id"), F.col("policy"), F.col("file")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = _edits(spark, sf_dir).join(_lines(spark, sf_dir), ["file", "line"], "left").withColumns(
        {
            "safe": ~flag("unsafe") & (i % 6 != 0), "safe_global": i % 4 == 0, "error": flag("comment"), "macro": flag("macro"), "n_decl": i % 3, "n_ref": i % 2, "rewrite": p == "error",
            "structural": p.isin("click", "view"), "preprocessor": p == "view", "comments": p == "purchase", "soft": f % 2 == 0,
            "context": F.element_at(F.array(*map(F.lit, ("exact", "paired", "header", "source", "none"))), (f % 5 + 1).cast("int")),
        }
    )
    return op.semantic_mode(rows, ["file", "policy"])


@query(f"WITH {_SM} SELECT id FROM s2 LEFT JOIN bad USING (file, policy) WHERE lines IS NULL OR (s2.soft AND NOT list_contains(lines, line))")
def guided_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guided(spark, sf_dir)[0].select("id")


_HINT = "array_to_string(CASE WHEN len(lines) > 8 THEN list_append(list_transform(lines[:8], lambda x: x::VARCHAR), '+' || (len(lines) - 8)) ELSE list_transform(lines, lambda x: x::VARCHAR) END, ',')"


@query(
    f"""WITH {_SM} SELECT file, policy, CASE WHEN soft THEN NULL ELSE lines[1] END AS line,
    CASE WHEN soft THEN 'semantic guideline dropped ' || len(lines) || ' unsafe edit line(s) for ''' || policy || ''' (mode=soft_guideline, lines=' || {_HINT} || ')' ELSE 'semantic hard invariant blocked ''' || policy || ''' in unsafe region(s) (lines=' || {_HINT} || ')' END AS message FROM bad"""
)
def guidance_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guided(spark, sf_dir)[1]


_FD = "fd AS (SELECT c_custkey AS k, c_custkey % 4 AS n, c_custkey % 11 / 10.0::DOUBLE AS e0, c_custkey % 13 / 12.0::DOUBLE AS e1, c_custkey % 7 / 6.0::DOUBLE AS e2, c_custkey % 23 / 10.0::DOUBLE AS e3, c_custkey % 17 / 16.0::DOUBLE AS e4, c_custkey % 19 / 100.0::DOUBLE AS v0, c_custkey % 29 / 64.0::DOUBLE AS v1, c_custkey % 31 / 100.0::DOUBLE AS v3, c_custkey % 37 / 100.0::DOUBLE AS v4 FROM customer)"


@query(
    f"""WITH {_FD} SELECT k, round(CASE n WHEN 0 THEN 0 ELSE least(sqrt(v4), 0.3) END, 9) AS trust_deficit_penalty, round(CASE n WHEN 0 THEN 0 ELSE least(sqrt(v1), 0.3) END, 9) AS confidence_penalty, round(least(greatest(e3 * 2, 0.5), 3), 9) AS richness_multiplier,
    round(e4 * 12 / 17, 9) AS style_base, round(e4 * 8 / 17, 9) AS style_blank, round(e4 * 4 / 17, 9) AS style_delta, round(e0 * 2 / 17, 9) AS stabilizer_bonus_0, round(e0 / 17, 9) AS stabilizer_bonus_1, round(e2 * 0.16, 9) AS scope_bonus_0, round(e2 * 0.08, 9) AS scope_bonus_1,
    round(1 - e4, 9) AS risk_penalty_2, round((1 - e4) / 3, 9) AS risk_penalty_1, round(v3 / 5, 9) AS range_weight, round(v3 / 10, 9) AS symbol_weight, floor(least(greatest(e3 * 32, 8), 64))::INT AS component_threshold, floor(least(greatest(v1 * 30, 1), 8))::INT AS fuzzy_min_semantic,
    floor(least(greatest(v1 * 40, 1), 12))::INT AS identity_shift_tolerance, floor(least(greatest(e1 * 400, 50), 500))::INT AS confidence_bp_base, floor((e0 + e1) / 2 * 4.444444444444445 + 0.5)::INT AS diagnostic_warning, floor((e0 + e1) / 2 * 11.851851851851853 + 0.5)::INT AS diagnostic_error,
    floor((e0 + e1) / 2 * 17.77777777777778 + 0.5)::INT AS diagnostic_fatal, floor((e1 + e4) * 66.66666666666667 + 0.5)::INT AS identity_penalty, floor((e1 + e4) * 51.85185185185185 + 0.5)::INT AS reference_penalty, floor((e1 + e4) * 40.74074074074074 + 0.5)::INT AS usage_penalty,
    floor((e1 + e4) * 48.14814814814815 + 0.5)::INT AS orphan_penalty, floor((e1 + e4) * 59.25925925925926 + 0.5)::INT AS scope_penalty, round(e4 * 16 / 17, 9) AS cluster_relax_stability, round(e4 * 11 / 17, 9) AS cluster_harden_stability, round(e4 * 8 / 17, 9) AS cluster_cap1_stability,
    round(e4 * 6 / 17, 9) AS cluster_cap1_reliability, round(e4 * 12 / 17, 9) AS cluster_cap3_stability, round(sqrt(v4) * 0.805, 9) AS cluster_relax_uncertainty, round(sqrt(v4) * 1.966, 9) AS cluster_harden_uncertainty, round(sqrt(v4) * 0.983, 9) AS cluster_harden_revert_rate,
    round(sqrt(v4) * 1.5625, 9) AS cluster_cap3_uncertainty, floor(512 + 130560 / (1 + exp(-(10 / (sqrt(v0) + 0.05) * (e0 - 0.7)))))::INT AS retry_batch FROM fd"""
)
def filter_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    share = lambda m, by: k % m / float(by)
    found = op.filter_derivations([share(11, 10), share(13, 12), share(7, 6), share(23, 10), share(17, 16)], [share(19, 100), share(29, 64), F.lit(0.0), share(31, 100), share(37, 100)], k % 4)
    whole = {"component_threshold", "fuzzy_min_semantic", "identity_shift_tolerance", "confidence_bp_base", "retry_batch"}
    show = lambda n, c: c if n in whole or n.startswith("diagnostic_") or n in {f"{x}_penalty" for x in op.PENALTIES} else F.round(c, 9)
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("k"), *(show(n, c).alias(n) for n, c in found.items()))


_PR = """pr AS (SELECT o_orderkey AS k, ['strict', 'balanced', 'adaptive'][1 + (o_orderkey % 3)::INT] AS requested, ['strict', 'balanced', 'adaptive'][1 + (o_custkey % 3)::INT] AS stored_request, ['strict', 'balanced', 'adaptive', 'odd'][1 + (o_custkey % 4)::INT] AS stored,
  o_orderstatus <> 'P' AS wanted, o_orderkey % 5 <> 0 AS defer, o_custkey % 2 AS passes, o_orderkey % 7 = 0 AS armed FROM orders),
p2 AS (SELECT *, CASE WHEN stored_request <> requested OR stored = 'odd' THEN requested ELSE stored END AS profile FROM pr)"""


@query(f"WITH {_PR} SELECT k, profile, CASE WHEN NOT wanted THEN false WHEN NOT defer THEN true WHEN stored_request <> requested THEN false WHEN profile = 'strict' AND passes > 0 THEN true ELSE armed END AS fail_closed FROM p2")
def effective_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    three = ("strict", "balanced", "adaptive")
    args = (pick("o_orderkey", *three), pick("o_custkey", *three), pick("o_custkey", *three, "odd"))
    closed = op.effective_fail_closed(*args, F.col("o_orderstatus") != "P", F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 2, F.col("o_orderkey") % 7 == 0)
    return o.select(F.col("o_orderkey").alias("k"), op.effective_profile(*args).alias("profile"), closed.alias("fail_closed"))


@query(
    """SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN ['tree-sitter parser unavailable', 'clang parser unavailable', 'semantic readiness: parsers unavailable'] WHEN p_size % 3 = 0 THEN ['tree-sitter parser unavailable', 'semantic readiness: parsers unavailable']
    WHEN p_size % 4 = 0 THEN ['clang parser unavailable', 'semantic readiness: parsers unavailable'] ELSE [] END, '; ') AS reasons, p_size % 3 <> 0 AND p_size % 4 <> 0 AS ready FROM part"""
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = op.readiness(F.col("p_size") % 3 != 0, F.col("p_size") % 4 != 0)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("ready"))


_CX = """cx AS (SELECT l_suppkey AS file, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A' AND l_suppkey % 3 = 0)), []) AS a, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R' AND l_suppkey % 4 = 0)), []) AS b,
  count(*) FILTER (l_suppkey % 5 = 0) AS n_decl, count(*) FILTER (l_quantity > 25) AS n_ref FROM lineitem GROUP BY 1)"""
_NUMS = "array_to_string(list_transform({}[:8], lambda x: x::VARCHAR), ',')"


@query(
    f"""WITH {_CX} SELECT file, array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'semantic symbol identity invariants failed: issues=' || len(a) || ' lines=' || {_NUMS.format('a')} END, CASE WHEN len(b) > 0 THEN 'semantic usage-role consistency invariants failed: mismatches=' || len(b) || ' lines=' || {_NUMS.format('b')} END], lambda x: x IS NOT NULL), '; ') AS failures,
    CASE WHEN n_decl = 0 AND n_ref > 0 THEN 'semantic context warning: references=' || n_ref || ' but declarations=0' END AS warning, list_sort(list_distinct(list_concat(a, b))) AS culprits, len(a) + len(b) = 0 AS ready FROM cx"""
)
def context_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    lines = lambda flag, by: F.array_sort(F.collect_set(F.when((F.col("l_returnflag") == flag) & (F.col("l_suppkey") % by == 0), F.col("l_linenumber"))))
    rows = li.groupBy(F.col("l_suppkey").alias("file")).agg(lines("A", 3).alias("identity_lines"), lines("R", 4).alias("mismatch_lines"), F.count_if(F.col("l_suppkey") % 5 == 0).alias("n_decl"), F.count_if(F.col("l_quantity") > 25).alias("n_ref"))
    return op.context_assessment(rows).select("file", F.array_join("failures", "; ").alias("failures"), "warning", "culprits", "ready")


@query(
    """WITH m AS (SELECT user_id AS file, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (event_type = 'error') / count(*) END AS t, CASE WHEN user_id % 7 > 0 THEN count(*) FILTER (event_type = 'error') END AS e, CASE WHEN user_id % 7 > 0 THEN count(*) FILTER (event_type = 'view') END AS w,
      CASE WHEN user_id % 3 > 0 THEN count(*) END AS r, CASE WHEN user_id % 3 > 0 THEN count(*) FILTER (event_type = 'click') END AS s, CASE WHEN user_id % 3 > 0 THEN count(*) FILTER (event_type = 'purchase') END AS d FROM events GROUP BY user_id)
    SELECT file, round(coalesce(1 - t, 0.85), 9) AS structural, round(CASE WHEN e IS NULL THEN 0.5 ELSE 1 - least(e * 0.1 + w * 0.02, 1) END, 9)::DOUBLE AS semantic, round(CASE WHEN r IS NULL THEN 0.5 ELSE least(r / 50, 1) END, 9) AS coverage, round(CASE WHEN s IS NULL THEN 0.5 ELSE least((s + d) / 30, 1) END, 9) AS richness FROM m"""
)
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, u, t = table(spark, sf_dir, "events", "user_id", "event_type"), F.col("user_id"), F.col("event_type")
    n = lambda v: F.count_if(t == v)
    rows = ev.groupBy("user_id").agg(n("error").alias("e"), n("view").alias("w"), F.count("*").alias("r"), n("click").alias("s"), n("purchase").alias("d"))
    known = {"tree_error_ratio": (5, F.col("e") / F.col("r")), "n_errors": (7, F.col("e")), "n_warnings": (7, F.col("w")), "n_refs": (3, F.col("r")), "n_scopes": (3, F.col("s")), "n_decl": (3, F.col("d"))}
    rows = rows.select(u.alias("file"), *(F.when(u % by > 0, c).alias(k) for k, (by, c) in known.items()))
    return op.measurement(rows).select("file", *(F.round(c, 9).alias(c) for c in ("structural", "semantic", "coverage", "richness")))


@query("SELECT p_brand AS run, p_partkey AS place, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 10, p_partkey)::INT AS position FROM part")
def dynamic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").selectExpr("p_brand AS run", "p_partkey AS place", "p_size % 10 AS priority")
    return op.dynamic_order(rows).select("run", "place", "position")


@query("SELECT p_brand AS run, p_partkey AS place, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 10 - 3 DESC, p_partkey)::INT AS position FROM part WHERE p_size % 10 > 3 AND p_partkey % 3 <> 0")
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").selectExpr("p_brand AS run", "p_partkey AS place", "p_size % 10 - 3 AS weight", "p_partkey % 3 <> 0 AS whitespace_safe")
    return op.repair_candidates(rows).select("run", "place", "position")


@query("SELECT event_id, event_type <> 'error' AND value > 20 AND event_id % 9 <> 0 AS changed, CASE WHEN event_type <> 'error' AND value > 20 AND event_id % 9 <> 0 THEN event_type || event_id END AS pending_text FROM events")
def held_back_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "value").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN 'failed' END AS error", "value > 20 AS changed", "CASE WHEN event_id % 9 <> 0 THEN event_type || event_id END AS pending_text"
    )
    return op.held_back(rows).select("event_id", "changed", "pending_text")


@query("SELECT n_name AS policy, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_2' THEN 2 ELSE 3 END, n_name)::INT AS position FROM nation WHERE n_regionkey <> 1 AND (n_name IN ('NATION_7', 'NATION_2') OR NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey <> 1 AND n_name IN ('NATION_7', 'NATION_2')))")
def enabled_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = table(spark, sf_dir, "nation", "n_name", "n_regionkey").selectExpr("n_name AS policy", "n_regionkey <> 1 AS enabled")
    return op.enabled_policies(settings, ["NATION_7", "NATION_2"])


@query("SELECT DISTINCT event_type AS policy, false AS changed, event_type || ': skipped (unknown policy)' AS warning FROM events WHERE event_type NOT IN ('view', 'click')")
def stub_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stub_results(table(spark, sf_dir, "events", "event_type").select(F.col("event_type").alias("policy")).distinct(), ["view", "click"], "unknown policy")


@query("SELECT p_partkey AS key, 6 AS schema_version, CASE WHEN p_size % 9 <= 6 THEN p_retailprice END AS payload, CASE WHEN p_size % 9 > 6 THEN 'reset' WHEN p_size % 9 < 6 THEN 'raised' ELSE 'kept' END AS status FROM part")
def migrated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").selectExpr("p_partkey AS key", "p_size % 9 AS schema_version", "p_retailprice AS payload")
    return op.migrated(rows, 6)


@query()
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand as a configuration: its parts as settings, in order."""
    line = F.concat(F.lit("policy="), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(":"), "p_name")
    return fingerprint_by_key(table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name").select("p_brand", line.alias("line")), "p_brand", "line")
