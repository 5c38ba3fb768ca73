"""Decisions on proposed edits: proposals, signals, biases, gates, profiles and what the certainty filter derives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gates import step_enforcement
from .ranking import numbered
from .reports import two_places
from .resolution import style_gain, zone

# Bits of the clauses that a proposal can touch.
AVAILABILITY, MACRO_REGION, EDIT_SAFETY = 1 << 0, 1 << 5, 1 << 7
# What the confidence of a signal gains or loses, in basis points.
SIGNAL = {"parsed": 200, "clean_tree": 150, "no_errors": 150, "error": 20, "usr": 100, "no_context": 100, "identity": 80, "scope": 60, "safety": 40}
# Factors of the filter's derivations, by the estimate (e) or deviation (sd) that they scale.
TRUST_CAP = 0.3
PENALTIES = {"identity": 66.66666666666667, "reference": 51.85185185185185, "usage": 40.74074074074074, "orphan": 48.14814814814815, "scope": 59.25925925925926}
CLUSTER_E4 = {
    "relax_stability": 0.9411764705882353, "harden_stability": 0.6470588235294118, "cap1_stability": 0.47058823529411764,
    "cap1_reliability": 0.35294117647058826, "cap3_stability": 0.7058823529411765,
}
CLUSTER_SD4 = {"relax_uncertainty": 0.805, "harden_uncertainty": 1.966, "harden_revert_rate": 0.983, "cap3_uncertainty": 1.5625}
DIAGNOSTICS = {"warning": 4.444444444444445, "error": 11.851851851851853, "fatal": 17.77777777777778}



def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def effective(edits: DataFrame) -> DataFrame:
    """Edits of a line that change something."""
    return edits.where((F.col("line") > 0) & (F.col("before") != F.col("after")))


def trust_penalty(sd: Column, n: Column) -> Column:
    """What a deviation takes from a confidence; nothing before the first observation."""
    return F.when(n == 0, 0.0).otherwise(F.least(sd, F.lit(TRUST_CAP)))


def richness(e3: Column) -> Column:
    return clamp(e3 * 2.0, 0.5, 3.0)


def propose(edits: DataFrame, lines: DataFrame, symbols: DataFrame, ranges: DataFrame, state: Column, confidence: float, signal_radius: int) -> DataFrame:
    """A candidate for every effective edit (id, file, line, before, after).

    ``lines``: file, line, macro, unsafe, comment; ``symbols``: file, line,
    symbol; ``ranges``: file, line, s, e; ``state``: a struct of n, sd1, sd4, e3
    and available for the edit's file. Lines that are not listed are safe code.
    """
    held = symbols.groupBy("file", "line").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    rows = effective(edits).withColumn("_x", state).join(lines, ["file", "line"], "left").join(held, ["file", "line"], "left").join(ranges, ["file", "line"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    mask = flag(F.col("macro")).cast("int") * MACRO_REGION + flag(F.col("unsafe")).cast("int") * EDIT_SAFETY + (~F.col("_x.available")).cast("int") * AVAILABILITY
    trust = trust_penalty(F.col("_x.sd1"), F.col("_x.n")) + trust_penalty(F.col("_x.sd4"), F.col("_x.n"))
    least = clamp(F.round(richness(F.col("_x.e3"))), 1.0, 3.0).cast("int")
    return rows.select(
        "id", "file", "line",
        clamp(F.lit(confidence) - trust, 0.0, 1.0).alias("confidence"),
        F.greatest(F.lit(max(1, signal_radius)), least).alias("radius"),
        mask.alias("mask"),
        zone(flag(F.col("macro")), flag(F.col("comment"))).alias("zone"),
        F.coalesce("symbols", F.array().cast(held.schema["symbols"].dataType)).alias("symbols"),
        F.coalesce("s", "line").alias("s"),
        F.coalesce("e", "line").alias("e"),
        style_gain(F.col("before"), F.col("after")).alias("gain"),
    )


def convergence_signal(rows: DataFrame) -> DataFrame:
    """confidence_bp and radius of rows: e1, parsed, tree_error, n_errors, n_usr, n_refs, failed (array of clauses), n_edits, cap; parsed is null without a context."""
    has = F.col("parsed").isNotNull()
    minus = lambda x, by: F.greatest(x - by, F.lit(0))
    bp = F.floor(clamp(F.col("e1") * 400.0, 50.0, 500.0)).cast("int")
    bp = F.when(has & F.col("parsed"), bp + SIGNAL["parsed"]).otherwise(bp)
    bp = F.when(has & ~F.col("tree_error"), bp + SIGNAL["clean_tree"]).otherwise(bp)
    errors = F.least(F.col("n_errors"), F.lit(10)).cast("int") * SIGNAL["error"]
    bp = F.when(has & (F.col("n_errors") == 0), bp + SIGNAL["no_errors"]).when(has, minus(bp, errors)).otherwise(bp)
    bp = F.when(has & (F.col("n_usr") > 0), bp + SIGNAL["usr"]).when(~has, minus(bp, SIGNAL["no_context"])).otherwise(bp)
    failed = lambda *names: F.arrays_overlap("failed", F.array(*map(F.lit, names)))
    identity, scope = failed("symbol_identity", "declaration_reference_integrity"), failed("scope_integrity")
    for test, loss in ((identity, "identity"), (scope, "scope"), (failed("edit_safety"), "safety")):
        bp = F.when(test, minus(bp, SIGNAL[loss])).otherwise(bp)
    refs = F.when(~has, 0).when(F.col("n_refs") > 2000, 3).when(F.col("n_refs") > 500, 2).otherwise(1)
    edits = F.when(F.col("n_edits") > 40, 3).when(F.col("n_edits") > 10, 2).otherwise(1)
    radius = F.least(F.greatest(refs, edits, F.when(identity | scope, 2).otherwise(0)), F.lit(8))
    capped = F.when(F.col("cap").isNull(), radius).otherwise(F.least(radius, F.greatest(F.col("cap").cast("int"), F.lit(1))))
    return rows.withColumns({"confidence_bp": F.least(bp, F.lit(1000)), "radius": capped})


def cluster_bias(rows: DataFrame) -> DataFrame:
    """Decisions (outcome, base, effective, reasons) after a cluster's ``bias``: Neutral, Relax or Harden."""
    relax, harden = F.col("bias") == "Relax", F.col("bias") == "Harden"
    outcome = F.when(relax & (F.col("base") != "Must") & (F.col("outcome") == "Block"), "Apply").otherwise(F.col("outcome"))
    level = F.when(relax, step_enforcement(F.col("effective"), False)).when(harden, step_enforcement(F.col("effective"), True)).otherwise(F.col("effective"))
    added = F.when(relax, F.array(F.lit("ClusterAdaptiveRelaxed"))).when(harden, F.array(F.lit("ClusterAdaptiveHardened"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"outcome": outcome, "effective": level, "reasons": F.concat("reasons", F.array_except(added, "reasons"))})


def apply_decisions(edits: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edits that a decision leaves, and its message (violation) by ``keys``.

    ``decisions``: keys, outcome (Apply, ApplyPartial, Block), base, effective,
    score, threshold, reasons and dropped (lines). Apply speaks only if the
    enforcement was changed. The message stands on the first edit's line.
    """
    kept = edits.join(decisions.select(*keys, "outcome", "dropped"), keys).where(
        (F.col("outcome") == "Apply") | ((F.col("outcome") == "ApplyPartial") & ~F.array_contains("dropped", F.col("line")))
    )
    first = edits.groupBy(*keys).agg(F.min_by("line", "id").alias("first"))
    why = F.when(F.size("reasons") == 0, "stable").otherwise(F.array_join("reasons", ","))
    policy, score, threshold = F.col("policy"), two_places(F.col("score")), two_places(F.col("threshold"))
    said = (
        F.when((F.col("outcome") == "Apply") & (F.col("base") != F.col("effective")), F.format_string("Adaptive tier for '%s': %s->%s (%s)", policy, "base", "effective", why))
        .when(F.col("outcome") == "ApplyPartial", F.format_string("Adaptive partial apply for '%s' (dropped_lines=%d, score=%s, threshold=%s, reasons=%s)", policy, F.size("dropped"), score, threshold, why))
        .when(F.col("outcome") == "Block", F.format_string("Adaptive decision blocked for '%s' (score=%s, threshold=%s, effective=%s, reasons=%s)", policy, score, threshold, "effective", why))
    )
    messages = decisions.join(first, keys, "left").select(*keys, F.coalesce("first", F.lit(1)).alias("line"), said.alias("message")).where("message IS NOT NULL")
    return kept.drop("outcome", "dropped"), messages


def safe_edit(rows: DataFrame) -> Column:
    """Whether semantic guidance lets an edit's line pass.

    Columns: safe, safe_global, error, macro, n_decl, n_ref of the line; rewrite,
    structural, preprocessor and comments of the policy; context kind of the file.
    """
    inferred = F.col("context").isin("paired", "header", "source")
    relaxed = inferred & F.col("error") & ~F.col("macro") & (F.col("n_decl") == 0) & (F.col("n_ref") == 0) & F.col("structural")
    return F.col("safe") | (~F.col("rewrite") & ((F.col("preprocessor") & F.col("safe_global")) | (F.col("comments") & ~F.col("error")) | relaxed))


def hint(lines: Column, most: int = 8) -> Column:
    """The first lines of an ordered array, then how many more there are."""
    more = F.size(lines) - most
    shown = F.transform(F.slice(lines, 1, most), lambda x: x.cast("string"))
    return F.array_join(F.when(more > 0, F.concat(shown, F.array(F.concat(F.lit("+"), more.cast("string"))))).otherwise(shown), ",")


def semantic_mode(edits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edits that guidance leaves, and its message by ``keys``.

    In ``soft`` mode edits on unsafe lines are dropped with a warning; otherwise
    one unsafe line blocks all edits of the result with a violation.
    """
    bad = edits.where((F.col("line") > 0) & (F.col("before") != F.col("after")) & ~safe_edit(edits))
    held = bad.groupBy(*keys).agg(F.array_sort(F.collect_set("line")).alias("lines"), F.first("soft").alias("soft"))
    marked = edits.join(held.select(*keys, "lines"), keys, "left")
    kept = marked.where(F.col("lines").isNull() | (F.col("soft") & ~F.array_contains("lines", F.col("line")))).drop("lines")
    said = F.when(
        F.col("soft"), F.format_string("semantic guideline dropped %d unsafe edit line(s) for '%s' (mode=soft_guideline, lines=%s)", F.size("lines"), F.col("policy"), hint(F.col("lines")))
    ).otherwise(F.format_string("semantic hard invariant blocked '%s' in unsafe region(s) (lines=%s)", F.col("policy"), hint(F.col("lines"))))
    return kept, held.select(*keys, F.when(F.col("soft"), F.lit(None).cast("int")).otherwise(F.element_at("lines", 1)).alias("line"), said.alias("message"))


def filter_derivations(e: list[Column], v: list[Column], n: Column) -> dict[str, Column]:
    """What the five-dimensional filter's estimates ``e`` and variances ``v`` after ``n`` observations mean to the others."""
    sd0, sd1, sd4 = (F.sqrt(v[i]) for i in (0, 1, 4))
    whole = lambda x: F.floor(x).cast("int")
    near = lambda x: F.round(x).cast("int")
    both, mean = e[1] + e[4], (e[0] + e[1]) / 2.0
    out = {
        "trust_deficit_penalty": trust_penalty(sd4, n), "confidence_penalty": trust_penalty(sd1, n), "richness_multiplier": richness(e[3]),
        "style_base": e[4] * 0.7058823529411765, "style_blank": e[4] * 0.47058823529411764, "style_delta": e[4] * 0.23529411764705882,
        "stabilizer_bonus_0": e[0] * 0.11764705882352941, "stabilizer_bonus_1": e[0] * 0.058823529411764705,
        "scope_bonus_0": e[2] * 0.16, "scope_bonus_1": e[2] * 0.08, "risk_penalty_2": 1.0 - e[4], "risk_penalty_1": (1.0 - e[4]) * 0.3333333333333333,
        "range_weight": v[3] * 0.2, "symbol_weight": v[3] * 0.1, "component_threshold": whole(clamp(e[3] * 32.0, 8.0, 64.0)),
        "fuzzy_min_semantic": whole(clamp(v[1] * 30.0, 1.0, 8.0)), "identity_shift_tolerance": whole(clamp(v[1] * 40.0, 1.0, 12.0)),
        "confidence_bp_base": whole(clamp(e[1] * 400.0, 50.0, 500.0)),
    }
    out |= {f"diagnostic_{k}": near(mean * x) for k, x in DIAGNOSTICS.items()}
    out |= {f"{k}_penalty": near(both * x) for k, x in PENALTIES.items()}
    out |= {f"cluster_{k}": e[4] * x for k, x in CLUSTER_E4.items()} | {f"cluster_{k}": sd4 * x for k, x in CLUSTER_SD4.items()}
    steep = 10.0 / (sd0 + 0.05)
    out["retry_batch"] = whole(512.0 + (131072.0 - 512.0) / (1.0 + F.exp(-(steep * (e[0] - 0.7)))))
    return out


def effective_profile(requested: Column, stored_request: Column, stored: Column) -> Column:
    """The rollout's profile, as long as the request is the one that it was reached under."""
    known = stored.isin("strict", "balanced", "adaptive")
    return F.when(stored_request != requested, requested).when(known, stored).otherwise(requested)


def effective_fail_closed(requested: Column, stored_request: Column, stored: Column, wanted: Column, defer: Column, passes: Column, armed: Column) -> Column:
    """Whether a failing gate stops the run: at once, or when deferred only once the rollout is armed or strict with a pass."""
    active = effective_profile(requested, stored_request, stored)
    return F.when(~wanted, False).when(~defer, True).when(stored_request != requested, False).when((active == "strict") & (passes > 0), True).otherwise(armed)


def readiness(tree: Column, parser: Column) -> Column:
    """Reasons that stand against reading a file semantically; none: it is ready."""
    reasons = F.array_compact(F.array(F.when(~tree, "tree-sitter parser unavailable"), F.when(~parser, "clang parser unavailable")))
    return F.when(F.size(reasons) > 0, F.concat(reasons, F.array(F.lit("semantic readiness: parsers unavailable")))).otherwise(reasons)


def context_assessment(rows: DataFrame) -> DataFrame:
    """failures, warnings, culprits and ready of rows: identity_lines, mismatch_lines (ordered arrays), n_decl, n_ref."""
    identity, mismatch = F.col("identity_lines"), F.col("mismatch_lines")
    short = lambda a: F.array_join(F.transform(F.slice(a, 1, 8), lambda x: x.cast("string")), ",")
    failures = F.array_compact(
        F.array(
            F.when(F.size(identity) > 0, F.format_string("semantic symbol identity invariants failed: issues=%d lines=%s", F.size(identity), short(identity))),
            F.when(F.size(mismatch) > 0, F.format_string("semantic usage-role consistency invariants failed: mismatches=%d lines=%s", F.size(mismatch), short(mismatch))),
        )
    )
    lone = (F.col("n_decl") == 0) & (F.col("n_ref") > 0)
    warning = F.when(lone, F.format_string("semantic context warning: references=%d but declarations=0", "n_ref"))
    return rows.withColumns({"failures": failures, "warning": warning, "culprits": F.array_sort(F.array_union(identity, mismatch)), "ready": F.size(failures) == 0})


def measurement(rows: DataFrame) -> DataFrame:
    """The filter's five observations of rows: tree_error_ratio, n_errors, n_warnings, n_refs, n_scopes, n_decl (null where unknown), acceptance."""
    known = lambda c, x, default: F.when(F.col(c).isNull(), default).otherwise(x)
    semantic = 1.0 - F.least(F.col("n_errors") * 0.1 + F.col("n_warnings") * 0.02, F.lit(1.0))
    return rows.withColumns(
        {
            "structural": known("tree_error_ratio", 1.0 - F.col("tree_error_ratio"), 0.85),
            "semantic": known("n_errors", semantic, 0.5),
            "coverage": known("n_refs", F.least(F.col("n_refs") / 50.0, F.lit(1.0)), 0.5),
            "richness": known("n_scopes", F.least((F.col("n_scopes") + F.col("n_decl")) / 30.0, F.lit(1.0)), 0.5),
        }
    )


def dynamic_order(rows: DataFrame) -> DataFrame:
    """Policies (run, place, priority) in the order of their dynamic priority within the run, then of their place: with ``position`` from 1."""
    return numbered(rows, ["run"], ["priority", "place"])


def repair_candidates(rows: DataFrame) -> DataFrame:
    """Whitespace-safe policies of a run with a repair weight above 0, the heaviest first, then by place: with ``position`` from 1."""
    return numbered(rows.where(F.col("whitespace_safe") & (F.col("weight") > 0)), ["run"], [F.desc("weight"), "place"])


def held_back(results: DataFrame) -> DataFrame:
    """Results with what the write phase leaves of changed and pending_text: rows with an error, or without a change or a text, write nothing."""
    writes = F.col("error").isNull() & F.col("changed") & F.col("pending_text").isNotNull()
    return results.withColumns({"pending_text": F.when(writes, F.col("pending_text")), "changed": writes})


def enabled_policies(settings: DataFrame, explicit: Iterable[str]) -> DataFrame:
    """Enabled policies (policy, enabled) in the explicit order; by name if that leaves none."""
    order = list(dict.fromkeys(explicit))
    on = settings.where("enabled")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("policy")) if order else F.lit(0).cast("bigint")
    listed = on.withColumn("_p", place).where("_p > 0")
    w = Window.orderBy("_p", "policy")  # one row a policy, so this is a handful of rows
    if listed.isEmpty():
        listed = on.withColumn("_p", F.lit(0).cast("bigint"))
    return listed.select("policy", F.row_number().over(w).alias("position"))


def stub_results(policies: DataFrame, known: Iterable[str], reason: str) -> DataFrame:
    """What stands in for policies that don't exist: unchanged, with a warning."""
    missing = policies.where(~F.col("policy").isin(*known))
    return missing.withColumns({"changed": F.lit(False), "warning": F.format_string("%s: skipped (%s)", F.col("policy"), F.lit(reason))})


def migrated(states: DataFrame, version: int) -> DataFrame:
    """Stored states as this version reads them: older ones are raised, later ones start empty."""
    later = F.col("schema_version") > version
    out = {c: F.when(~later, F.col(c)) for c in states.columns if c not in ("key", "schema_version")}
    return states.withColumns(out | {"schema_version": F.lit(version), "status": F.when(later, "reset").when(F.col("schema_version") < version, "raised").otherwise("kept")})


def fingerprint_lines(lines: Column) -> Column:
    """A checksum of configuration lines in one list: crc32 and length, in hexadecimal. ``joins.fingerprint_by_key`` takes lists of any length."""
    text = F.array_join(lines, "\n").cast("binary")
    return F.concat(F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0"), F.lit("-"), F.lower(F.hex(F.octet_length(text).cast("bigint"))))
