"""The policy: gates, decision and trace of a finding, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICY_VERSION = "2026-04-22.1"
ENGINE_VERSION = "1"

# The confidence that lets a password be rewritten, and the review band below it.
THRESHOLD, BAND = 0.94, 0.90

# Gates in order, with what is said if they pass and if they don't.
GATES = ("parse_valid", "category_policy", "confidence_threshold", "env_contract_present", "single_literal_replacement", "override_valid")


def default_confidence(rule: Column, pattern_type: Column) -> Column:
    first = F.when(pattern_type == "passwd", 0.93).otherwise(0.95)
    second = F.when(pattern_type == "api_key", 0.88).otherwise(0.87)
    return F.when(rule == "SEC001", first).when(rule == "SEC002", second).otherwise(0.80)


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def _gate(name: str, passed: Column, evidence: Column | str, expected: Column | None = None, actual: Column | None = None) -> Column:
    text = F.lit(evidence) if isinstance(evidence, str) else evidence
    null = F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("gate"), passed.alias("passed"), text.alias("evidence"), (null if expected is None else expected).alias("expected"), (null if actual is None else actual).alias("actual"))


# The texts of the gates, rationales and actions in the functions below. Two actions are reworded to name no product.


def gate_results(i: Column) -> Column:
    """Six gates in order, or the first alone if the file doesn't parse. i: a struct of the policy's inputs."""
    rule, one, two = i.rule_id, i.rule_id == "SEC001", i.rule_id == "SEC002"
    threshold = F.when(one, THRESHOLD).otherwise(0.0)
    sure = i.confidence >= threshold
    first = _gate("parse_valid", i.parse_valid, F.when(i.parse_valid, "File was successfully parsed prior to reaching this finding.").otherwise("File could not be parsed by the AST engine."))
    rest = [
        _gate("category_policy", one | two, F.when(one, F.concat(rule, F.lit(": qualifies for deterministic env replacement."))).when(two, F.concat(rule, F.lit(": in scope for detection and preview; not auto-applied in policy v1."))).otherwise(F.concat(rule, F.lit(": outside remediation scope.")))),
        _gate("confidence_threshold", sure, F.concat(F.lit("confidence "), _two(i.confidence), F.when(sure, " ≥").otherwise(" <"), F.lit(" threshold "), _two(threshold)), F.concat(F.lit(">="), _two(threshold)), _two(i.confidence)),
        _gate("env_contract_present", i.env_contract_exists, F.when(i.env_contract_exists, "Env contract file (.env.example or equivalent) found in repo.").otherwise("No env contract file found; cannot derive safe destination variable.")),
        _gate("single_literal_replacement", i.single_literal_replacement, F.when(i.single_literal_replacement, "Fix replaces exactly one simple string literal (deterministic rewrite).").otherwise("Fix involves a complex expression (f-string, concatenation, or multi-step); single literal replacement not guaranteed.")),
        _gate("override_valid", i.override_present, "No override token present. Override evaluation stubbed in policy v1."),
    ]
    return F.when(i.parse_valid, F.array(first, *rest)).otherwise(F.array(first))


def final_action(i: Column) -> Column:
    one, two = i.rule_id == "SEC001", i.rule_id == "SEC002"
    blocked = ~i.parse_valid | (two & ~i.env_contract_exists & ~i.dry_run)
    applied = one & (i.confidence >= THRESHOLD) & i.env_contract_exists & i.single_literal_replacement
    return F.when(blocked, "block_with_reason").when(applied, "preview_then_apply").otherwise("preview_only")


def rationale(i: Column) -> Column:
    one, two = i.rule_id == "SEC001", i.rule_id == "SEC002"
    threshold = F.when(one, THRESHOLD).otherwise(0.0)
    sure, c = i.confidence >= threshold, _two(i.confidence)
    return (
        F.when(~i.parse_valid, "Parse failed, so safe structural rewrite cannot be proven.")
        .when(two & ~i.env_contract_exists & ~i.dry_run, "Secret detected, but no safe destination contract exists for remediation.")
        .when(one & sure & i.env_contract_exists & i.single_literal_replacement, "High-confidence SEC001 with deterministic env replacement, single literal rewrite, and valid destination contract.")
        .when(two & i.env_contract_exists, "SEC002 findings qualify for preview only, not auto-apply, in policy v1.")
        .when(~sure & (i.confidence >= BAND), F.concat(F.lit("Confidence "), c, F.lit(" is in the near-threshold review band (0.90–"), _two(threshold), F.lit("); auto-apply requires confidence ≥ "), _two(threshold), F.lit(".")))
        .when(~sure, F.concat(F.lit("Confidence "), c, F.lit(" is below the "), _two(threshold), F.lit(" auto-apply threshold; review manually or adjust the confidence threshold.")))
        .when(~i.env_contract_exists, "Env contract absent; finding is visible but cannot be automatically remediated.")
        .when(~i.single_literal_replacement, "SEC001 requires a single literal replacement for auto-apply; this finding involves a complex expression and cannot be deterministically rewritten.")
        .otherwise(F.concat(i.rule_id, F.lit(" does not satisfy all conditions for auto-apply in policy v1.")))
    )


def unblocking_action(i: Column) -> Column:
    one = i.rule_id == "SEC001"
    return F.when(final_action(i) != "preview_then_apply",
        F.when(~i.parse_valid, "Fix syntax errors so that the file can be parsed safely.")
        .when(~i.env_contract_exists & (i.rule_id == "SEC002"), "Define the API key destination in .env.example: add an entry with the variable name, scope, and load path.")
        .when(~i.env_contract_exists, "Declare the env variable destination in .env.example (e.g., PASSWORD=).")
        .when(one & ~i.single_literal_replacement, "Refactor the assignment to a single string literal so that it can be rewritten safely.")
        .when(one & (i.confidence >= BAND) & (i.confidence < THRESHOLD) & i.interactive_ci, "Request reviewer override token to proceed with auto-apply.")
        .when(one & (i.confidence >= BAND) & (i.confidence < THRESHOLD), "Keep preview_only or raise confidence via stronger signal before enabling auto-apply.")
        .when(i.confidence < THRESHOLD, "Review manually or lower the confidence threshold."))


def with_decisions(findings: DataFrame, env_contract: Column | bool = True, dry_run: bool = True, parse_valid: Column | bool = True, single_literal: Column | bool | None = None, interactive_ci: bool = False) -> DataFrame:
    """``findings`` with ``trace``: inputs, gates, action, rationale, the smallest step that unblocks, versions.

    Without ``single_literal``, a finding that has a value is one literal and an
    f-string, which has none, is not.
    """
    col = lambda x: F.lit(x) if isinstance(x, bool) else x
    single = F.col("provider") != "unknown" if single_literal is None else col(single_literal)
    inputs = F.struct(
        F.col("file"), F.col("line"), F.col("rule_id"), F.col("pattern_type").alias("pattern"), default_confidence(F.col("rule_id"), F.col("pattern_type")).alias("confidence"), col(parse_valid).alias("parse_valid"),
        col(env_contract).alias("env_contract_exists"), F.regexp_extract("file", r"(\.[^.]*)$", 1).alias("file_type"), F.coalesce(single, F.lit(False)).alias("single_literal_replacement"),
        F.lit(False).alias("override_present"), F.lit(interactive_ci).alias("interactive_ci"), F.lit(dry_run).alias("dry_run"),
    )
    out = findings.withColumn("inputs", inputs)
    i = F.col("inputs")
    audit = F.struct(F.lit(POLICY_VERSION).alias("policy_version"), F.lit(ENGINE_VERSION).alias("engine_version"))
    trace = F.struct(i.alias("inputs"), gate_results(i).alias("gate_results"), final_action(i).alias("final_action"), rationale(i).alias("rationale"), unblocking_action(i).alias("smallest_unblocking_action"), audit.alias("audit"))
    return out.withColumn("trace", trace).drop("inputs")


def routed(decided: DataFrame) -> DataFrame:
    """``state, reason`` of each finding before the rewriter: REFUSED, SKIPPED, or TO_FIX."""
    action = F.col("trace.final_action")
    state = (
        F.when(action == "block_with_reason", F.struct(F.lit("REFUSED").alias("state"), F.lit("policy_block").alias("reason")))
        .when(~F.col("rule_id").isin("SEC001", "SEC002"), F.struct(F.lit("SKIPPED").alias("state"), F.lit("issue_type_not_supported").alias("reason")))
        .when(F.lower("severity") != "high", F.struct(F.lit("SKIPPED").alias("state"), F.lit("severity_not_high").alias("reason")))
        .when(action != "preview_then_apply", F.struct(F.lit("REFUSED").alias("state"), F.lit("preview_only").alias("reason")))
        .otherwise(F.struct(F.lit("TO_FIX").alias("state"), F.lit(None).cast("string").alias("reason")))
    )
    return decided.withColumn("route", state).select("*", "route.state", "route.reason").drop("route")


def exit_code(mode: str, findings: Column, fixed: Column, fixable: Column, failed: Column) -> Column:
    """0, 1, 2 or 3 of a run, by its mode: scan and history, fix, ci, pre-commit."""
    some = {"scan": findings > 0, "history": findings > 0, "fix": fixed > 0, "pre-commit": findings > 0}
    if mode == "ci":
        return F.when(failed, 3).when(fixable > 0, 1).when(findings > 0, 2).otherwise(0)
    out = F.when(some[mode], 1).otherwise(0)
    return out if mode == "pre-commit" else F.when(failed, 3).otherwise(out)
