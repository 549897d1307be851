"""Scan, decide, rewrite, account: the fix of a table of files. Nothing is rewritten that the policy doesn't approve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detect, policy, pytree, rewrite
from .rules import DEFAULT_EXTENSIONS, MAX_CHARS

KEY = ("file", "line", "rule_id")


def scan(files: DataFrame, allowed: tuple[str, ...] = DEFAULT_EXTENSIONS, most: int = MAX_CHARS) -> DataFrame:
    """Findings of ``files(file, content)`` by rules and syntax trees; where Python doesn't parse, PARSE_ERROR alone."""
    tree = pytree.ast_findings(files, strict=True)
    both = detect.merged(detect.regex_findings(files, allowed, most=most), tree)
    broken = tree.filter(F.col("rule_id") == "PARSE_ERROR").select("file").distinct()
    return both.join(broken.withColumn("broken", F.lit(True)), "file", "left").filter(F.col("broken").isNull() | (F.col("rule_id") == "PARSE_ERROR")).drop("broken")


def decided(findings: DataFrame, env_contract: Column | bool = True, dry_run: bool = False) -> DataFrame:
    """Findings with their trace and route."""
    return policy.routed(policy.with_decisions(findings, env_contract, dry_run, F.col("rule_id") != "PARSE_ERROR"))


def fix(files: DataFrame, findings: DataFrame, env_contract: Column | bool = True, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, rewrites)`` of findings.

    outcomes: the findings with state (FIXED, REFUSED, SKIPPED), reason,
    env_var, final_action and rationale. rewrites: ``rewritten`` files, pure;
    only findings that are TO_FIX reach the rewriter. Other findings of a file
    don't keep it from being rewritten. ``dry_run`` changes decisions, not
    rewrites: whether they are written is up to the caller.
    """
    routes = decided(findings, env_contract, dry_run)
    rewrites = rewrite.rewritten(files, routes.filter("state = 'TO_FIX'").select(*KEY))
    told = rewrites.select("file", F.explode("outcomes").alias("o")).select("file", F.col("o.line").alias("line"), F.col("o.rule_id").alias("rule_id"), F.struct("o.outcome", "o.reason", "o.env_var").alias("o"))
    out = routes.join(told.groupBy(*KEY).agg(F.first("o").alias("o")), list(KEY), "left")
    todo = F.col("state") == "TO_FIX"
    state = F.when(todo, F.coalesce("o.outcome", F.lit("REFUSED"))).otherwise(F.col("state"))
    reason = F.when(todo, F.when(F.col("o").isNull(), "refuse_unsupported_language").otherwise(F.col("o.reason"))).otherwise(F.col("reason"))
    rows = out.select(*findings.columns, state.alias("state"), reason.alias("reason"), F.col("o.env_var").alias("env_var"), F.col("trace.final_action").alias("final_action"), F.col("trace.rationale").alias("rationale"))
    return rows, rewrites


def run_report(mode: str, files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: files, findings, high and fixable ones, outcomes by state, and the exit code of ``mode``."""
    scanned = files.agg(F.count("*").alias("files"))
    high = F.col("severity") == "high"
    counts = outcomes.agg(
        F.count("*").alias("findings"), F.count_if(high).alias("high"), F.count_if(high & F.col("rule_id").isin("SEC001", "SEC002")).alias("fixable"), F.count_if(F.col("rule_id") == "PARSE_ERROR").alias("parse_errors"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("FIXED", "REFUSED", "SKIPPED", "FAILED")],
    )
    out = scanned.join(counts)  # one row each
    return out.withColumn("exit_code", policy.exit_code(mode, F.col("findings"), F.col("fixed"), F.col("fixable"), F.lit(False)))


def rules_seen(findings: DataFrame) -> DataFrame:
    """``rule_id, message, findings, files``: what a report's rules block has, one row for each rule that was met."""
    return findings.groupBy("rule_id").agg(F.min("message").alias("message"), F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


def merged_by_place(first: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``first``, and those of ``more`` whose (file, line, col, rule) it lacks, one of each."""
    key = ["file", "line", "col", "rule_id"]
    return first.unionByName(more.dropDuplicates(key).join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def count_changes(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("repo", "rule_id")) -> DataFrame:
    """``by..., before, after, change``: findings of two runs, counted in one pass."""
    rows = before.select(*by, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*by, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.groupBy(*by).agg(F.sum("b").alias("before"), F.sum("a").alias("after")).withColumn("change", F.col("after") - F.col("before"))
