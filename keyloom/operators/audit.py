"""The audit log of outcomes and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import PROVIDER_TITLES, record_id

ACTIONS = {"FIXED": "fixed", "REFUSED": "refused", "SKIPPED": "skipped", "FAILED": "failed"}


def audit_log(outcomes: DataFrame) -> DataFrame:
    """A record for each outcome that has a masked value; order with ``AUDIT_ORDER``."""
    kept = outcomes.filter(F.coalesce("masked", F.lit("")) != "")
    kind = F.when(F.col("rule_id") == "SEC001", "password").when(F.col("rule_id") == "SEC002", "api_key").otherwise("unknown")
    return kept.select(
        record_id(F.col("file"), F.col("line"), F.col("rule_id"), F.col("fingerprint")).alias("record_id"), "file", "line", "rule_id", kind.alias("secret_type"), F.coalesce("provider", F.lit("unknown")).alias("provider"),
        F.col("masked").alias("masked_value"), "fingerprint", F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("state")], F.lit("skipped")).alias("action"), "env_var", "reason",
    )


AUDIT_ORDER = ("file", "line", "rule_id", "fingerprint", "record_id")


def by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("records"), F.count_distinct("fingerprint").alias("secrets"))


def by_provider(log: DataFrame) -> DataFrame:
    title = F.create_map(*[F.lit(x) for kv in PROVIDER_TITLES.items() for x in kv])
    return log.groupBy("provider").agg(F.count("*").alias("records"), F.count_if(F.col("action") == "fixed").alias("fixed")).withColumn("title", F.coalesce(title[F.col("provider")], F.initcap("provider")))


def escaped(text: Column) -> Column:
    """For a Markdown table's cell; null as the empty text."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"([|`])", r"\\$1"), "\n\r", " ")


#: The heading of the log, its advice, what stands for no records, and the table's head.
HEADING, ROTATE, NOTHING = "# Remediation Audit Log", "If a secret was ever committed, assume it is compromised and rotate it.", "*No secrets found.*"
TABLE_HEAD = ("| ID | Timestamp | Action | Provider | Masked Value | Fingerprint | File | Line | Rule | Reason |", "|---|---|---|---|---|---|---|---:|---|---|")


def _shown_file() -> Column:
    return escaped(F.translate("file", "\\", "/"))


def markdown_rows(log: DataFrame, stamp: str = "") -> DataFrame:
    """Each record's row of the detailed table, with the columns that order it; ``stamp`` is the time of the log."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    cells = ["record_id", F.lit(stamp), "action", "provider", code(F.col("masked_value")), code(F.coalesce("fingerprint", F.lit(""))), code(_shown_file()), F.coalesce(F.col("line").cast("string"), F.lit("")), "rule_id", escaped(F.col("reason"))]
    return log.select(*AUDIT_ORDER, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def checklist_rows(log: DataFrame) -> DataFrame:
    """Each record's box of the rotation checklist, and the provider whose heading ``title`` it stands under."""
    titles = F.create_map(*[F.lit(x) for kv in PROVIDER_TITLES.items() for x in kv])
    title = F.concat(F.lit("### "), F.coalesce(titles[F.col("provider")], F.initcap("provider")))
    box = F.concat(F.lit("- [ ] `"), "masked_value", F.lit("` (`"), _shown_file(), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit("`) - "), "action", F.lit(" [`"), "record_id", F.lit("`]"))
    return log.select("provider", *AUDIT_ORDER, title.alias("title"), box.alias("row"))


def outcome_rows(outcomes: DataFrame, dry_run: bool = False) -> DataFrame:
    """``file, line, rule_id, rows``: what a report of fixes says of each outcome, plain, one line or three.

    A refusal that suggests a variable tells it and the line for ``.env.example``.
    """
    state = F.when((F.col("state") == "FIXED") & F.lit(dry_run), "WOULD_FIX").otherwise(F.col("state"))
    place = F.concat("file", F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    said = F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit("  - "), "message")).otherwise("")
    first = F.concat(F.lit("  "), F.format_string("%-10s %-8s ", state, "rule_id"), place, said)
    gap = F.lit(" " * 13)
    hints = F.array(F.concat(gap, F.lit("suggested_env_var: "), "env_var"), F.concat(gap, F.lit("Add to .env.example: "), "env_var", F.lit("=")))
    suggested = (F.coalesce("env_var", F.lit("")) != "") & (F.col("state") == "REFUSED")
    return outcomes.select("file", "line", "rule_id", F.when(suggested, F.concat(F.array(first), hints)).otherwise(F.array(first)).alias("rows"))


def outcome_summary(outcomes: DataFrame, dry_run: bool = False) -> DataFrame:
    """``summary``: one line that counts the states that occur, in their order."""
    counts = outcomes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ACTIONS])
    shown = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(" WOULD_FIX" if dry_run and s == "FIXED" else f" {s}"))) for s in ACTIONS]
    return counts.select(F.concat(F.lit("Summary: "), F.concat_ws(", ", *shown)).alias("summary"))


def report_counts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files scanned and skipped, findings, and those of high severity, in one row."""
    f = files.agg(F.count_if(~F.col("skipped")).alias("files_scanned"), F.count_if("skipped").alias("files_skipped"))
    i = findings.agg(F.count("*").alias("total_issues"), F.count_if(F.col("severity") == "high").alias("high_severity"), F.count_if((F.col("severity") == "high") & F.col("rule_id").isin("SEC001", "SEC002")).alias("fixable"))
    return f.join(i)  # one row each


def detect_summary(outcomes: DataFrame) -> DataFrame:
    """total, safe and refused, all that isn't safe; and how many rows give a refusal's reason."""
    safe = F.col("state") == "FIXED"
    return outcomes.agg(F.count("*").alias("total"), F.count_if(safe).alias("safe"), F.count_if(~safe).alias("refused"), F.count_if(F.col("state") == "REFUSED").alias("with_reason"))


def duplicate_clusters(findings: DataFrame, place: str = "file") -> DataFrame:
    """Secrets that stand in several places: ``fingerprint, findings, places``."""
    return findings.groupBy("fingerprint").agg(F.count("*").alias("findings"), F.count_distinct(place).alias("places")).filter("findings > 1")
