"""CSV, JSON and rule tables in, reports out."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a table for review.
REVIEW_COLUMNS = ("finding_id", "repo", "file", "line", "rule_id", "matched_preview", "surrounding_context", "synthetic", "human_label", "category", "review_notes", "reviewer", "review_timestamp", "labeling_pass_id")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All-string rows; quoted fields may hold commas, quotes and newlines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(", ".join(f"`{c}` string" for c in columns)) if columns else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_findings(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """Findings of a JSON document: under findings, results or items, or a bare list; the repo defaults to the file's stem."""
    raw = spark.read.option("multiLine", True).json(path)
    keys = [k for k in ("findings", "results", "items") if k in raw.columns]
    rows = raw.select(F.explode(F.coalesce(*[F.col(k) for k in keys])).alias("f")).select("f.*") if keys else raw
    name = repo or re.sub(r"\.json$", "", os.path.basename(path))
    return rows.withColumn("repo", F.coalesce(F.col("repo"), F.lit(name)) if "repo" in rows.columns else F.lit(name))


def _listed(value: str) -> list[str]:
    """``[a, "b"]`` or ``a`` as a list."""
    return [v for x in value.strip("[]").split(",") if (v := x.strip().strip("'\""))]


def custom_rules(text: str) -> list[dict]:
    """Rules of a small YAML list (id, pattern, severity, message, include, exclude); those without id or a pattern that compiles are left out."""
    out: list[dict] = []
    for line in text.splitlines():
        if m := re.match(r"\s*-\s+(\w+):\s*(.*)$", line):
            out.append({m[1]: m[2].strip().strip("'\"")})
        elif out and (m := re.match(r"\s+(\w+):\s*(.*)$", line)):
            out[-1][m[1]] = m[2].strip().strip("'\"")
    good = []
    for r in out:
        try:
            re.compile(r["pattern"])
        except (KeyError, re.error):
            continue
        if r.get("id"):
            good.append({"id": r["id"], "pattern": r["pattern"], "severity": r.get("severity", "MEDIUM").upper(), "message": r.get("message", ""), "include": _listed(r.get("include", "")), "exclude": _listed(r.get("exclude", ""))})
    return good


def _fits(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", fnmatch.translate(g)))
    return out


def custom_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Every match of every custom rule in files that fit its globs, but for those after a comment sign: ``file, rule_id, severity, line``.

    Lines are summed up in one pass over a file's matches.
    """
    path = F.regexp_replace("file", r"\\", "/")
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    sign = F.when(path.endswith(".py"), "#").when(path.rlike(r"\.(?:js|ts|jsx|tsx)$"), "//")
    start = F.struct(F.lit(1).alias("line"), F.lit("").alias("before"), F.array().cast("array<int>").alias("out"))

    def lines(pattern: str) -> Column:
        def step(a: Column, x: Column) -> Column:
            line, gap = a["line"] + newlines(x["gap"]), x["gap"]
            prefix = F.when(gap.contains("\n"), F.substring_index(gap, "\n", -1)).otherwise(F.concat(a["before"], gap))
            noted = F.coalesce(prefix.contains(sign), F.lit(False))
            after = F.concat(prefix, x["hit"])
            return F.struct((line + newlines(x["hit"])).alias("line"), F.substring_index(after, "\n", -1).alias("before"), F.when(noted, a["out"]).otherwise(F.concat(a["out"], F.array(line))).alias("out"))

        both = F.zip_with(F.split("content", pattern), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(F.filter(both, lambda x: x["hit"].isNotNull()), start, step, lambda a: a["out"])

    out = None
    for r in rules:
        wanted = F.col("content").rlike(r["pattern"]) & _fits(path, r.get("include") or ["*"]) & ~_fits(path, r.get("exclude") or [])
        rows = files.filter(wanted).select("file", F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.explode(lines(r["pattern"])).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.write.json(path)


def history_text(findings: DataFrame) -> DataFrame:
    """A text block for each finding of a history, with the columns that order them."""
    block = F.format_string("Commit: %s (Date: %s)\nFile:   %s:%s\nSecret: %s (%s)\nStatus: present in history\n", F.substring("commit_hash", 1, 7), "author_date", "file", F.col("line_number").cast("string"), "rule_id", "message")
    return findings.select("repo", "commit_hash", "file", "line_number", "rule_id", block.alias("block"))


def envelope(summary: dict, findings: DataFrame) -> str:
    """One JSON document of a report; findings stream to the driver in order, null keys left out."""
    rows = findings.orderBy("file", "line", "rule_id").select(F.to_json(F.struct(*findings.columns)).alias("j")).toLocalIterator()
    return json.dumps({"summary": summary, "findings": [json.loads(r.j) for r in rows]}, sort_keys=True)


def text_report(findings: DataFrame) -> DataFrame:
    """Fixed-width lines of a report, with the columns that order them."""
    return findings.select("file", "line", "rule_id", F.format_string("%-10s %-8s %-40s %-6s %s", "rule_id", F.upper("severity"), "file", F.col("line").cast("string"), F.coalesce("masked", F.lit(""))).alias("row"))


def write_atomic(text: str, path: str) -> None:
    """Replace a file on the driver at once, or leave it as it was."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".tmp-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def apply_fixes(rewritten: DataFrame, root: str) -> int:
    """Write fixed files in place with a ``.bak`` beside each; on the driver, once, after all is decided."""
    n = 0
    for r in rewritten.filter("any_fixed").select("file", "fixed_code").toLocalIterator():
        path = os.path.join(root, r.file)
        with open(path, encoding="utf-8") as f:
            write_atomic(f.read(), path + ".bak")
        write_atomic(r.fixed_code, path)
        n += 1
    return n


def _audit_markdown(log: DataFrame, ordered: DataFrame, stamp: str) -> list[str]:
    from ..operators import audit

    counts = {r.action: r.records for r in audit.by_action(log).collect()}  # at most four
    out = [audit.HEADING, "", f"**Generated:** {stamp}  ", f"**Total findings:** {sum(counts.values())}", "", "## Summary", "", *[f"- {a.capitalize()}: {counts.get(a, 0)}" for a in audit.ACTIONS.values()], "", "## Rotation Checklist", "", audit.ROTATE, ""]
    under = None
    for r in audit.checklist_rows(log).orderBy("provider", *audit.AUDIT_ORDER).select("provider", "title", "row").toLocalIterator():
        if r.provider != under:
            out += ([""] if under is not None else []) + [r.title]
            under = r.provider
        out.append(r.row)
    out += [audit.NOTHING if under is None else "", "## Detailed Log", "", *audit.TABLE_HEAD]
    return out + [r.row for r in audit.markdown_rows(ordered, stamp).orderBy(*audit.AUDIT_ORDER).select("row").toLocalIterator()]


def write_fix_report(outcomes: DataFrame, path: str, dry_run: bool = False) -> None:
    """The text report of a fix: a line or three for each outcome, then the counts."""
    from ..operators import audit

    rows = audit.outcome_rows(outcomes, dry_run).orderBy("file", "line", "rule_id").select("rows").toLocalIterator()
    head = "=== DRY RUN - no files modified ===" if dry_run else "=== Auto-Fix Results ==="
    hint = outcomes.filter("reason = 'env_var_contract_not_found'").isEmpty()
    last = audit.outcome_summary(outcomes, dry_run).first().summary
    write_atomic("\n".join(["", head, *[x for r in rows for x in r.rows], "", last, *([] if hint else ["", "Hint: add a .env.example to enable safe remediation"]), ""]), path)


def write_audit(log: DataFrame, path: str, stamp: str = "") -> list[str]:
    """The audit log as JSON or Markdown by the suffix; both without one. ``stamp`` is the time that the Markdown shows."""
    from ..operators.audit import AUDIT_ORDER

    stem, suffix = os.path.splitext(path)
    if suffix not in ("", ".json", ".md"):
        raise ValueError(f"an audit log is .json or .md, not {suffix}")
    out = []
    ordered = log.orderBy(*AUDIT_ORDER)
    if suffix in ("", ".json"):
        write_atomic(json.dumps([json.loads(r.j) for r in ordered.select(F.to_json(F.struct(*log.columns)).alias("j")).toLocalIterator()], indent=2), stem + ".json")
        out.append(stem + ".json")
    if suffix in ("", ".md"):
        write_atomic("\n".join(_audit_markdown(log, ordered, stamp)), stem + ".md")
        out.append(stem + ".md")
    return out
