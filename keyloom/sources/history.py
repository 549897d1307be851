"""The text of ``git log -p -U0`` as added lines, and findings over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect, pytree
from ..operators.rules import DEFAULT_EXTENSIONS

FORMAT = "COMMIT|%H|%cd|%s"


def git_log(repo: str) -> list[str]:
    """The arguments whose output ``added_lines`` reads."""
    return ["git", "-C", repo, "log", "-p", "-U0", "--no-color", f"--format={FORMAT}", "--date=iso-strict"]


def read_log(spark: SparkSession, repo: str, name: str | None = None) -> DataFrame:
    """``repo, n, raw`` of a repository's log, its lines in order."""
    import subprocess

    out = subprocess.run(git_log(repo), capture_output=True, check=True).stdout.decode("utf-8", "replace").split("\n")
    return spark.createDataFrame([(name or repo, i, line) for i, line in enumerate(out)], "repo string, n long, raw string")


def added_lines(log: DataFrame, allowed: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """``repo, commit_hash, author_date, message, file, line_number, content`` of ``log(repo, n, raw)``.

    The log is a sequence, so one repository is one window: its state, the last
    commit, file and hunk, is carried by ``last``. The extension is the plain
    suffix: a dotfile such as ``.env`` has none and is not read.
    """
    w = Window.partitionBy("repo").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    keep = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(w)
    hunk = F.regexp_extract(raw, r"^@@ -\S+ \+(\d+)", 1)
    header = raw.rlike(r"^COMMIT\|[0-9a-f]{7,64}\|")
    rows = log.withColumn("commit", keep(header, raw)).withColumn("target", keep(header | raw.startswith("diff --git ") | raw.startswith("+++ "), F.when(raw.startswith("+++ "), raw).otherwise("")))
    rows = rows.withColumn("hunk", keep(hunk != "", F.struct("n", hunk.cast("int").alias("start"))))
    rows = rows.filter(raw.startswith("+") & ~raw.startswith("+++ ") & F.col("hunk").isNotNull() & F.col("target").startswith("+++ b/"))
    number = F.row_number().over(Window.partitionBy("repo", "hunk.n").orderBy("n")) - 1 + F.col("hunk.start")
    part = F.split("commit", r"\|", 4)
    out = rows.select("repo", part[1].alias("commit_hash"), part[2].alias("author_date"), part[3].alias("message"), F.substring("target", 7, 1 << 20).alias("file"), number.alias("line_number"), F.substring("raw", 2, 1 << 30).alias("content"))
    return out.filter(F.lower(F.regexp_extract("file", r"[^/](\.[^./]+)$", 1)).isin(*allowed))


def history_findings(added: DataFrame, allowed: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Findings of each added line as a file of its own; the same secret in several commits counts each time."""
    key = F.concat_ws("\u0001", "repo", "commit_hash", F.col("line_number").cast("string"), "file")
    files = added.withColumn("k", F.concat(F.md5(key), F.lit("/"), "file")).select("k", "repo", "commit_hash", "author_date", F.col("message").alias("commit_message"), F.col("file").alias("path"), "line_number", "content")
    units = files.select(F.col("k").alias("file"), "content")
    found = detect.merged(detect.regex_findings(units, allowed), pytree.ast_findings(units))
    return files.join(found.withColumnRenamed("file", "k"), "k").select("repo", "commit_hash", "author_date", "commit_message", F.col("path").alias("file"), "line_number", "rule_id", "severity", "message", "fingerprint")


def history_counts(added: DataFrame, findings: DataFrame) -> DataFrame:
    return added.agg(F.count_distinct("repo", "commit_hash").alias("commits_scanned")).join(findings.agg(F.count("*").alias("findings")))  # one row each
