"""Measuring the scanner: samples, labels, precision, agreement, recall against seeded controls, misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import entropy, finding_id, fingerprint, normal_path, redacted_preview, wilson

# Marks by which a label is suggested.
PLACEHOLDERS = (
    "test", "dummy", "placeholder", "example", "sample", "fake", "mock",
    "changeme", "replace", "your-key", "your-secret", "secret123",
    "password123", "postgres", "mysql", "redis", "none", "null",
    "undefined", "dev", "todo", "fixme", "xxx",
)
TEST_PATHS = ("tests/", "test_", "_test.py", "conftest", "testdata", "fixtures", "spec/")
DOC_PATHS = ("docs/", "examples/", "tutorial/", "documentation/", "README")

# What a plain search would report.
SUSPICIOUS = ("token", "api_key", "apiKey", "secret", "auth_token", "github_token", "bearer", "password")


def _holds(s: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def suggested_label(file: Column, line: Column, value: Column) -> Column:
    """``struct<label,confidence,reason>`` by the first rule of eight that holds."""
    path, low = F.regexp_replace(file, r"\\", "/"), F.lower(F.trim(value))
    s = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("label", "confidence", "reason"), strict=True)])
    return (
        F.when(_holds(line, ("${{", "secrets.", "github.token")), s("FP_GHA", "high", "github_actions_reference"))
        .when(line.rlike(r"(?U)__\w+__\s*="), s("FP_DUNDER", "high", "dunder_assignment"))
        .when(_holds(path, TEST_PATHS), s("FP_TEST", "medium", "test_path_marker"))
        .when(_holds(path, DOC_PATHS), s("FP_DOC", "medium", "docs_path_marker"))
        .when((F.length(low) <= 2) | _holds(low, PLACEHOLDERS), s("FP_PLACEHOLDER", "high", "placeholder_substring"))
        .when(F.length(value) < 4, s("FP_PATTERN", "high", "too_short_pattern"))
        .when((F.length(value) > 12) & (entropy(value) > 3.5), s("TP_CANDIDATE", "low", "high_entropy_candidate"))
        .otherwise(s("REVIEW", "low", "needs_human_review"))
    )


def human_label(raw: Column) -> Column:
    s = F.upper(F.trim(raw))
    return F.when(s.isin("TRUE_POSITIVE", "TP") | s.startswith("TP_"), "TP").when(s.isin("FALSE_POSITIVE", "FP") | s.startswith("FP_") | s.startswith("FP:"), "FP").when(s == "UNCERTAIN", "UNCERTAIN")


def fp_category(raw: Column) -> Column:
    """What follows ``FP:`` or ``FP_``."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(raw)), r"^FP[:_](.*)$", 1), F.lit(""))


def resolved_label(human: Column, classification: Column) -> Column:
    """The human's label if there is one, else the classification."""
    return F.coalesce(F.nullif(F.trim(human), F.lit("")), F.nullif(F.trim(classification), F.lit("")))


def strict_boolean(raw: Column) -> Column:
    """true and false alone; anything else is null, that is malformed."""
    s = F.lower(F.trim(raw))
    return F.when(s == "true", True).when(s == "false", False)


def deduplicated(findings: DataFrame) -> DataFrame:
    """One row for each (repo, file, line, rule), that with the least matched value."""
    key = ["repo", "file", "line", "rule_id"]
    rest = [c for c in findings.columns if c not in key]
    return findings.groupBy(*key).agg(F.min(F.struct("matched_value", *[c for c in rest if c != "matched_value"])).alias("r")).select(*key, "r.*")


def sampled(findings: DataFrame, n: int, seed: int = 42, repos: list[str] | None = None) -> DataFrame:
    """``n`` findings in an order that a digest of key and seed gives: the same for any partitioning."""
    rows = deduplicated(findings)
    if repos:
        rows = rows.filter(F.lower("repo").isin([r.lower() for r in repos]))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "repo", "file", F.col("line").cast("string"), "rule_id"))
    return rows.withColumn("o", order).orderBy("o", "repo", "file", "line", "rule_id").limit(n).drop("o")


def stratified(rows: DataFrame, group: list[str], strata: str, key: Column, quotas: dict[str, int]) -> DataFrame:
    """For each group, as many rows of each stratum as its quota, by ``key``; what strata lack is topped up from the rest."""
    w = Window.partitionBy(*group, strata).orderBy(key)
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(strata)], F.lit(0))
    ranked = rows.withColumn("n", F.row_number().over(w)).withColumn("first", F.col("n") <= quota)
    over = Window.partitionBy(*group).orderBy(F.col("first").desc(), key)
    return ranked.withColumn("m", F.row_number().over(over)).filter(F.col("m") <= sum(quotas.values())).drop("n", "m", "first")


def review_rows(findings: DataFrame) -> DataFrame:
    """Rows for review: ids and previews instead of values."""
    blank = [F.lit("").alias(c) for c in ("human_label", "category", "review_notes", "reviewer", "review_timestamp", "labeling_pass_id")]
    return findings.select(finding_id(F.col("repo"), F.col("file"), F.col("line"), F.col("rule_id")).alias("finding_id"), "repo", "file", "line", "rule_id", redacted_preview(F.col("matched_value")).alias("matched_preview"), "surrounding_context", "synthetic", *blank)


def precision(rows: DataFrame, labels: str = "human_label", synthetic: str = "synthetic", by: tuple[str, ...] = ("repo", "rule_id")) -> DataFrame:
    """Overall and by each of ``by``, in one pass of grouping sets.

    Columns: the keys, grouping, tp, fp, uncertain, malformed,
    synthetic_excluded, unrecognised, precision, lower, upper, preliminary.
    """
    real = rows.withColumn("s", strict_boolean(F.col(synthetic))).withColumn("l", human_label(F.col(labels)))
    counts = [
        F.count_if((F.col("l") == "TP") & ~F.col("s")).alias("tp"), F.count_if((F.col("l") == "FP") & ~F.col("s")).alias("fp"), F.count_if((F.col("l") == "UNCERTAIN") & ~F.col("s")).alias("uncertain"),
        F.count_if(F.col("s").isNull()).alias("malformed"), F.count_if("s").alias("synthetic_excluded"), F.count_if(F.col("l").isNull() & ~F.col("s")).alias("unrecognised"),
    ]
    out = real.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.grouping_id().alias("grouping"), *counts)
    n = F.col("tp") + F.col("fp")
    lower, upper = wilson(F.col("tp"), n)
    return out.withColumn("precision", F.col("tp") / F.nullif(n, F.lit(0))).withColumn("lower", lower).withColumn("upper", upper).withColumn("preliminary", n < 30)


def older_precision(rows: DataFrame, by: tuple[str, ...] = ("repo", "rule_id")) -> DataFrame:
    """tp, fp, skipped (no label) and unrecognised (any other) of rows ``(human_label, classification)``, overall and by each of ``by``."""
    raw = resolved_label(F.col("human_label"), F.col("classification"))
    label = F.when(raw.isNull(), "").otherwise(F.coalesce(human_label(raw), F.lit("?")))
    counts = [F.count_if(F.col("l") == x).alias(n) for x, n in (("TP", "tp"), ("FP", "fp"), ("", "skipped"))]
    return rows.withColumn("l", label).groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.grouping_id().alias("grouping"), *counts, F.count_if(F.col("l").isin("UNCERTAIN", "?")).alias("unrecognised"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, expected, kappa`` of two raters; kappa 1 if agreement is certain, null without rows."""
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("x")).groupBy("x.label").agg(F.sum("x.na").alias("na"), F.sum("x.nb").alias("nb"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    products = each.agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("s"))
    out = total.join(products)  # one row each
    n = F.nullif(F.col("n"), F.lit(0))
    po, pe = F.col("same") / n, F.col("s") / (n * n)
    return out.select("n", po.alias("agreement"), pe.alias("expected"), F.when(pe >= 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def recall_outcomes(controls: DataFrame, findings: DataFrame, root: str | None = None) -> DataFrame:
    """MATCHED at its path, PATH_MISMATCH elsewhere, or VALUE_NOT_FOUND, for ``controls(control_id, family, file_path, expected_value)``.

    A pair of values (family aws_pair) is found by either. Both joins are equi-joins on a fingerprint.
    """
    values = F.when((F.col("family") == "aws_pair") & F.col("expected_value").contains("|"), F.split("expected_value", r"\|", 2)).otherwise(F.array("expected_value"))
    want = controls.withColumn("path", normal_path(F.col("file_path"), root)).withColumn("v", F.explode(F.array_distinct(values))).withColumn("fingerprint", fingerprint(F.col("v")))
    have = findings.select(normal_path(F.col("file"), root).alias("at"), "fingerprint").distinct()
    met = want.select("control_id", "path", "fingerprint").join(have, "fingerprint").groupBy("control_id").agg(F.max(F.col("at") == F.col("path")).alias("here"), F.array_join(F.slice(F.sort_array(F.collect_set("at")), 1, 3), ", ").alias("where"))
    out = controls.withColumn("expected_path", normal_path(F.col("file_path"), root)).join(met, "control_id", "left")
    outcome = F.when(F.col("here"), "MATCHED").when(F.col("here").isNotNull(), "PATH_MISMATCH").otherwise("VALUE_NOT_FOUND")
    return out.withColumn("outcome", outcome).withColumn("detail", F.when(F.col("outcome") == "PATH_MISMATCH", F.col("where")).otherwise("")).drop("here", "where", "expected_value")


def recall(outcomes: DataFrame, by: tuple[str, ...] = ("family", "file_format", "repo")) -> DataFrame:
    """Strict and generous recall with Wilson's bounds, overall and by each of ``by``."""
    out = outcomes.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.grouping_id().alias("grouping"), F.count("*").alias("controls"), F.count_if(F.col("outcome") == "MATCHED").alias("matched"), F.count_if(F.col("outcome") != "VALUE_NOT_FOUND").alias("found"))
    lower, upper = wilson(F.col("matched"), F.col("controls"), none=(0.0, 0.0))
    return out.withColumn("strict", F.col("matched") / F.col("controls")).withColumn("generous", F.col("found") / F.col("controls")).withColumn("lower", lower).withColumn("upper", upper)


def miss_category(family: Column, file_format: Column) -> Column:
    """Why a control was missed, by its format and family."""
    return (
        F.when(file_format == "markdown", "EXTENSION_EXCLUDED").when(family.isin("opaque_random_cred", "pem_private"), "FAMILY_OUT_OF_SCOPE")
        .when(family.isin("generic_bearer", "github_pat", "google_api", "jwt", "opaque_session_token"), "KEYWORD_GAP").otherwise("DETECTOR_MISS")
    )


def miss_taxonomy(outcomes: DataFrame, by: str = "family") -> DataFrame:
    missed = outcomes.filter(F.col("outcome") == "VALUE_NOT_FOUND").withColumn("category", miss_category(F.col("family"), F.col("file_format")))
    return missed.groupBy(by).pivot("category", ["EXTENSION_EXCLUDED", "FAMILY_OUT_OF_SCOPE", "KEYWORD_GAP", "DETECTOR_MISS"]).count().na.fill(0)


def expectations(files: DataFrame) -> DataFrame:
    """``file, line, tag`` of lines that say ``# EXPECT: TAG`` after code."""
    from .windows import lines

    return lines(files).withColumn("tag", F.regexp_extract("text", r"\S.*#\s*EXPECT:\s*(\w+)", 1)).filter("tag <> ''").select("file", "line", "tag")


def expectation_outcomes(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """PASS or MISS where a rule is expected, SUPPRESS_OK or FALSE where SUPPRESS is; any rule counts as found."""
    found = findings.groupBy("file", "line").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))
    none = F.col("tag") == "SUPPRESS"
    outcome = F.when(none & F.col("rules").isNull(), "SUPPRESS_OK").when(none, "FALSE").when(F.col("rules").isNotNull(), "PASS").otherwise("MISS")
    return expected.join(found, ["file", "line"], "left").withColumn("outcome", outcome)


def suspicious_matches(files: DataFrame) -> DataFrame:
    """``file, line, n, at, hit``: every match of each plain search over the whole text, safe ones aside.

    n is the search's place in ``SUSPICIOUS``, at the match's among the
    search's; line is where the match starts, it may go on over lines.
    """
    marks = ("os.getenv", "os.environ", "process.env", "getenv(")
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    rows = files.select("file", "content").filter(F.col("content").rlike(rf"(?iuU)(?:{'|'.join(SUSPICIOUS)})\s*=\s*[\"']"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<n:int,at:int,line:int,hit:string>>").alias("out"))

    def matches(n: int, word: str) -> Column:
        pattern = rf"(?iuU){word}\s*=\s*[\"'][^\"']{{8,}}[\"']"
        both = F.zip_with(F.split("content", pattern), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda g, h: F.struct(newlines(g).alias("gap"), h.alias("hit")))

        def step(a: Column, x: Column) -> Column:
            line = a["line"] + x["gap"]
            one = F.struct(F.lit(n).alias("n"), F.size(a["out"]).alias("at"), line.alias("line"), x["hit"].alias("hit"))
            return F.struct((line + newlines(x["hit"])).alias("line"), F.concat(a["out"], F.array(one)).alias("out"))

        return F.aggregate(F.filter(both, lambda x: x["hit"].isNotNull()), start, step, lambda a: a["out"])

    found = [matches(n, word) for n, word in enumerate(SUSPICIOUS)]
    out = rows.select("file", F.explode(F.concat(*found)).alias("x")).select("file", "x.line", "x.n", "x.at", "x.hit")
    return out.filter(~_holds(F.col("hit"), marks))


def suspicious_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines that a plain search reports and the scanner does not: ``file, line, hit``; of several matches on a line the first search's first."""
    first = suspicious_matches(files).groupBy("file", "line").agg(F.min_by("hit", F.struct("n", "at")).alias("hit"))
    return first.join(findings.select("file", "line").distinct(), ["file", "line"], "left_anti").select("file", "line", F.substring("hit", 1, 120).alias("hit"))


def top_of(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def joined_outcomes(issues: DataFrame, outcomes: DataFrame, traces: DataFrame) -> DataFrame:
    """Issues with the first outcome of their (file, line, rule), and its last trace; issues without an outcome go."""
    key = ["file", "line", "rule_id"]
    first = outcomes.groupBy(*key).agg(F.min_by(F.struct("state", "reason", "env_var"), "seq").alias("o"))
    last = traces.groupBy(*key).agg(F.max_by("final_action", "seq").alias("final_action"))
    return issues.join(first, key).join(last, key, "left").select(*issues.columns, "o.*", "final_action")


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``finding_id``: the rule and a number in order of file, line, rule, over all files.

    The number is global, so counts by range of files come first and each range
    is numbered apart: no task sorts all rows.
    """
    spread = findings.repartitionByRange("file", "line", "rule_id").sortWithinPartitions("file", "line", "rule_id").withColumn("part", F.spark_partition_id()).checkpoint()  # parts stay as they are if executors are lost
    w = Window.partitionBy("part").orderBy("file", "line", "rule_id")
    before = {}
    total = 0
    for r in spread.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        before[r["part"]], total = total, total + r["count"]
    start = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])[F.col("part")]
    return spread.withColumn("finding_id", F.format_string("%s-%04d", "rule_id", (F.row_number().over(w) + start).cast("long"))).drop("part")
