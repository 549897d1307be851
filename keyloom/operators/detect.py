"""Findings from texts: lines times rules, gated, one per line and rule id.

All on the row: a text is split, its lines are filtered by the rules' keywords
and matched in one pass of an unrolled array of rules. Nothing is shuffled
before the findings, which are few; raw values never leave this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import extension, fingerprint, mask, provider, strip
from . import rules as R

COLUMNS = ("file", "line", "rule_id", "col", "end_col", "message", "type", "severity", "source", "pattern_type", "var_name", "masked", "provider", "fingerprint")


def file_outcome(content: Column, ext: Column, allowed: tuple[str, ...] = R.DEFAULT_EXTENSIONS, most: int = R.MAX_CHARS) -> Column:
    """Why a text is refused, or SUCCESS, in the order of the gates."""
    return (
        F.when(strip(F.coalesce(content, F.lit(""))) == "", "FILE_EMPTY").when(F.length(content) > most, "FILE_TOO_LARGE").when(~ext.isin(*allowed), "UNSUPPORTED_LANGUAGE")
        .when(content.contains("\u0000"), "FILE_BINARY").otherwise("SUCCESS")
    )


def unquoted(part: Column) -> Column:
    """A stripped part without its quotes, if they are a pair."""
    p = strip(part)
    first = F.substring(p, 1, 1)
    paired = (F.length(p) >= 2) & first.isin("'", '"') & (first == F.right(p, F.lit(1)))
    return F.when(paired, F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(p)


def _name(part: Column) -> Column:
    return F.regexp_replace(unquoted(part), r"(?U)^(?:const |let |var |export |EXPORT )\s*", "")


def _match(rule: R.Rule, line: Column, ext: Column) -> Column:
    hit = F.regexp_extract(line, rule.java, 0)
    return F.when(
        ext.isin(*rule.extensions),
        F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.pattern_type).alias("pattern_type"), F.lit(rule.message).alias("message"), hit.alias("hit"), (F.instr(line, hit) - 1).alias("col")),
    )


def _gated(m: Column, line: Column, ext: Column) -> Column:
    name, value = m["name"], m["value"]
    return ~(R.comment_before(ext, F.left(line, m.col)) | R.metadata_name(name) | R.dunder(name) | R.placeholder(value) | R.word_like(value) | R.mirrors(name, value))


def lines_of(files: DataFrame, allowed: tuple[str, ...] = R.DEFAULT_EXTENSIONS, keep: tuple[str, ...] = (), most: int = R.MAX_CHARS) -> DataFrame:
    """``file, ext, line, text, services`` of the lines that a rule could match, of texts that pass the gates.

    services: whether a container service's key is near, in a CI file's YAML.
    """
    rows = files.select(*keep, "file", extension(F.col("file")).alias("ext"), "content")
    rows = rows.filter((file_outcome(F.col("content"), F.col("ext"), allowed, most) == "SUCCESS") & F.col("content").rlike(R.KEYWORDS)).withColumn("lines", F.split("content", "\n"))
    key = F.transform("lines", lambda x: F.upper(x).rlike(R.any_of(R.SERVICE_KEYS)))
    w = R.SERVICE_WINDOW
    near = F.when(F.col("ext").isin(*R.YAML) & R.ci_path(F.col("file")), F.transform("keys", lambda _, i: F.exists(F.slice("keys", F.greatest(i - w, F.lit(0)) + 1, F.least(i, F.lit(w)) + w + 1), lambda k: k)))
    rows = rows.withColumn("keys", F.when(F.col("ext").isin(*R.YAML) & R.ci_path(F.col("file")), key)).withColumn("near", near)
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), F.coalesce(F.get("near", i), F.lit(False)).alias("services")))
    wanted = F.filter(each, lambda x: x.text.rlike(R.KEYWORDS) & ~(x.text.contains("${{") & (x.text.contains("secrets.") | x.text.contains("github."))) & ~x.text.rlike(R.any_of(R.SAFE_MARKS)))
    return rows.select(*keep, "file", "ext", F.explode(wanted).alias("x")).select(*keep, "file", "ext", "x.line", "x.text", "x.services")


def regex_findings(files: DataFrame, allowed: tuple[str, ...] = R.DEFAULT_EXTENSIONS, keep: tuple[str, ...] = (), most: int = R.MAX_CHARS) -> DataFrame:
    """Findings of the rules, first rule of an id on a line; columns ``keep`` of files, then ``COLUMNS``."""
    lines = lines_of(files, allowed, keep, most)
    text, ext = F.col("text"), F.col("ext")
    hits = F.filter(F.array(*[_match(r, text, ext) for r in R.RULES]), lambda m: m.isNotNull() & (m.hit != ""))
    split = F.transform(hits, lambda m: F.struct(m.rule_id.alias("rule_id"), m.pattern_type.alias("pattern_type"), m.message.alias("message"), m.col.alias("col"), (m.col + F.length(m.hit)).alias("end_col"),
        _name(F.regexp_extract(m.hit, r"^([^:=]*)", 1)).alias("name"), unquoted(F.regexp_extract(m.hit, r"(?s)^[^:=]*[:=](.*)$", 1)).alias("value")))
    lines = lines.withColumn("hits", split)
    kept = F.filter("hits", lambda m: _gated(m, text, ext))
    lines = lines.withColumn("kept", kept)
    first = lambda rule: F.get(F.filter("kept", lambda m: m.rule_id == rule), 0)
    rows = lines.select(*keep, "file", "line", "services", F.explode(F.array_compact(F.array(first("SEC001"), first("SEC002")))).alias("m"))
    value = F.col("m.value")
    return rows.select(
        *keep, "file", "line", "m.rule_id", "m.col", "m.end_col", "m.message", F.lit("security").alias("type"), F.when(F.col("services"), "low").otherwise("high").alias("severity"),
        F.lit("regex").alias("source"), "m.pattern_type", F.col("m.name").alias("var_name"), mask(value).alias("masked"), provider(value).alias("provider"), fingerprint(value).alias("fingerprint"),
    )


def merged(regex: DataFrame, tree: DataFrame) -> DataFrame:
    """One finding for each (file, line, rule): the syntax tree's last, else the regex's.

    tree has ``seq``, the order of visit. Findings are few beside lines, so
    their shuffle is small.
    """
    both = regex.withColumn("seq", F.lit(0)).withColumn("tree", F.lit(False)).unionByName(tree.withColumn("tree", F.lit(True)), allowMissingColumns=True)
    best = both.groupBy("file", "line", "rule_id").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("file", "line", "rule_id", "tree", "seq")]), F.struct("tree", "seq")).alias("f"))
    return best.select("file", "line", "rule_id", "f.*").select(*COLUMNS)


def overlap_merged(findings: DataFrame) -> DataFrame:
    """Of overlapping column ranges with one (file, rule, line), one finding: the syntax tree's first, else the leftmost.

    Gaps and islands: a range starts an island when it begins at or after all ends before it.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file", "rule_id", "line").orderBy("col", "end_col", "source")
    before = F.max("end_col").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumn("starts", (before.isNull() | (F.col("col") >= before)).cast("int"))
    marked = marked.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("file", "rule_id", "line", "island").orderBy((F.col("source") == "ast").desc(), "col", "end_col")
    return marked.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("starts", "island", "n")


def without_rules(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.filter(~F.col("rule_id").isin(disabled)) if disabled else findings
