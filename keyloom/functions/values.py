"""Scalar functions over secret values, names, paths and rates, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the fingerprint of an empty value.
EMPTY_FINGERPRINT = "sha256:e3b0c44298fc1c149afbf4c8"

# The shapes by which a provider's secrets are known, most specific first.
PROVIDERS = (
    ("github", r"^(ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9_]+$"),
    ("sendgrid", r"^SG\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+$"),
    ("stripe", r"^(sk|rk)_(live|test)_[a-zA-Z0-9]+$"),
    ("slack", r"^xox[baprs]-[0-9]+-[a-zA-Z0-9_]+$"),
    ("aws", r"^(AKIA[0-9A-Z]{16})$"),
)
# How providers are written, and the ends of a value that a preview shows.
PROVIDER_TITLES = {"github": "GitHub", "sendgrid": "SendGrid", "stripe": "Stripe", "slack": "Slack", "aws": "AWS", "generic": "Generic", "unknown": "Unknown"}

# Prefixes that a redacted preview keeps; the first that fits counts.
KNOWN_PREFIXES = (
    "github_pat_",
    "sk_live_",
    "sk_test_",
    "pk_live_",
    "pk_test_",
    "whsec_",
    "rk_live_",
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
    "xoxb-", "xoxp-", "xoxa-", "xoxr-",
    "AIza",
    "AKIA", "ASIA",
    "Bearer ",
)
PREVIEW_HEAD = PREVIEW_TAIL = 4


def strip(s: Column) -> Column:
    """Without white space at either end, Unicode's too."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fingerprint(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", EMPTY_FINGERPRINT).otherwise(F.concat(F.lit("sha256:"), F.substring(F.sha2(value, 256), 1, 24)))


def mask(value: Column) -> Column:
    n = F.length(value)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "***").when(n <= 4, F.concat(F.substring(value, 1, 1), F.lit("***"))).when(n <= 12, F.concat(F.substring(value, 1, 4), F.lit("***")))
        .otherwise(F.concat(F.substring(value, 1, 4), F.lit("***"), F.right(value, F.lit(4))))
    )


def provider(value: Column) -> Column:
    out = F.when(F.coalesce(value, F.lit("")) == "", "unknown")
    for name, pattern in PROVIDERS:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("generic")


def record_id(file: Column, line: Column, rule: Column, fp: Column) -> Column:
    return F.concat(F.lit("rec_"), F.substring(F.md5(F.concat_ws("|", file, line.cast("string"), rule, fp)), 1, 8))


def finding_id(repo: Column, file: Column, line: Column, rule: Column) -> Column:
    return F.concat(F.lit("F"), F.substring(F.sha2(F.concat_ws("|", repo, file, line.cast("string"), rule), 256), 1, 12))


def env_var(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9_]", "_")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def entropy(value: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0 for an empty one."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def redacted_preview(value: Column) -> Column:
    """A known prefix, the first and last characters of what follows, or stars if that is short."""
    v = strip(F.coalesce(value, F.lit("")))
    prefix = reduce(lambda out, p: F.when(v.startswith(p), p).otherwise(out), reversed(KNOWN_PREFIXES), F.lit(""))
    body = F.substring(v, F.length(prefix) + 1, F.length(v))
    short = F.length(body) <= PREVIEW_HEAD + PREVIEW_TAIL + 3
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(3), F.length(body)))
    return F.when(v == "", "").when(short, F.concat(prefix, stars)).otherwise(F.concat(prefix, F.substring(body, 1, PREVIEW_HEAD), F.lit("..."), F.right(body, F.lit(PREVIEW_TAIL))))


def normal_path(path: Column, root: str | None = None) -> Column:
    """Forward slashes, no leading ``./``, no root, no doubled slashes; case is kept."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")
    if root:
        r = root.replace("\\", "/").rstrip("/") + "/"
        p = F.when(p.startswith(r), F.substring(p, F.lit(len(r) + 1), F.length(p))).otherwise(p)
    return F.regexp_replace(p, "/{2,}", "/")


def extension(path: Column) -> Column:
    """The lower-case suffix; the whole name of a dotfile without one."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.lower(F.when(suffix != "", suffix).when(name.startswith(".") & (name != "."), name).otherwise(""))


def wilson(successes: Column, trials: Column, z: float = 1.96, none: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Bounds of Wilson's score interval; ``none`` without trials."""
    n, k = trials.cast("double"), successes.cast("double")
    safe = F.when(n == 0, 1.0).otherwise(n)
    p = k / safe
    denominator = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / denominator
    margin = (z / denominator) * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    return F.when(n == 0, none[0]).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(n == 0, none[1]).otherwise(F.least(F.lit(1.0), centre + margin))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f%%", part * 100.0 / F.nullif(whole, F.lit(0))))


# Words that say nothing in an error report.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were",
    "in", "on", "at", "to", "for", "of", "with",
)


def keywords(text: Column, most: int = 10) -> Column:
    """The first words of over three letters that are no stop words, lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)), 1, most)


def overlap(wanted: Column, have: Column) -> Column:
    """The share of ``wanted`` that ``have`` holds; 0 if nothing is wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, have)) / F.nullif(n, F.lit(0)))


def chunks(text: Column, size: int = 1000) -> Column:
    """Pieces of ``size`` characters, in order."""
    n = F.floor((F.length(text) - 1) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def repo_of_run(project: Column) -> Column:
    """owner/repo of ``github-owner-repo-run``, else the project itself."""
    part = F.split(project, "-")
    return F.when(project.startswith("github-") & (F.size(part) >= 4), F.concat(F.get(part, 1), F.lit("/"), F.get(part, 2))).otherwise(project)


def matched_value(line: Column, most: int = 200) -> Column:
    """The value that a line gives to a name: what is quoted after ``=`` or ``:``, else the word after ``=``, else the line, at most so many characters."""
    bare = strip(line)
    quoted, plain = rf"[:=]\s*[\"']([^\"']{{1,{most}}})[\"']", rf"=\s*(\S{{1,{most}}})"
    return F.when(bare.rlike(quoted), F.regexp_extract(bare, quoted, 1)).when(bare.rlike(plain), F.regexp_extract(bare, plain, 1)).otherwise(F.left(bare, F.lit(most)))
