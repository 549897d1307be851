"""Detection rules as data, and the gates on what they match, as column expressions.

``PATTERN`` holds a rule's shape once; Spark gets it with Java's Unicode word
class, SQL with RE2's. No shape has a look-around or a back reference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import strip

# Which files are read by default, which can be, and the most characters of a file.
DEFAULT_EXTENSIONS = (".py", ".env", ".yaml", ".yml", ".json", ".toml", ".tf", ".sh", ".config", ".ini", ".properties")
SUPPORTED_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".env", ".yaml", ".yml", ".json", ".toml", ".tf", ".sh", ".config", ".ini", ".properties")
MAX_CHARS = 100 * 1024

PY, JS, SHELL, YAML, JSON_, TOML = (".py",), (".js", ".jsx", ".ts", ".tsx"), (".env", ".config", ".ini", ".properties", ".sh"), (".yaml", ".yml"), (".json",), (".toml", ".tf")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    extensions: tuple[str, ...]
    pattern_type: str
    message: str
    shape: str
    folded: bool = True

    @property
    def java(self) -> str:
        return ("(?iuU)" if self.folded else "(?U)") + self.shape.replace("<w>", r"\w")

    @property
    def re2(self) -> str:
        return ("(?i)" if self.folded else "") + self.shape.replace("<w>", r"[\p{L}\p{N}_]")


_PASS = "(?:password|passwd|pwd)"
_KEYS = "(?:api_key|secret_key|secret|auth_token|auth_key|access_key|private_key|token)"
_Q, _LIT = "['\"]?", "['\"][^'\"]+['\"]"

# The rules, in order; the first that matches a line counts for its id.
RULES = (
    Rule("SEC001", PY, "password", "Hardcoded password detected.", rf"{_Q}<w>*{_PASS}<w>*{_Q}\s*[:=]\s*{_LIT}"),
    Rule("SEC002", PY, "api_key", "Hardcoded API key detected.", rf"{_Q}<w>*(?:api_key|apikey)<w>*{_Q}\s*[:=]\s*{_LIT}"),
    Rule("SEC002", PY, "token", "Hardcoded secret/token detected.", rf"{_Q}<w>*(?:secret_key|secret|token|auth_token|api_secret|access_key|private_key)<w>*{_Q}\s*[:=]\s*{_LIT}"),
    Rule("SEC002", JS, "api_key", "Hardcoded API key detected.", rf"(?:const|let|var)\s+apiKey\s*=\s*{_LIT}", False),
    Rule("SEC001", JS, "password", "Hardcoded password detected.", rf"(?:const|let|var)\s+<w>*[Pp]assword<w>*\s*=\s*{_LIT}", False),
    Rule("SEC002", JS, "token", "Hardcoded secret/token detected.", rf"(?:const|let|var)\s+(?:secret|token|authToken|apiSecret)\s*=\s*{_LIT}", False),
    Rule("SEC001", SHELL, "password", "Hardcoded password detected.", rf"(?:export\s+)?<w>*{_PASS}<w>*\s*=\s*\S+"),
    Rule("SEC002", SHELL, "api_key", "Hardcoded API key/secret detected.", r"(?:export\s+)?<w>*(?:secret|api_key|api_secret|auth_token|auth_key|access_key|private_key|token|stripe|sendgrid|twilio|mailgun|github_token|heroku|cloudinary)<w>*\s*=\s*\S+"),
    Rule("SEC001", YAML, "password", "Hardcoded password detected.", rf"{_Q}<w>*{_PASS}<w>*{_Q}\s*:\s+\S+"),
    Rule("SEC002", YAML, "api_key", "Hardcoded API key/secret detected.", rf"{_Q}<w>*{_KEYS}<w>*{_Q}\s*:\s+\S+"),
    Rule("SEC001", JSON_, "password", "Hardcoded password detected.", rf'"<w>*{_PASS}<w>*"\s*:\s*"[^"]+"'),
    Rule("SEC002", JSON_, "api_key", "Hardcoded API key/secret detected.", rf'"<w>*{_KEYS}<w>*"\s*:\s*"[^"]+"'),
    Rule("SEC001", TOML, "password", "Hardcoded password detected.", rf"{_Q}<w>*{_PASS}<w>*{_Q}\s*=\s*{_LIT}"),
    Rule("SEC002", TOML, "api_key", "Hardcoded API key/secret detected.", rf"{_Q}<w>*{_KEYS}<w>*{_Q}\s*=\s*{_LIT}"),
)

#: Every rule needs one of these on its line, whatever its extension.
KEYWORDS = r"(?iuU)password|passwd|pwd|api_?key|secret|token|auth_key|access_key|private_key|stripe|sendgrid|twilio|mailgun|heroku|cloudinary"

# Endings of names that tell of a secret rather than hold one.
METADATA_SUFFIXES = (
    "_chars", "_characters", "_charset",
    "_min_length", "_max_length", "_length", "_len",
    "_pattern", "_regex", "_regexp", "_format",
    "_policy", "_rules", "_requirements",
    "_expiry", "_ttl", "_timeout", "_age",
    "_hash", "_algorithm", "_algo", "_method",
    "_header", "_field", "_name", "_label", "_prompt",
    "_prefix", "_suffix", "_separator",
    "_encoding", "_salt_length",
    "_file", "_path", "_dir", "_url", "_env",
    "_type", "_mode", "_level", "_version",
)

# Parts of values that are no secrets, and whole values.
PLACEHOLDERS = (
    "test-key", "test_key", "dummy", "placeholder", "example", "sample",
    "your-api-key-here", "your-secret-here", "changeme", "replace-me",
    "secret123", "password123", "postgres", "mysql", "redis",
    "none", "null", "undefined", "empty", "dev", "development",
    "fake", "mock", "stub", "todo", "fixme", "xxx",
    "write", "read", "tokens",
)
PLAIN_WORDS = (
    "post", "get", "put", "patch", "delete", "head", "options",
    "token", "key", "apikey", "api_key", "secret", "password", "passwd",
    "set-password", "set_password", "bearer",
)

# What reads a secret from the environment, and what marks a CI file.
SAFE_MARKS = ("os.getenv", "os.environ", "process.env", "env.", "getenv(", "environ[")
CI_PATHS = (".github/", ".gitlab-ci.yml", "docker-compose", "ci/")
SERVICE_KEYS = (
    "POSTGRES_USER", "POSTGRES_DB", "POSTGRES_PASSWORD",
    "MYSQL_ROOT_PASSWORD", "MYSQL_DATABASE", "MYSQL_USER", "MYSQL_PASSWORD",
    "REDIS_PASSWORD", "MONGO_INITDB_ROOT_USERNAME", "MONGO_INITDB_ROOT_PASSWORD",
)
SERVICE_WINDOW = 30

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def any_of(words) -> str:
    return "|".join(re.escape(w).replace("\\-", "-") for w in words)


def metadata_name(name: Column) -> Column:
    return F.lower(strip(name)).rlike(rf"(?:{any_of(METADATA_SUFFIXES)})$")


def dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__") & (F.length(name) > 4)


def placeholder(value: Column) -> Column:
    return F.lower(value).rlike(any_of(PLACEHOLDERS))


def word_like(value: Column) -> Column:
    v = strip(value)
    return (v == "") | F.lower(v).isin(*PLAIN_WORDS) | F.lower(v).rlike(r"^[a-z]+ [a-z]+$") | (v.startswith("_") & v.rlike(r"^[_a-zA-Z][a-zA-Z_]*$"))


def mirrors(name: Column, value: Column) -> Column:
    bare = lambda s: F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]", "")
    n, v = bare(name), bare(value)
    return (n != "") & (v != "") & (n.contains(v) | v.contains(n))


def ci_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/")).rlike(any_of(CI_PATHS))


def comment_before(ext: Column, prefix: Column) -> Column:
    """Whether a comment sign stands before the match, by the file's language."""
    hashed = ext.isin(".py", ".yaml", ".yml", ".env", ".sh", ".config", ".ini", ".properties", ".toml", ".tf") & prefix.contains("#")
    slashed = ext.isin(".js", ".ts", ".jsx", ".tsx", ".tf") & prefix.contains("//")
    return hashed | slashed
