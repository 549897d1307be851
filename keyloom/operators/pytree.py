"""Findings from the syntax trees of Python files, and whether they parse: the one step that needs Python."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import EMPTY_FINGERPRINT, PROVIDERS
from . import rules as R

# Names that mark a secret, and keyword arguments that never are.
NAME_MARKS = ("password", "passwd", "pwd", "api_key", "apikey", "secret", "token", "auth_token", "credential", "azure_vision_key", "openai_api_key")
HARMLESS_ARGUMENTS = ("tokenurl", "url", "scope", "permission", "redirect_uri")

SCHEMA = "file string, seq int, line int, rule_id string, col int, end_col int, message string, type string, severity string, source string, pattern_type string, var_name string, masked string, provider string, fingerprint string"


def secret_name(name: str) -> bool:
    return any(k in name.lower() for k in NAME_MARKS)


def _told(value: str | None) -> tuple[str, str, str]:
    """mask, provider and fingerprint of a literal, as the column functions give them."""
    if not value:
        return "***", "unknown", EMPTY_FINGERPRINT
    masked = value[:1] + "***" if len(value) <= 4 else value[:4] + "***" if len(value) <= 12 else f"{value[:4]}***{value[-4:]}"
    kind = next((name for name, pattern in PROVIDERS if re.match(pattern, value)), "generic")
    return masked, kind, "sha256:" + hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:24]


def _harmless_value(name: str, value: str) -> bool:
    low = value.lower().strip()
    if any(p in low for p in R.PLACEHOLDERS) or not low or low in R.PLAIN_WORDS or re.match(r"^[a-z]+ [a-z]+$", low):
        return True
    if re.match(r"^_[a-zA-Z_]*$", value.strip()):
        return True
    bare = lambda s: re.sub("[^a-z0-9]", "", "".join(c.lower() if "A" <= c <= "Z" else c for c in s))
    n, v = bare(name), bare(value)
    return bool(n and v and (n in v or v in n))


def _literal(node: ast.AST, name: str) -> bool:
    """Whether a value of this name is a literal to report: a string, or an f-string, which has no one value."""
    if any(name.lower().endswith(s) for s in R.METADATA_SUFFIXES) or not secret_name(name):
        return False
    if isinstance(node, ast.JoinedStr):
        return True
    return isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value != "" and "os.getenv" not in node.value and "os.environ" not in node.value


def _environment_key(target: ast.AST) -> str | None:
    """KEY of ``os.environ["KEY"]``."""
    if isinstance(target, ast.Subscript) and isinstance(target.value, ast.Attribute) and target.value.attr == "environ":
        if isinstance(target.value.value, ast.Name) and target.value.value.id == "os" and isinstance(target.slice, ast.Constant) and isinstance(target.slice.value, str):
            return target.slice.value or None
    return None


def _candidates(tree: ast.AST) -> Iterator[tuple[ast.AST, ast.AST, str, str]]:
    """``(statement or argument, value, name, shown)``, parents before children, in source order."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Assign):
            one = node.targets[0] if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) else None
            if one is not None and not (one.id.startswith("__") and one.id.endswith("__")) and _literal(node.value, one.id):
                yield node, node.value, one.id, f"'{one.id}'"
            else:
                for target in node.targets:
                    key = _environment_key(target)
                    if key and secret_name(key):
                        yield node, node.value, key, f'os.environ["{key}"]'
        elif isinstance(node, ast.Call):
            for arg in node.keywords:
                if arg.arg and arg.arg.lower() not in HARMLESS_ARGUMENTS and _literal(arg.value, arg.arg):
                    yield arg, arg.value, arg.arg, f"'{arg.arg}'"
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def parse(content: str) -> tuple[ast.AST | None, tuple[int, int, str] | None]:
    """A tree, or where and why there is none. Whatever stops the parser counts as an error of the file."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(content), None
    except SyntaxError as e:
        return None, (e.lineno or 1, max(0, (e.offset or 1) - 1), e.msg or "invalid syntax")
    except (MemoryError, RecursionError, ValueError) as e:
        return None, (1, 0, type(e).__name__)


def tree_findings(content: str) -> list[dict]:
    tree, _ = parse(content)
    out, seen = [], set()
    for node, value, name, shown in _candidates(tree) if tree is not None else ():
        literal = getattr(value, "value", None)
        literal = literal if isinstance(literal, str) else None
        if literal is not None and _harmless_value(name, literal):
            continue
        low = name.lower()
        password = any(k in low for k in ("password", "passwd", "pwd"))
        rule_id = "SEC001" if password else "SEC002"
        if (key := (node.lineno, value.col_offset, rule_id)) in seen:
            continue
        seen.add(key)
        masked, provider, print_ = _told(literal)
        out.append({
            "seq": len(out), "line": node.lineno, "rule_id": rule_id, "col": value.col_offset, "end_col": value.end_col_offset, "message": f"Hardcoded {'password' if password else 'secret'} {shown} detected.",
            "type": "security", "severity": "high", "source": "ast", "pattern_type": ("password" if "password" in low else "passwd") if password else "api_key", "var_name": None,
            "masked": masked, "provider": provider, "fingerprint": print_,
        })
    return out


def ast_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of the trees of ``files(file, content)`` whose name ends in .py.

    A file that doesn't parse has none; with ``strict``, the one finding
    PARSE_ERROR. Batches go through Arrow; a file's failure stays with it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for file, content in zip(frame["file"], frame["content"].fillna(""), strict=True):
                error = parse(content)[1] if strict else None
                if error:
                    rows.append({
                        "file": file, "seq": 0, "line": error[0], "rule_id": "PARSE_ERROR", "col": error[1], "end_col": None, "message": f"Syntax error: {error[2]}", "type": "parse", "severity": "high", "source": "parser",
                        "pattern_type": "parse_error", "var_name": None, "masked": None, "provider": None, "fingerprint": "parse_error",
                    })
                else:
                    rows += [{"file": file} | f for f in tree_findings(content)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("line", "col", "end_col", "seq"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.filter(F.col("file").endswith(".py")).select("file", "content").mapInPandas(run, SCHEMA)


def parse_validity(files: DataFrame) -> DataFrame:
    """``file, parse_valid, error_line, error_col`` of Python files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = [parse(c)[1] for c in frame["content"].fillna("")]
            yield pd.DataFrame({"file": frame["file"], "parse_valid": [e is None for e in errors], "error_line": pd.array([e and e[0] for e in errors], "Int32"), "error_col": pd.array([e and e[1] for e in errors], "Int32")})

    return files.filter(F.col("file").endswith(".py")).select("file", "content").mapInPandas(run, "file string, parse_valid boolean, error_line int, error_col int")
