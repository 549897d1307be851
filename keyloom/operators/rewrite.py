"""Rewrites of Python literals to environment look-ups, previews of other files, and diffs."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import env_var
from .pytree import parse

OUTCOMES = "file string, any_fixed boolean, fixed_code string, diff string, outcomes array<struct<line:int,rule_id:string,outcome:string,reason:string,env_var:string>>"


def preview_line(line: Column, ext: Column, name: Column) -> Column:
    """What a line becomes, by its language; every occurrence is replaced."""
    var = F.when(F.coalesce(name, F.lit("")) == "", "SECRET").otherwise(env_var(name))
    ref = F.concat(F.lit(r"\$\{"), var, F.lit("}"))
    quoted = r"(=\s*)[\"'][^\"']*[\"']"
    sub = lambda pattern, to: F.regexp_replace(line, F.lit(pattern), to)
    return (
        F.when(ext == ".py", sub(quoted, F.concat(F.lit('$1os.environ["'), var, F.lit('"]'))))
        .when(ext.isin(".yaml", ".yml"), sub(r"(:\s+)\S.*", F.concat(F.lit("$1"), ref)))
        .when(ext == ".json", sub(r'(":\s*)"[^"]*"', F.concat(F.lit('$1"'), ref, F.lit('"'))))
        .when(ext.isin(".toml", ".tf"), sub(quoted, F.concat(F.lit('$1"'), ref, F.lit('"'))))
        .otherwise(sub(r"(=\s*)\S.*", F.concat(F.lit("$1"), ref)))
    )


def unified(before: str, after: str, file: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{file}", f"b/{file}", n=3))


def _os_taken(tree: ast.AST) -> bool:
    """Whether ``os`` names anything but the module."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and node.id == "os" and isinstance(node.ctx, (ast.Store, ast.Del)):
            return True
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.name == "os" or isinstance(node, ast.arg) and node.arg == "os":
            return True
        if isinstance(node, (ast.Import, ast.ImportFrom)) and any(a.asname == "os" and (isinstance(node, ast.ImportFrom) or a.name != "os") or isinstance(node, ast.ImportFrom) and (a.asname or a.name) == "os" for a in node.names):
            return True
    return False


def _imported(tree: ast.Module) -> bool:
    return any(isinstance(n, ast.Import) and any(a.name == "os" and a.asname in (None, "os") for a in n.names) for n in tree.body)


def _import_line(tree: ast.Module) -> int:
    """The line (0-based) before which ``import os`` goes: after a docstring and future imports."""
    at = 0
    for k, n in enumerate(tree.body):
        if k == 0 and isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) or isinstance(n, ast.ImportFrom) and n.module == "__future__":
            at = n.end_lineno
        else:
            break
    return at


def fix_source(code: str, issues: list[tuple[int, str]]) -> tuple[str | None, list[dict]]:
    """The code with the literals of ``issues`` (line, rule) replaced, or None; and each issue's outcome.

    Only one plain string literal that is assigned to one name, or passed to a
    keyword, on the issue's line is replaced, by ``os.environ["NAME"]``. All
    else is refused: f-strings, joined or adjacent literals, a name ``os`` that
    isn't the module, files that don't parse. ``import os`` is added once if it
    is missing. Fixing what was fixed changes nothing.
    """
    tree, error = parse(code)
    out = [{"line": line, "rule_id": rule, "outcome": "REFUSED", "reason": "refuse_parse_error" if error else None, "env_var": None} for line, rule in issues]
    if error:
        return None, out
    taken = _os_taken(tree)
    raw = code.encode("utf-8", "surrogatepass")
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    sites: dict[int, list[tuple[str, ast.AST]]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            sites.setdefault(node.lineno, []).append((node.targets[0].id, node.value))
        elif isinstance(node, ast.keyword) and node.arg:
            sites.setdefault(node.value.lineno, []).append((node.arg, node.value))
    edits = []
    for o in out:
        here = [(n, v) for n, v in sites.get(o["line"], []) if any(k in n.lower() for k in ("password", "passwd", "pwd"))] if o["rule_id"] == "SEC001" else []
        if taken:
            o["reason"] = "refuse_os_shadowed"
        elif o["rule_id"] != "SEC001":
            o["reason"] = "refuse_rule_not_fixable"
        elif any(isinstance(v, ast.JoinedStr) for _, v in here):
            o["reason"] = "refuse_fstring_mixed_expression"
        elif len(here) != 1 or not isinstance(here[0][1], ast.Constant) or not isinstance(here[0][1].value, str):
            o["reason"] = "refuse_not_single_literal"
        else:
            name, value = here[0]
            start, end = starts[value.lineno - 1] + value.col_offset, starts[value.end_lineno - 1] + value.end_col_offset
            text = raw[start:end].decode("utf-8", "surrogatepass")
            if value.lineno != value.end_lineno or text[-1] not in "'\"" or text.count(text[-1]) != 2:
                o["reason"] = "refuse_not_single_literal"
                continue
            var = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name.upper())
            o |= {"outcome": "FIXED", "reason": None, "env_var": var}
            edits.append((start, end, f'os.environ["{var}"]'.encode()))
    if not edits:
        return None, out
    for start, end, new in sorted(set(edits), reverse=True):
        raw = raw[:start] + new + raw[end:]
    fixed = raw.decode("utf-8", "surrogatepass")
    if not _imported(tree):
        lines = fixed.splitlines(keepends=True)
        lines.insert(_import_line(tree), "import os\n")
        fixed = "".join(lines)
    return fixed, out


def _masked(code: str, issues: list[tuple[int, str]]) -> str:
    """The code with the literals on the issues' lines hidden, so that a diff shows no secret."""
    lines = code.splitlines(keepends=True)
    wanted = {line for line, _ in issues}
    tree, _ = parse(code)
    spans = [(n.lineno, n.col_offset, n.end_col_offset) for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.lineno == n.end_lineno and n.lineno in wanted] if tree else []
    for line, start, end in sorted(spans, reverse=True):
        raw = lines[line - 1].encode("utf-8", "surrogatepass")
        lines[line - 1] = (raw[:start] + b'"***"' + raw[end:]).decode("utf-8", "surrogatepass")
    return "".join(lines)


def rewritten(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The rewrite of each Python file with findings: pure, nothing is written.

    findings are grouped by file, then joined to the contents: a file's
    findings are bounded by its size, which the scan bounds.
    """
    issues = findings.groupBy("file").agg(F.sort_array(F.collect_set(F.struct("line", "rule_id"))).alias("issues"))
    rows = files.filter(F.col("file").endswith(".py")).select("file", "content").join(issues, "file")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, content, found in zip(frame["file"], frame["content"], frame["issues"], strict=True):
                todo = [(int(i["line"]), i["rule_id"]) for i in found]
                fixed, outcomes = fix_source(content or "", todo)
                diff = unified(_masked(content, todo), fixed, file) if fixed is not None else None
                out.append((file, fixed is not None, fixed, diff, outcomes))
            yield pd.DataFrame(out, columns=["file", "any_fixed", "fixed_code", "diff", "outcomes"])

    return rows.mapInPandas(run, OUTCOMES)
