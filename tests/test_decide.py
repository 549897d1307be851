import json
import os
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from keyloom.functions import hints
from keyloom.operators import audit, evaluate, flow, graph, policy, rewrite, store, windows
from keyloom.sources import controls, files, history, tables
from keyloom.streaming import events

POLICY = [
    ("SEC001", "password", True, True, True, False, "preview_then_apply"), ("SEC001", "passwd", True, True, True, False, "preview_only"), ("SEC001", "password", False, True, True, False, "preview_only"),
    ("SEC001", "password", True, False, True, False, "preview_only"), ("SEC002", "token", True, True, True, False, "preview_only"), ("SEC002", "token", False, True, True, False, "block_with_reason"),
    ("SEC002", "token", False, True, True, True, "preview_only"), ("SEC001", "password", True, True, False, False, "block_with_reason"), ("OTHER", "x", True, True, True, False, "preview_only"),
]


@pytest.mark.parametrize(("rule", "kind", "env", "single", "parsed", "dry", "action"), POLICY)
def test_policy(spark, rule, kind, env, single, parsed, dry, action):
    f = spark.createDataFrame([("a.py", 1, rule, kind, "generic", "high")], "file string, line int, rule_id string, pattern_type string, provider string, severity string")
    t = policy.routed(policy.with_decisions(f, env, dry, parsed, single)).first()
    assert t.trace.final_action == action and len(t.trace.gate_results) == (6 if parsed else 1)
    assert t.state == ("TO_FIX" if action == "preview_then_apply" else "SKIPPED" if rule == "OTHER" else "REFUSED")
    assert (t.trace.smallest_unblocking_action is None) == (action == "preview_then_apply" or rule == "OTHER" and False)


def test_rewrite():
    code = '"""Doc."""\nfrom __future__ import annotations\n\npassword  =  "q8Zk1vTr"  # é\n'
    fixed, out = rewrite.fix_source(code, [(4, "SEC001")])
    assert fixed == '"""Doc."""\nfrom __future__ import annotations\nimport os\n\npassword  =  os.environ["PASSWORD"]  # é\n' and out[0]["outcome"] == "FIXED"
    assert rewrite.fix_source(fixed, [(5, "SEC001")])[0] is None
    assert rewrite.fix_source("import os\nf(password='q8')\n", [(2, "SEC001")])[0] == 'import os\nf(password=os.environ["PASSWORD"])\n'
    for code, reason in (('os = 1\npassword = "q8"', "refuse_os_shadowed"), ('x = 1\npassword = f"{a}"', "refuse_fstring_mixed_expression"), ('\npassword = "a" "b"', "refuse_not_single_literal"), ('\npassword = ("a"', "refuse_parse_error")):
        fixed, out = rewrite.fix_source(code, [(2, "SEC001")])
        assert fixed is None and out[0]["reason"] == reason


def test_diff_hides_values(spark):
    f = spark.createDataFrame([("a.py", 'password = "TopSecret99"\n')], "file string, content string")
    issues = spark.createDataFrame([("a.py", 1, "SEC001")], "file string, line int, rule_id string")
    r = rewrite.rewritten(f, issues).first()
    assert r.any_fixed and "TopSecret99" not in r.diff and '+password = os.environ["PASSWORD"]' in r.diff


def test_sources(spark, tmp_path):
    for name, text in ((".env", "TOKEN=q8Zk1vTr"), ("a/x.py", 'password = "q8Zk1vTr"'), ("a/broken.py", "def f(:"), ("tests/t.py", 'password = "q8Zk1vTr"'), ("docs/d.py", 'password = "q8Zk1vTr"'), ("node_modules/n.py", "x"), ("bin.py", b"\xff\xfe")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / files.IGNORE_FILE).write_text("# no\ndocs/*\n")
    listed, found = files.scan_directory(spark, str(tmp_path))
    assert sorted(r.file for r in listed.collect()) == [".env", "a/broken.py", "a/x.py", "bin.py"]
    assert [r.skipped for r in listed.orderBy("file").collect()] == [False, False, False, True]
    assert sorted((r.file, r.rule_id) for r in found.collect()) == [(".env", "SEC002"), ("a/broken.py", "PARSE_ERROR"), ("a/x.py", "SEC001")]
    assert files.has_contract(str(tmp_path)) and files.allowed_extensions(["JS", "md"])[1] == [".md"]
    (tmp_path / files.CONFIG_FILE).write_text(json.dumps({"disabled_rules": ["SEC001"]}))
    assert files.load_config(str(tmp_path / "a")) == {"disabled_rules": ["SEC001"]}
    assert json.loads(tables.envelope({"n": 1}, found))["summary"] == {"n": 1}
    globbed = spark.createDataFrame([("docs/a.py",), ("b.py",), ("x/b.pyc",)], "p string").filter(files.glob_excluded(F.col("p"), ["docs", "*.pyc"]))
    assert sorted(r.p for r in globbed.collect()) == ["docs/a.py", "x/b.pyc"]


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, text in enumerate(("x = 1\n", "x = 1\nTWILIO_AUTH_TOKEN = 'tw-live-8371abc'\n", "x = 1\n")):
        (tmp_path / "db.py").write_text(text)
        (tmp_path / "notes.md").write_text(f"{n} password = 'abc12345'")
        git("add", "-A")
        git("commit", "-qm", f"c{n} | more")
    added = history.added_lines(history.read_log(spark, str(tmp_path), "r"))
    found = history.history_findings(added).collect()
    assert [(r.file, r.line_number, r.rule_id, r.commit_message) for r in found] == [("db.py", 2, "SEC002", "c1 | more")]


def test_csv_round_trip(spark, tmp_path):
    rows = [('a,"b"', "x\ny", None), ("é", "", "z")]
    tables.write_csv(spark.createDataFrame(rows, "a string, b string, c string").na.fill(""), str(tmp_path / "c"))
    got = tables.read_csv(spark, str(tmp_path / "c"), ("a", "b", "c")).na.fill("").collect()
    assert sorted(map(tuple, got)) == sorted((a, b or "", c or "") for a, b, c in rows)


def test_audit_and_rules(spark, tmp_path):
    rows = [("f.py", 1, "SEC001", "generic", "a***", "fp1", "FIXED", "PASSWORD", None), ("f.py", 2, "SEC002", None, "b|***", "fp2", "REFUSED", None, "policy_block"), ("g.py", 1, "PARSE_ERROR", None, None, "x", "REFUSED", None, "r")]
    log = audit.audit_log(spark.createDataFrame(rows, "file string, line int, rule_id string, provider string, masked string, fingerprint string, state string, env_var string, reason string"))
    assert {r.action: r.records for r in audit.by_action(log).collect()} == {"fixed": 1, "refused": 1}
    assert [os.path.basename(p) for p in tables.write_audit(log, str(tmp_path / "log"))] == ["log.json", "log.md"]
    lines = (tmp_path / "log.md").read_text().split("\n")
    ids = {r.fingerprint: r.record_id for r in log.collect()}
    assert lines[3:] == [
        "**Total findings:** 2", "", "## Summary", "", "- Fixed: 1", "- Refused: 1", "- Skipped: 0", "- Failed: 0", "", "## Rotation Checklist", "",
        "If a secret was ever committed, assume it is compromised and rotate it.", "", "### Generic", f"- [ ] `a***` (`f.py:1`) - fixed [`{ids['fp1']}`]", "", "### Unknown", f"- [ ] `b|***` (`f.py:2`) - refused [`{ids['fp2']}`]", "",
        "## Detailed Log", "", "| ID | Timestamp | Action | Provider | Masked Value | Fingerprint | File | Line | Rule | Reason |", "|---|---|---|---|---|---|---|---:|---|---|",
        f"| {ids['fp1']} |  | fixed | generic | `a***` | `fp1` | `f.py` | 1 | SEC001 |  |", f"| {ids['fp2']} |  | refused | unknown | `b|***` | `fp2` | `f.py` | 2 | SEC002 | policy_block |",
    ]
    none = log.filter("1 = 0")
    tables.write_audit(none, str(tmp_path / "none.md"))
    assert "*No secrets found.*\n## Detailed Log" in (tmp_path / "none.md").read_text()
    odd = spark.createDataFrame([("a|b`c\r\nd",), (None,)], "t string")
    assert [r.e for r in odd.select(audit.escaped(odd.t).alias("e")).collect()] == ["a\\|b\\`c d", ""]
    with pytest.raises(ValueError):
        tables.write_audit(log, str(tmp_path / "log.txt"))
    own = tables.custom_rules("rules:\n  - id: A\n    pattern: 'foo+'\n  - id: B\n    pattern: '('\n  - pattern: x\n")
    assert [r["id"] for r in own] == ["A"]
    hits = tables.custom_findings(spark.createDataFrame([("f", "a\nfoo foo\n\nfooo")], "file string, content string"), own)
    assert sorted(r.line for r in hits.collect()) == [2, 2, 4]


def test_fix_report_text(spark, tmp_path):
    rows = [("a.py", 3, "SEC001", "FIXED", None, "PASSWORD", "Hardcoded"), ("b.py", 4, "SEC002", "REFUSED", "env_var_contract_not_found", "API_KEY", None), ("c.py", None, "PARSE_ERROR", "SKIPPED", None, None, "bad")]
    out = spark.createDataFrame(rows, "file string, line int, rule_id string, state string, reason string, env_var string, message string")
    tables.write_fix_report(out, str(tmp_path / "wet.txt"))
    body = [
        "  FIXED      SEC001   a.py:3  - Hardcoded", "  REFUSED    SEC002   b.py:4", "             suggested_env_var: API_KEY", "             Add to .env.example: API_KEY=", "  SKIPPED    PARSE_ERROR c.py  - bad", "",
        "Summary: 1 FIXED, 1 REFUSED, 1 SKIPPED", "", "Hint: add a .env.example to enable safe remediation", "",
    ]
    assert (tmp_path / "wet.txt").read_text().split("\n") == ["", "=== Auto-Fix Results ===", *body]
    tables.write_fix_report(out.filter("state = 'FIXED'"), str(tmp_path / "dry.txt"), dry_run=True)
    assert (tmp_path / "dry.txt").read_text() == "\n=== DRY RUN - no files modified ===\n  WOULD_FIX  SEC001   a.py:3  - Hardcoded\n\nSummary: 1 WOULD_FIX\n"


def test_evaluation(spark):
    rows = [("r", "f", "1", "S", "b", "", "false"), ("r", "f", "1", "S", "a", "", "false"), ("q", "f", "2", "S", "c", "", "no")]
    f = spark.createDataFrame(rows, "repo string, file string, line string, rule_id string, matched_value string, surrounding_context string, synthetic string")
    assert sorted(r.matched_value for r in evaluate.deduplicated(f).collect()) == ["a", "c"]
    assert [tuple(r) for r in evaluate.sampled(f, 2).collect()] == [tuple(r) for r in evaluate.sampled(f.repartition(3), 2).collect()]
    k = evaluate.kappa(spark.createDataFrame([("a", "a")] * 3, "x string, y string"), "x", "y").first()
    assert k.kappa == 1.0 and evaluate.kappa(spark.createDataFrame([], "x string, y string"), "x", "y").first().kappa is None
    e = evaluate.expectations(spark.createDataFrame([("a.py", 'x = 1\ny = 2  # EXPECT: SEC001\nz  # EXPECT: SUPPRESS')], "file string, content string"))
    found = spark.createDataFrame([("a.py", 3, "SEC002")], "file string, line int, rule_id string")
    assert sorted(r.outcome for r in evaluate.expectation_outcomes(e, found).collect()) == ["FALSE", "MISS"]
    n = evaluate.numbered(spark.createDataFrame([(f"f{i:02}", i, "S") for i in range(20)], "file string, line int, rule_id string").repartition(4)).orderBy("file").collect()
    assert [r.finding_id for r in n] == [f"S-{i:04d}" for i in range(1, 21)]


def test_windows_and_graph(spark):
    text = "Status: frozen\n```\n_(placeholder)_\n```\n_(placeholder)_ `_(placeholder)_`\n<!-- _(placeholder)_\n_(placeholder)_ -->\n`_(placeholder)_`"
    f = spark.createDataFrame([("a.md", text), ("b.md", "Status: draft\n_(placeholder)_")], "file string, content string")
    assert [(r.file, r.line) for r in windows.placeholders(windows.lines(f)).collect()] == [("a.md", 5)]
    code = spark.createDataFrame([("a.py", "import b.c\nimport os"), ("b/c.py", "from b import d"), ("b/__init__.py", ""), ("test_a.py", "import a")], "file string, content string")
    edges = graph.import_edges(code)
    assert sorted(map(tuple, edges.collect())) == [("a.py", "b/c.py"), ("b/c.py", "b/__init__.py"), ("test_a.py", "a.py")]
    hit = graph.impacted_tests(edges, spark.createDataFrame([("b/c.py",)], "file string"), F.col("node").startswith("test_"))
    assert [r.node for r in hit.collect()] == ["test_a.py"]


def test_streams(spark, tmp_path):
    rows = spark.sql("select concat('f', id % 3, '.py') file, 'token = \"q8Zk1vTr\"' content, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    s = events.stream_table(spark, str(tmp_path / "in"), "file string, content string, ts timestamp")
    q = events.stream_findings(s).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 3
    r = events.rate_limits(spark.read.parquet(str(tmp_path / "in")).withColumn("k", F.lit("a")), "k", limit=5).first()
    assert r.n == 9 and r.limited


def test_suspicious_matches(spark):
    text = 'x = 1\nauth_token = "0123456789"\ntoken =\n  "abcdefgh\nijkl" ; password="os.getenv(1)" password=\'12345678\'\nSECRET = "short"\nbearer = "tok_abcdefgh"'
    f = spark.createDataFrame([("a.py", text), ("b.py", None)], "file string, content string")
    got = [(r.line, r.n, r.hit) for r in evaluate.suspicious_matches(f).orderBy("line", "n", "at").collect()]
    assert got == [(2, 0, 'token = "0123456789"'), (2, 4, 'auth_token = "0123456789"'), (3, 0, 'token =\n  "abcdefgh\nijkl"'), (5, 7, "password='12345678'"), (7, 6, 'bearer = "tok_abcdefgh"')]
    found = spark.createDataFrame([("a.py", 7)], "file string, line int")
    assert [(r.line, r.hit) for r in evaluate.suspicious_lines(f, found).orderBy("line").collect()] == [(2, 'token = "0123456789"'), (3, 'token =\n  "abcdefgh\nijkl"'), (5, "password='12345678'")]


def test_fix_asks_the_policy(spark):
    rows = [("a.py", 'password = "q8Zk1vTr"\ntoken = "q8Zk1vTr"\n'), ("b.py", 'pwd = "q8Zk1vTr"\n'), ("c.py", "def f(:\n"), ("d.toml", 'password = "q8Zk1vTr"\n'), ("e.py", 'f(password=f"{x}-secret")\n')]
    f = spark.createDataFrame(rows, "file string, content string")
    found = flow.scan(f)
    out, rewrites = flow.fix(f, found)
    got = {(r.file, r.rule_id): (r.state, r.reason) for r in out.collect()}
    assert got == {
        ("a.py", "SEC001"): ("FIXED", None), ("a.py", "SEC002"): ("REFUSED", "preview_only"), ("b.py", "SEC001"): ("REFUSED", "preview_only"), ("c.py", "PARSE_ERROR"): ("REFUSED", "policy_block"),
        ("d.toml", "SEC001"): ("REFUSED", "refuse_unsupported_language"), ("e.py", "SEC001"): ("REFUSED", "preview_only"),
    }
    assert [(r.file, r.fixed_code) for r in rewrites.filter("any_fixed").collect()] == [("a.py", 'import os\npassword = os.environ["PASSWORD"]\ntoken = "q8Zk1vTr"\n')]
    r = flow.run_report("fix", f, out).first()
    assert (r.files, r.fixed, r.refused, r.parse_errors, r.exit_code) == (5, 1, 5, 1, 1)
    blocked, none = flow.fix(f, found, env_contract=False)
    assert none.isEmpty() and flow.run_report("fix", f, blocked).first().exit_code == 0
    assert {(r.file, r.state, r.reason) for r in blocked.filter("rule_id = 'SEC002'").collect()} == {("a.py", "REFUSED", "policy_block")}
    more = found.withColumn("col", found.col + 1)
    assert flow.merged_by_place(found, found.unionByName(more)).count() == 2 * found.count()


def test_long_chains_and_rows(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(55)] + [(55, 0)], "src int, dst int")
    got = graph.closure(e, spark.createDataFrame([(0,)], "root int"))
    assert got.count() == 56 and got.agg({"depth": "max"}).first()[0] == 55
    f = spark.createDataFrame([("a", "l1\nl2\nl3\nl4"), ("b", None)], "file string, content string")
    near = windows.lines_near(f, lambda t, n: t == "l3", 1)
    assert [(r.line, r.context) for r in windows.lines_with_context(f, 1).orderBy("line").collect()] == [(1, "l1\nl2"), (2, "l1\nl2\nl3"), (3, "l2\nl3\nl4"), (4, "l3\nl4")]
    assert sorted(r.line for r in near.collect()) == [2, 3, 4]


def test_custom_globs_and_comments(spark):
    own = tables.custom_rules("rules:\n  - id: A\n    pattern: 'foo+'\n    include: ['src/*']\n    exclude: src/x.py\n")
    f = spark.createDataFrame([("src/a.py", "foo # foo\n# foo\nbar foo foo"), ("src/x.py", "foo"), ("lib/a.py", "foo"), ("src/a.js", "// foo\n# foo")], "file string, content string")
    assert sorted((r.file, r.line) for r in tables.custom_findings(f, own).collect()) == [("src/a.js", 2), ("src/a.py", 1), ("src/a.py", 3), ("src/a.py", 3)]


def test_controls(spark):
    rows = controls.generate(spark, 20).collect()
    assert len({r.value for r in rows}) == len({r.control_id for r in rows}) == 20 * len(controls.FAMILIES)
    assert rows == controls.generate(spark, 20).repartition(5).orderBy("control_id").collect() or sorted(rows) == sorted(controls.generate(spark, 20).repartition(5).collect())
    for r in rows:
        parts = controls.FAMILIES[r.family]
        assert len(r.value) == sum(len(p) if isinstance(p, str) else p[1] for p in parts)
    assert controls.generate(spark, 20, seed=7).first().value != rows[0].value


def test_keys(spark):
    k = spark.createDataFrame([(1, 1, "2030-01-01", None), (2, 0, None, None), (3, 1, "2020-01-01", None), (4, 1, None, "10.0.0.1"), (5, 1, None, "10.0.0.2")], "id int, is_active int, expires_at string, allowed_ip string")
    assert [r.id for r in store.usable_keys(k, F.lit("2026-01-01"), F.lit("10.0.0.1")).orderBy("id").collect()] == [1, 4]
    c = spark.createDataFrame([("p", "r1", 1, 1), ("p", "r2", 2, 0)], "project_id string, rule_id string, priority int, enabled int")
    assert [r.rule_id for r in store.enabled_rules(c).collect()] == ["r1"]


def test_index_kinds(spark):
    paths = {"a/.env.local": ["config"], "x.env.prod": ["config"], "setup.cfg": ["config"], "a/setup_cfg": [], "t/test_a.py": ["code", "test"], "b_test.go": ["code", "test"], "c.kt": ["code"], "c.kts": [], "d/e.YAML": [], "docker-compose.yml": ["config"]}
    got = spark.createDataFrame([(p,) for p in paths], "file string").select("file", graph.index_kinds(F.col("file")).alias("k"))
    assert {r.file: r.k for r in got.collect()} == paths


def test_error_hints(spark):
    def expected(log):
        found = set()
        for pattern, hint in hints.HINTS:
            for m in re.findall(pattern, log or "", re.S):
                found.add(hints.PREFIX + (hint.format(*m) if isinstance(m, tuple) else hint.format(m)))
        return sorted(found)

    logs = ["", None, "TimeoutError\nTimeoutError SEC002", "assert 1 == 2 assert 3 == 4\nassert 1 == 2", "KeyError: 'a{0}'\nx 'b'", "AttributeError: 'NoneType' object has no attribute 'x'", "SyntaxError: bad\nmore", "TypeError: f() takes 1 positional arguments but 22 were given", "no error " * 5_000]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, log string").select("i", hints.error_hints(F.col("log")).alias("h"))
    assert {r.i: r.h for r in got.collect()} == {i: expected(x) for i, x in enumerate(logs)}
