import ast
import json
import os

import pytest
from pyspark.sql import functions as F

from auditloom.functions import cfg, ed25519, manifests, pyfacts, requirements, taint
from auditloom.functions.text import finding_hash, java_regex, json_string, lines, suppressed
from auditloom.operators import facts as ft
from auditloom.operators import findings as fd
from auditloom.operators import match
from auditloom.plans import corpus, evidence, report
from auditloom.plans import rules as rl
from auditloom.plans import scan as sc
from auditloom.plans.config import Config, load_config
from auditloom.sources.srctree import SourceTree, scannable
from auditloom.streaming.watch import text_findings

LINES = ["", "\n", "a", "a\n", "a\r\nb", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b", "a\u2028b\u2029", "\n\n", "a\r", "é😀\r\n\r\nx"]


def test_lines_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", lines(F.col("t"))).collect()}
    assert got == {i: t.splitlines() for i, t in enumerate(LINES)}


def test_json_strings_equal_python(spark):
    texts = ['a"b\\c', "tab\tnl\ncr\r", "\x01\x7f", "é ñ", "😀", "", "\b\f/"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_string(F.col("t"))).collect()]
    assert got == [json.dumps(t) for t in texts]


def test_finding_hash_by_definition(spark):
    import hashlib

    snippet, path = "  x = 'é'\r\n  y\t", "a\\b.py"
    row = spark.createDataFrame([(path, snippet)], "p string, s string").select(finding_hash(F.lit(" gdpr-art05-001"), F.col("p"), F.lit(3), F.lit(4), F.lit(" t "), F.col("s"))).first()[0]
    payload = {"rule_id": "GDPR-ART05-001", "file_path": "a/b.py", "start_line": 3, "end_line": 4, "target": "t", "snippet_normalized": "x = 'é'\n  y"}
    assert row == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


@pytest.mark.parametrize("line, strip, want", [("x # auditloom:ignore A-1 b-2,", ",;", ["A-1", "B-2"]), ("auditloom:ignore A-1,B-2", ",;", ["A-1,B-2"]), ("// auditloom:ignore A-1 */", ",;#/", ["A-1", "*"]), ("auditloom:ignore", ",;", []), ("none", ",;", []), ("auditloom:ignore A auditloom:ignore B", ",;", ["A"])])
def test_suppression_tokens(spark, line, strip, want):
    assert spark.createDataFrame([(line,)], "t string").select(suppressed(F.col("t"), strip=strip)).first()[0] == want


def test_java_patterns_agree_with_python(spark):
    import re

    texts = ["api_key\u00a0=\u2003'abcdefghijklmnop12'", "api_key\x1f= 'abcdefghijklmnop12'", "verıfy=False", "VERIFY\t=\tfalse", "é12345678Z", "x12345678Z", "4111111111111111", "é4111111111111111", "１２345678Z", "base_url='http://localhost' base_url='http://h'", "ſkip_data_validation", "log_raw_payload=True", "prompt = f'{user_input}'", "return r.choices[0].message.content"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, _, r, p in rl.builtin().patterns("regex"):
        got = [x[0] for x in df.select(F.col("t").rlike(java_regex(p["target"]))).collect()]
        assert got == [bool(re.search(p["target"], t)) for t in texts], r["id"]


def test_match_places_are_code_points(spark):
    df = spark.createDataFrame([("a.txt", "😀é verify = False x")], "path string, text string")
    native, python = (match.regex_findings(df, rl.builtin(), p).select("rule_id", "start_col", "end_col").collect() for p in (False, True))
    assert native == python and (native[0]["start_col"], native[0]["end_col"]) == (3, 17)


# -- taint ------------------------------------------------------------------

SPEC = {"sources": ["model.generate"], "sanitizers": ["guard.clean"], "sinks": ["os.system"]}


def hits(body):
    tree = ast.parse("async def f(flag):\n" + "\n".join("    " + x for x in body.split("\n")))
    r = pyfacts.read(tree)
    return taint.flows(tree, [SPEC], r.calls, {x.node: x.spelling for x in r.facts if x.kind == "call"})


@pytest.mark.parametrize("body", [
    "a = model.generate()\nos.system(a)", "os.system('x' + model.generate())", "a = {}\na['k'] = await model.generate()\nos.system(a)", "a, *b = model.generate()\nos.system(b)",
    "x.y = model.generate()\nos.system(x.y)", "a = f'{model.generate()}'\nos.system(a)", "a = 1 if flag else model.generate()\nos.system(a)", "with open(model.generate()) as a:\n    os.system(a)",
    "a = ''\nfor i in r:\n    os.system(a)\n    b = a or model.generate()\n    a = b", "a = model.generate()\nwhile flag:\n    a = ''\nos.system(a)", "try:\n    a = model.generate()\n    go()\nexcept E:\n    os.system(a)",
    "a = model.generate()\ntry:\n    return 1\nfinally:\n    os.system(a)", "a = model.generate()\nguard.clean(a)\nos.system(a)", "match flag:\n    case 1 if os.system(model.generate()):\n        pass", "a = [g for g in model.generate()]\nos.system(a)",
])
def test_flows_are_found(body):
    found = hits(body)
    assert len(found) == 1 and [found[0].steps[0].kind, found[0].steps[-1].kind] == ["source", "sink"]


@pytest.mark.parametrize("body", [
    "a = model.generate()\na = ''\nos.system(a)", "a = model.generate()\nos.system(guard.clean(a))", "a = model.generate()\ndel a\nos.system(a)", "a = ''\nos.system(a)",
    "a = model.generate()\nraise E\nos.system(a)", "a = model.generate()\nx.os.system(b)", "a = model.generate()\na.b.system()", "while flag:\n    a = model.generate()\n    try:\n        continue\n    finally:\n        a = ''\nos.system('x')", "f = lambda: model.generate()\nos.system(f)", "model.generator()\na = model.generates()\nos.system(a)",
])
def test_clean_bodies_stay_clean(body):
    assert hits(body) == []


def test_lattice_join_laws():
    for a in taint.LATTICE:
        assert taint.worse(a, a) == a
        for b in taint.LATTICE:
            assert taint.worse(a, b) == taint.worse(b, a)
            for c in taint.LATTICE:
                assert taint.worse(a, taint.worse(b, c)) == taint.worse(taint.worse(a, b), c)


def test_control_flow_keeps_finally_ways_apart():
    g = cfg.build(ast.parse("while f:\n    try:\n        break\n    finally:\n        c()\n    d()\ne()").body)
    calls = [line for n, kind, line, _ in g.nodes if kind == "expr"]
    assert calls == [5, 7] and all(a < len(g.nodes) and b < len(g.nodes) for a, b in g.edges) and g.order()[0] == 0


def test_aliases_and_scopes():
    src = "import openai as ai\nc = ai.OpenAI()\nd = c\ndef f(c):\n    c.go()\nd.chat.create(n=1, xs=['a', 2])\nc()\n"
    calls = {(f.node.lineno, f.name): f.values for f in pyfacts.read(ast.parse(src)).facts if f.kind == "call"}
    assert (5, "c.go") in calls and (7, "c") in calls and calls[6, "openai.OpenAI.chat.create"] == {"n": 1, "xs": ["a", 2]}


# -- manifests and validation -----------------------------------------------

@pytest.mark.parametrize("line", ["a", "a[b,c]>=1,<2", "a @ https://x/y", "a; python_version < '3.9' and extra == 'x'", "-r other.txt", "-e .", "--pre", "--index-url=https://x", "git+https://h/r#egg=a", "a==1 --hash=sha256:ab", "", "# x"])
def test_requirement_lines_accepted(line):
    requirements.line(line)


@pytest.mark.parametrize("line", ["-r ../x.txt", "-r /x", "--pre yes", "--what", "a >> 1", "a; os.system('x')", "a; nothing == '1'", "a==1 --hash=md5:ab", "!a", "--index-url"])
def test_requirement_lines_rejected(line):
    with pytest.raises((ValueError, SyntaxError)):
        requirements.line(line)


BAD = [("a.py", "def f(:"), ("b.py", "x\0"), ("pyproject.toml", "[project]\ndependencies = 'x'"), ("uv.lock", "[[package]]\nversion = '1'"), ("Pipfile.lock", '{"default": {}, "default": {}}'), ("Pipfile", "packages = 1"), ("compose.yml", "services: [1]"), ("compose.yml", "services:\n  a:\n    privileged: 'yes'"), ("compose.yml", "a: 1\na: 2\nservices: {}"), ("requirements.txt", "-r missing.txt")]


@pytest.mark.parametrize("name, text", BAD)
def test_malformed_sources_are_reported(spark, name, text):
    df = spark.createDataFrame([("ok.py", "x = 1"), (f"d/{name}", text)], "path string, text string")
    assert [r["path"] for r in ft.validation_errors(df).collect()] == [f"d/{name}"]


def test_compose_anchors_and_budgets():
    assert [s["privileged"] for s in manifests.services("x: &b\n  privileged: true\nservices:\n  a: *b\n  c:\n    <<: *b\n")] == [True, True]
    with pytest.raises(ValueError):
        manifests.services("services: " + "[" * 70 + "]" * 70)


# -- scan -------------------------------------------------------------------

def template_sources(spark, order=1):
    rows = [(f"t{i:02}/{n}", c) for i, (n, c, _) in enumerate(corpus.TEMPLATES)][::order]
    return spark.createDataFrame(rows, "path string, text string")


WANT = sorted((f"t{i:02}/{n}", r, line) for i, (n, _, labels) in enumerate(corpus.TEMPLATES) for r, line in labels)


@pytest.mark.parametrize("order, parts", [(1, 1), (-1, 5)])
def test_exact_findings_whatever_the_order(spark, order, parts):
    got = sc.scan(template_sources(spark, order).repartition(parts), rl.builtin()).select("path", "rule_id", "start_line").collect()
    assert sorted(map(tuple, got)) == WANT


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, text string")
    found = sc.scan(none, rl.builtin())
    assert found.count() == 0
    assert fd.scan_id(found).first()[0] == __import__("hashlib").sha256(fd.EMPTY.encode()).hexdigest()
    assert {r["findings"] for r in fd.counts_by(found, "risk_tier").collect()} == {0}
    assert fd.overall_risk(found).first()[0] == "minimal_risk" and fd.gate(found, None).first()[0]


def test_source_tree(spark, tmp_path):
    for name, text in (("a/b.py", "x"), ("a.py", "x"), ("a-b/c.py", "x"), (".env", "k"), ("_x.py", "x"), ("node_modules/n.py", "x"), ("tests/t.py", "x"), ("r.md", "x"), ("o.sarif", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    raw, left = sc.read_tree(spark, str(tmp_path), Config())
    assert sorted(r["path"] for r in raw.collect()) == sorted(["a/b.py", "a.py", "a-b/c.py", ".env", "_x.py"])
    assert {r["path"]: r["reason"] for r in left.collect()} == {"node_modules": "ignored_directory", "tests": "exclude_paths", "r.md": "unsupported_or_generated_file", "o.sarif": "unsupported_or_generated_file"}
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    with pytest.raises(Exception, match="neither file nor folder|symbolic"):
        raw2, _ = sc.read_tree(spark, str(tmp_path), Config())
        raw2.collect()
    assert scannable("X.Dockerfile") and scannable(".env.local") and not scannable("a.java")


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for n, c, _ in corpus.TEMPLATES:
        if n in ("shell_agent.py", "people.js", "compose.yml"):
            (root / n).write_text(c)
    (root / ".auditloom.yaml").write_text("ignore_rules: [GDPR-ART05-003]\n")
    return root


def test_report_and_evidence(spark, project, tmp_path):
    r = sc.scan_path(spark, str(project))
    again = sc.scan_path(spark, str(project))
    assert r.scan_id == again.scan_id and r.findings == again.findings
    assert {f["rule_id"] for f in r.findings} == {"EUAIA-ART12-001", "EUAIA-ART14-002", "GDPR-ART05-002", "EUAIA-ART15-005", "EUAIA-ART15-006"}
    assert r.summary["total_files_scanned"] == 4 and sum(r.summary["findings_by_tier"].values()) == len(r.findings)
    assert sc.exit_code(r) == 1 and sc.exit_code(r, "prohibited") == 0
    sarif = json.loads(report.to_sarif(r))
    run = sarif["runs"][0]
    assert all(run["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in run["results"])
    assert any("codeFlows" in x for x in run["results"])
    assert fd.result_counts(spark, json.dumps(sarif)) == {"findings_count": len(r.findings), "completed": True}
    for name, render in report.RENDERERS.items():
        report.write_report(str(tmp_path / name), render(r))
    key, pub = evidence.generate_keypair(tmp_path, "k")
    assert oct(key.stat().st_mode)[-3:] == "600"
    bundle = evidence.sign_report(r, key, "me")
    assert evidence.verify_bundle(json.dumps(bundle), pub) == (True, "valid")
    for change in ({"signer": "you"}, {"signature": bundle["signature"][:-4] + "AAA="}, {"extra": 1}, {"report": {**bundle["report"], "findings": bundle["report"]["findings"][:-1]}}, {"signed_at": "2026-01-01T00:00:00"}):
        assert not evidence.verify_bundle({**bundle, **change}, pub)[0]
    assert not evidence.verify_bundle(bundle, ed25519.public_key(b"x" * 32))[0]


def test_one_bad_file_fails_the_scan(spark, project, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.py").write_text("def f(:")
    with pytest.raises(ValueError, match="b.py"):
        sc.scan_path(spark, str(tmp_path))


def test_configuration(tmp_path):
    assert load_config(str(tmp_path)) == Config()
    (tmp_path / "auditloom.yaml").write_text("exclude_paths: 3\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path))
    (tmp_path / "auditloom.yaml").write_text("custom_rules_dir: ../x\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path))


def test_catalog(tmp_path):
    b = rl.builtin()
    assert len(b.rules) == 26 and sum(len(r["patterns"]) for r in b.rules) == 54
    assert {"GDPR-ART05-001", "EUAIA-ART05-001"} <= set(b.for_articles({"Art. 05"}).ids()) and "EUAIA-ART50-002" not in b.for_articles({"5"}).ids()
    with pytest.raises(rl.CatalogError):
        rl.Catalog([b.rules[0], b.rules[0]])
    with pytest.raises(rl.CatalogError):
        rl.Catalog([{**b.rules[1], "patterns": [{"type": "regex", "target": "("}]}])
    (tmp_path / "r.yaml").write_text("id: TEST-GEN-001\narticle: Art. 1\ntitle: A custom rule\nseverity: LOW\nrisk_tier: minimal_risk\ndescription: a description\npatterns:\n  - {type: ast_function_def, target: load}\n")
    assert rl.from_dir(tmp_path).ids() == ["TEST-GEN-001"]


def test_stream_of_sources(spark, tmp_path):
    template_sources(spark).write.parquet(str(tmp_path / "in"))
    q = text_findings(spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in")), rl.builtin()).writeStream.format("memory").queryName("watch").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = text_findings(template_sources(spark), rl.builtin())
    assert sorted(map(tuple, spark.table("watch").collect())) == sorted(map(tuple, batch.collect())) != []


def test_command_line(spark, project, tmp_path, capsys):
    from auditloom.__main__ import main

    assert main(["scan", str(project), "--format", "sarif", "--output", str(tmp_path / "o.sarif")]) == 1
    assert json.loads((tmp_path / "o.sarif").read_text())["runs"][0]["results"]
    assert main(["scan", str(project), "--fail-on", "prohibited"]) == 0
    assert main(["keygen", str(tmp_path), "cli"]) == 0 and main(["keygen", str(tmp_path), "cli"]) == 2
    assert main(["scan", str(project), "--sign", str(tmp_path / "cli.key"), "--signer", "me", "--output", str(tmp_path / "b.json")]) == 1
    assert main(["verify", str(tmp_path / "b.json"), str(tmp_path / "cli.pub")]) == 0
    (tmp_path / "a.json").write_text('{"role": "provider", "is_ai": true, "eu_scope": true, "transparency": true}')
    capsys.readouterr()
    assert main(["assess", str(tmp_path / "a.json")]) == 0 and json.loads(capsys.readouterr().out)["risk_tier"] == "limited_risk"
    assert main(["docgen", str(project), "--output", str(tmp_path / "d.md")]) == 0 and "Section 9" in (tmp_path / "d.md").read_text()
    assert main(["scan", str(tmp_path / "missing")]) == 2


def test_hard_links_can_be_refused(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    os.link(tmp_path / "a.py", tmp_path / "b.py")
    spark.dataSource.register(SourceTree)
    assert spark.read.format("srctree").option("path", str(tmp_path)).load().count() == 2
    with pytest.raises(Exception, match="regular"):
        spark.read.format("srctree").option("path", str(tmp_path)).option("singleLink", "true").load().collect()
