import json
import os
import threading
import time
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from auditloom.functions import ed25519
from auditloom.operators import findings as fd
from auditloom.operators import match
from auditloom.plans import console, evidence, report
from auditloom.plans import rules as rl
from auditloom.plans import scan as sc


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("console")
    (root / "a.py").write_text("import deepface\nDeepFace.analyze(x, actions=['emotion'])\napi = '<b>'\n")
    (root / "sub").mkdir()
    (root / "sub" / "b.py").write_text("x = 1\n")
    return root


@pytest.fixture(scope="module")
def served(spark, project):
    c = console.Console(spark, str(project))
    c.warm()
    seconds, console.LIMITS["seconds"] = console.LIMITS["seconds"], 600.0  # these tests are not about this machine's speed
    server = console.serve(c)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield c, f"http://127.0.0.1:{server.server_address[1]}"
    console.LIMITS["seconds"] = seconds
    server.shutdown()
    server.server_close()


def fetch(url, body=None, **headers):
    data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
    try:
        with urlopen(Request(url, data, {"Content-Type": "application/json", **headers}), timeout=700) as r:
            return r.status, r.headers, r.read()
    except HTTPError as e:
        return e.code, e.headers, e.read()


def test_operations_over_http(served, project):
    c, url = served
    status, headers, body = fetch(url + "/api/scan?format=sarif")
    run = json.loads(body)["runs"][0]
    assert status == 200 and headers["X-Content-Type-Options"] == "nosniff" and len(run["results"]) >= 1
    status, _, body = fetch(url + "/api/scan", {"path": "sub"})
    assert status == 200 and json.loads(body)["summary"]["total_findings"] == 0
    status, headers, body = fetch(url + "/")
    assert status == 200 and b"EUAIA-ART05-001" in body and "text/html" in headers["Content-Type"] and b"<script" not in body
    assert b"Section 9" in fetch(url + "/api/docgen", {"system": "S"})[2]
    assert json.loads(fetch(url + "/api/assess", {"role": "provider", "is_ai": True, "eu_scope": True, "transparency": True})[2])["risk_tier"] == "limited_risk"
    seed = b"k" * 32
    bundle = evidence.sign_report(sc.scan_path(c.spark, str(project)), seed, "me")
    given = json.loads(json.dumps(bundle))
    assert json.loads(fetch(url + "/api/verify", {"bundle": given, "public_key": ed25519.public_key(seed).hex()})[2]) == {"valid": True, "reason": "valid"}
    assert json.loads(fetch(url + "/api/verify", {"bundle": {**given, "signer": "you"}, "public_key": ed25519.public_key(seed).hex()})[2])["valid"] is False


@pytest.mark.parametrize("path, body, headers, status", [
    ("/api/none", None, {}, 404), ("/api/docgen", None, {}, 405), ("/api/scan", {"path": "../.."}, {}, 403), ("/api/scan", {"path": "none"}, {}, 422), ("/api/scan", {"format": "exe"}, {}, 400),
    ("/api/scan", b"[1]", {}, 400), ("/api/scan", b'{"a": 1, "a": 2}', {}, 400), ("/api/scan", b"{", {}, 400), ("/api/scan", b'{"a": ' + b"[" * 40 + b"]" * 40 + b"}", {}, 413), ("/api/scan", b'{"a": [' + b"1," * 100_001 + b"1]}", {}, 413),
    ("/api/scan", b" " * ((2 << 20) + 1), {}, 413), ("/api/scan", b"{}", {"Content-Type": "text/plain"}, 415), ("/api/scan", None, {"Host": "evil.example"}, 403), ("/api/assess", {"role": "nobody"}, {}, 422), ("/api/assess", {"what": True}, {}, 422), ("/api/assess", {"is_ai": "yes"}, {}, 422), ("/api/verify", {"bundle": {}}, {}, 400),
])
def test_requests_are_refused(served, path, body, headers, status):
    got, _, answer = fetch(served[1] + path, body, **headers)
    assert got == status and "error" in json.loads(answer)


def test_job_and_answer_limits(served, monkeypatch):
    c, _ = served
    monkeypatch.setitem(console.LIMITS, "answer", 10)
    assert c.answer("GET", "/api/scan").status == 413
    monkeypatch.setitem(console.LIMITS, "seconds", 0.0)
    assert c.answer("GET", "/api/scan").status == 503


def test_a_late_job_is_cancelled(served, spark, monkeypatch):
    c, _ = served
    began, ended = threading.Event(), []

    def slow(values):
        try:
            for _ in range(3):  # a cancelled job must not be followed by others
                began.set()
                spark.range(1 << 40).selectExpr("sum(id % 7)").collect()
        except Exception as e:
            ended.append(e)
            raise

    monkeypatch.setitem(c.routes, ("GET", "/slow"), slow)
    monkeypatch.setitem(console.LIMITS, "seconds", 3.0)
    assert c.answer("GET", "/slow").status == 503 and began.is_set()
    until = time.monotonic() + 120
    while not ended and time.monotonic() < until:
        time.sleep(0.2)
    assert ended and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_questions(spark):
    replies = iter(["triage", "boss", "provider", "y", "yes", "maybe", "n", "?", "", "n", "n", "n", "y", "n", "n", "n"])
    answers = console.asked(lambda q: next(replies))
    assert answers["role"] == "provider" and answers["prohibited_practice"] is False and answers["annex_i_product"] is None and answers["transparency"] is True
    text = console.to_text(console.assessed(spark, answers))
    assert text.startswith("Tier: limited_risk") and "annex_i_product" in text and "Art. 50" in text


# -- budgets, rule folders, build outputs -----------------------------------

def custom(target):
    base = {k: v for k, v in rl.builtin().rules[0].items()}
    return rl.Catalog([{**base, "id": "TEST-GEN-001", "patterns": [{"type": "regex", "target": target}]}])


def test_a_slow_pattern_ends_the_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a" * 40 + "!\n")
    with pytest.raises(Exception, match="budget"):
        sc.scan_path(spark, str(tmp_path), custom("^(a|aa)+$"))
    assert sc.scan_path(spark, str(tmp_path), custom("a!")).summary["total_findings"] == 1


def test_too_many_matches_end_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(match, "MATCH_BUDGET", 50)
    (tmp_path / "a.txt").write_text("verify = False\n" * 60)
    with pytest.raises(ValueError, match="matches"):
        sc.scan_path(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("verify = False\n" * 40 + "x\n" * 100)
    assert sc.scan_path(spark, str(tmp_path)).summary["total_findings"] == 40


RULE = "id: TEST-GEN-001\narticle: Art. 1\ntitle: A custom rule\nseverity: LOW\nrisk_tier: minimal_risk\ndescription: a description\npatterns:\n  - {type: ast_function_def, target: load}\n"


def test_rule_folders(tmp_path, monkeypatch):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "r.yml").write_bytes(b"\xef\xbb\xbf" + RULE.encode())
    (tmp_path / "a.yaml").write_text(RULE.replace("001", "002"))
    (tmp_path / "notes.txt").write_text("x")
    assert rl.from_dir(tmp_path).ids() == ["TEST-GEN-002", "TEST-GEN-001"]
    (tmp_path / "c.yaml").write_text("- id: X-1\n  title: t\n")
    with pytest.raises(rl.CatalogError, match=r"c\.yaml \("):
        rl.from_dir(tmp_path)
    (tmp_path / "c.yaml").unlink()
    monkeypatch.setitem(rl.LIMITS, "file", 10)
    with pytest.raises(rl.CatalogError, match="exceeds"):
        rl.from_dir(tmp_path)
    monkeypatch.undo()
    for make in (lambda p: p.symlink_to(tmp_path / "a.yaml"), lambda p: os.mkfifo(p)):
        make(tmp_path / "z.yaml")
        with pytest.raises(rl.CatalogError, match="neither"):
            rl.from_dir(tmp_path)
        (tmp_path / "z.yaml").unlink()
    with pytest.raises(rl.CatalogError):
        rl.from_dir(tmp_path / "none")


def log(n, ok=True):
    return json.dumps({"runs": [{"results": [{"ruleId": "a"}] * n, "invocations": [{"executionSuccessful": ok}]}]})


@pytest.mark.parametrize("code, sarif, form, want", [
    (0, log(0), "sarif", ("no_findings", "0", "true")), (1, log(2), "sarif", ("violations_found", "2", "true")), (0, log(2), "sarif", ("violations_found", "2", "true")), (1, log(0), "sarif", ("error", "", "false")), (2, log(0), "sarif", ("error", "", "false")),
    (0, None, "sarif", ("error", "", "false")), (0, "", "sarif", ("error", "", "false")), (0, "not json", "sarif", ("error", "", "false")), (0, "{}", "sarif", ("error", "", "false")), (0, "[]", "sarif", ("error", "", "false")), (0, log(1, False), "sarif", ("error", "", "false")),
    (0, None, "json", ("completed", "", "false")), (1, None, "markdown", ("violations_found", "", "false")), (3, None, "json", ("error", "", "false")),
])
def test_build_outputs(spark, code, sarif, form, want):
    assert tuple(fd.ci_outputs(spark, code, sarif, form).values()) == want


def test_listing_escapes():
    r = sc.Report("s", "t", "<p>", {"total_files_scanned": 1}, [{"severity": "LOW", "rule_id": "R", "title": "<i>", "location": {"file_path": "a\x1b<", "start_line": 1}, "code_snippet": "</pre><script>", "remediation": "&"}], {}, [], "", [], "", "", {}, {})
    page = report.to_html(r)
    assert "<script" not in page and "<i>" not in page and "\\u001b" in page and "&lt;/pre&gt;" in page
