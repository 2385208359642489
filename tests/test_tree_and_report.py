import json
import os
import unicodedata

import pytest

from auditloom.plans import report
from auditloom.sources import srctree

LIMITS = srctree.LIMITS


def tree(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")


def test_entries_and_reasons(tmp_path):
    tree(tmp_path, "a/b.py", "a.py", "a-b/c.py", "B.py", ".env", "_x.py", "node_modules/n/n.py", "x/tests/t.py", "tests/t.py", "r.md", "o.sarif", "a/venv")
    kept, left = srctree.discover(str(tmp_path), ["tests/**"], LIMITS)
    assert [p for p, _ in kept] == [".env", "B.py", "_x.py", "a/b.py", "a-b/c.py", "a.py"] and all(n == 1 for _, n in kept)
    assert left == {"a/venv": "ignored_directory", "node_modules": "ignored_directory", "o.sarif": "unsupported_or_generated_file", "r.md": "unsupported_or_generated_file", "tests": "exclude_paths", "x/tests": "exclude_paths"}
    assert srctree.discover(str(tmp_path / "a.py"), [], LIMITS) == ([("a.py", 1)], {})
    with pytest.raises(ValueError, match="not a kind"):
        srctree.discover(str(tmp_path / "r.md"), [], LIMITS)


@pytest.mark.parametrize("kind", ["link", "folder link", "fifo", "dangling"])
def test_special_entries_end_the_scan(tmp_path, kind):
    tree(tmp_path, "p/a.py", "q/b.py")
    at = tmp_path / "p" / "z.py"
    os.mkfifo(at) if kind == "fifo" else at.symlink_to({"link": tmp_path / "p/a.py", "folder link": tmp_path / "q", "dangling": "nowhere"}[kind])
    with pytest.raises(ValueError, match="neither"):
        srctree.discover(str(tmp_path / "p"), [], LIMITS)
    assert srctree.discover(str(tmp_path / "p"), ["z.py"], LIMITS)[1] == {"z.py": "exclude_paths"}
    (tmp_path / "l").symlink_to(tmp_path / "q")
    with pytest.raises(ValueError, match="symbolic"):
        srctree.discover(str(tmp_path / "l"), [], LIMITS)


@pytest.mark.parametrize("limit, value", [("maxEntries", 4), ("maxDepth", 2), ("maxTotalBytes", 2)])
def test_limits(tmp_path, limit, value):
    tree(tmp_path, "a/b/c/d.py", "e.py", "f.py")
    srctree.discover(str(tmp_path), [], {**LIMITS, "maxEntries": 7, "maxDepth": 4, "maxTotalBytes": 3})
    with pytest.raises(ValueError, match="exceeds"):
        srctree.discover(str(tmp_path), [], {**LIMITS, limit: value})


def test_a_file_that_changes_is_refused(tmp_path, monkeypatch):
    p = tmp_path / "a.py"
    p.write_text("one")
    assert srctree.read_stable(str(p), 10) == b"one"
    with pytest.raises(ValueError, match="exceeds"):
        srctree.read_stable(str(p), 2)
    original, calls = os.fstat, []

    def touched(fd):
        calls.append(fd)
        if len(calls) == 2:  # same size and time of change, another change of the inode
            s = original(fd)
            os.chmod(p, 0o600)
            os.utime(p, ns=(s.st_atime_ns, s.st_mtime_ns))
        return original(fd)

    monkeypatch.setattr(srctree.os, "fstat", touched)
    with pytest.raises(ValueError, match="changed"):
        srctree.read_stable(str(p), 10)


# -- renderings -------------------------------------------------------------

def test_escapes_of_every_character():
    for code in [*range(0x3000), 0xD800, 0xE000, 0xFEFF, 0xE0001, 0x1F600]:
        c = chr(code)
        control = unicodedata.category(c).startswith("C") and c not in "\n\t"
        assert report.display(c) == (f"\\u{code:04x}" if control else c)
    assert report.safe("a|b\nc <i> & \"q\" 'r' #1 *x* [y](z) \x1b\t") == "a&#124;b / c &lt;i&gt; &amp; &quot;q&quot; &\\#x27;r&\\#x27; \\#1 \\*x\\* \\[y\\]\\(z\\) \\\\u001b\t"


def finding(rule, severity="HIGH", steps=None, path="a b/c.py"):
    return {"id": f"h{rule}", "rule_id": rule, "article": "Art. 5", "severity": severity, "risk_tier": "high_risk", "title": f"t {rule} $x", "message": "m", "remediation": "r", "max_fine": "35 M", "confidence": 1.0,
            "location": {"file_path": path, "start_line": 3, "end_line": 4, "start_col": 0, "end_col": 7}, "code_snippet": None, "flow_steps": steps}


def sarif(findings, **kw):
    from auditloom.plans.scan import Report

    r = Report("s", "2026-01-01T00:00:00+00:00", "p", {}, findings, {}, [], "m", [], "f", "c", {}, {"n": "ignored_directory"})
    return json.loads(report.to_sarif(r, **kw))


def test_sarif_fields():
    step = {"step_type": "source", "message": "from $y", "location": {"file_path": "a b/c.py", "start_line": 1, "end_line": 1, "start_col": 2, "end_col": 5}, "code_snippet": "x"}
    doc = sarif([finding("GDPR-1"), finding("EUAIA-2", "INFO"), finding("GDPR-1", "LOW", [step]), finding("EUAIA-3", "MEDIUM"), finding("EUAIA-4", "CRITICAL")], information_uri="https://tool.example")
    run = doc["runs"][0]
    driver = run["tool"]["driver"]
    assert doc["version"] == "2.1.0" and driver["name"] == "auditloom" and driver["version"] and driver["informationUri"] == "https://tool.example"
    assert [r["id"] for r in driver["rules"]] == ["GDPR-1", "EUAIA-2", "EUAIA-3", "EUAIA-4"] and driver["rules"][0]["name"] == "GDPR_1"
    assert [r["ruleIndex"] for r in run["results"]] == [0, 1, 0, 2, 3]
    assert [r["level"] for r in run["results"]] == ["error", "none", "note", "warning", "error"]
    one = run["results"][0]
    assert one["message"]["text"] == "[Art. 5] t GDPR-1 $x. r (Maximum fine, for reference: 35 M)" and one["partialFingerprints"] == {"sha256": "hGDPR-1"}
    assert one["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a%20b/c.py"}, "region": {"startLine": 3, "endLine": 4, "startColumn": 1, "endColumn": 8, "snippet": {"text": ""}}}
    flow = run["results"][2]["codeFlows"][0]["threadFlows"][0]["locations"][0]
    assert flow["location"]["message"]["text"] == "SOURCE: from $y" and flow["location"]["physicalLocation"]["region"]["startColumn"] == 3 and "codeFlows" not in one
    assert run["invocations"] == [{"executionSuccessful": True, "endTimeUtc": "2026-01-01T00:00:00+00:00"}] and run["properties"]["exclusions"] == {"n": "ignored_directory"}
    assert sarif([])["runs"][0]["results"] == [] and "informationUri" not in sarif([])["runs"][0]["tool"]["driver"]
