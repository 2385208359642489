"""Renderings of a report: JSON, Markdown, SARIF, a technical dossier, a terminal table."""

from __future__ import annotations

import html
import json
import os
import tempfile
import unicodedata
from string import Template
from urllib.parse import quote

from .. import __version__
from .scan import Report

TOOL = "auditloom"
#: SARIF levels by severity.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "none"}
_HELP = {"GDPR": "https://eur-lex.europa.eu/eli/reg/2016/679/oj", "": "https://eur-lex.europa.eu/eli/reg/2024/1689/oj"}
_KNOWN = {"openai": "OpenAI SDK", "torch": "PyTorch", "langchain": "LangChain", "transformers": "Hugging Face Transformers", "logging": "logging (import only)"}


class _Escapes(dict):
    """A table for str.translate: what is not written in it is a control character's code or stays."""

    def __missing__(self, code: int) -> str | int:
        self[code] = out = f"\\u{code:04x}" if unicodedata.category(chr(code))[0] == "C" else code
        return out


#: Line feed and tab stay; in one line of Markdown, markup's characters are entities or
#: escaped, the number sign of an entity too.
_VISIBLE = _Escapes({ord(c): c for c in "\n\t"})
_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&\\#x27;", "|": "&#124;", "\n": " / "}
_INLINE = _Escapes({ord(c): t for c, t in _ENTITIES.items()} | {ord(c): "\\" + c for c in "\\`*_[]{}()#+~"} | {ord("\t"): "\t"})


def display(text: str) -> str:
    """Control characters as escapes, but for line feed and tab."""
    return text.translate(_VISIBLE)


def safe(text: str) -> str:
    """One line that neither HTML nor Markdown reads as markup."""
    return display(text).translate(_INLINE)


def to_json(report: Report) -> str:
    return json.dumps(report.as_dict(), indent=2, ensure_ascii=False)


def to_markdown(report: Report, evidence: bool = False) -> str:
    s = report.summary
    out = ["# Technical compliance review", "", "> Applicability and legal class need human review; fines are references.", ""]
    out += [f"**{k}:** {safe(v)}" for k, v in (("Target", report.target_path), ("Scan", report.scan_id), ("Sources", report.source_manifest_hash), ("Rules", report.rules_fingerprint), ("Configuration", report.config_fingerprint))]
    out += ["", "## Scope", *(f"- {k}: {v}" for k, v in (("Files", s["total_files_scanned"]), ("Lines", s["total_lines_scanned"]), ("Rules", s["rules_loaded"]), ("Excluded paths", len(report.exclusions)), ("Findings", s["total_findings"])))]
    out += ["", "## Limitations", *(f"- {safe(x)}" for x in report.limitations), ""]
    if not report.findings:
        out.append("**No findings in this scope. This does not show conformity.**")
    for n, f in enumerate(report.findings, 1):
        place = f["location"]
        out += [f"## {n}. {safe(f['rule_id'])}: {safe(f['title'])}", f"- Severity {f['severity']}, confidence {f['confidence']}, tier {f['risk_tier']}", f"- Reference: {safe(f['article'])}", f"- Place: {safe(place['file_path'])}:{place['start_line']}", f"- {safe(f['message'])}", f"- Remedy: {safe(f['remediation'])}", f"- Maximum fine: {safe(f['max_fine'])}"]
        if f["code_snippet"]:
            out += ["", f"<pre>{html.escape(display(f['code_snippet']))}</pre>"]
        if evidence:
            out.append(f"- Digest: {f['id']}")
        out.append("")
    return "\n".join(out)


# -- SARIF ------------------------------------------------------------------
#
# The document is a form: its strings with a leading $ name a column of the row that fills it, with
# $* a column whose value is taken as it is, whatever its type; other values stand as they are.

_REGION = {"physicalLocation": {"artifactLocation": {"uri": "$uri"}, "region": {"startLine": "$*start_line", "endLine": "$*end_line", "startColumn": "$*first", "endColumn": "$*last", "snippet": {"text": "$snippet"}}}}
_STEP = {"location": {"message": {"text": "$kind: $message"}, **_REGION}, "nestingLevel": 0}
_RULE = {"id": "$rule_id", "name": "$name", "shortDescription": {"text": "$title"}, "fullDescription": {"text": "$message"}, "helpUri": "$help", "properties": {k: f"$*{k}" for k in ("article", "risk_tier", "max_fine", "remediation")}}
_RESULT = {"ruleId": "$rule_id", "ruleIndex": "$*rule_index", "level": "$level", "message": {"text": "[$article] $title. $remediation (Maximum fine, for reference: $max_fine)"}, "locations": "$*locations", "partialFingerprints": {"sha256": "$id"}}
_RUN = {"tool": {"driver": "$*driver"}, "invocations": [{"executionSuccessful": True, "endTimeUtc": "$timestamp"}], "results": "$*results",
        "properties": {"legalAssessment": "$legal_assessment", "limitations": "$*limitations", "sourceManifestHash": "$source_manifest_hash", "rulesFingerprint": "$rules_fingerprint", "configFingerprint": "$config_fingerprint", "exclusions": "$*exclusions"}}
_DOCUMENT = {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": "$*runs"}


def _filled(form: object, row: dict) -> object:
    if isinstance(form, dict):
        return {k: _filled(v, row) for k, v in form.items()}
    if isinstance(form, list):
        return [_filled(v, row) for v in form]
    if isinstance(form, str):
        return row[form[2:]] if form.startswith("$*") else Template(form).substitute(row)
    return form


def _located(place: dict, snippet: str | None) -> dict:
    """Columns of a place; SARIF counts columns from one."""
    return {**place, "uri": quote(place["file_path"].replace("\\", "/"), safe="/"), "first": place["start_col"] + 1, "last": place["end_col"] + 1, "snippet": snippet or ""}


def sarif_rows(findings: list[dict]) -> tuple[list[dict], list[dict]]:
    """(rules, findings) as rows that the forms take: rules in the order in which findings first name them."""
    first: dict[str, dict] = {}
    for f in findings:
        first.setdefault(f["rule_id"], f)
    index = {rule: k for k, rule in enumerate(first)}
    rules = [{**f, "name": rule.replace("-", "_"), "help": next(u for k, u in _HELP.items() if rule.startswith(k))} for rule, f in first.items()]
    return rules, [{**f, "rule_index": index[f["rule_id"]], "level": LEVELS[f["severity"]]} for f in findings]


def to_sarif(report: Report, information_uri: str | None = None) -> str:
    """SARIF 2.1.0. information_uri: where readers of the report find the tool."""
    rules, rows = sarif_rows(report.findings)
    results = []
    for r in rows:
        here = _filled(_REGION, _located(r["location"], r["code_snippet"]))
        steps = [_filled(_STEP, {**_located(s["location"], s["code_snippet"]), "kind": s["step_type"].upper(), "message": s["message"]}) for s in r["flow_steps"] or ()]
        flow = {"codeFlows": [{"threadFlows": [{"locations": steps}]}]} if steps else {}
        results.append({**_filled(_RESULT, {**r, "locations": [here]}), **flow})
    driver = {"name": TOOL, "version": __version__, **({"informationUri": information_uri} if information_uri else {}), "rules": [_filled(_RULE, r) for r in rules]}
    run = _filled(_RUN, {**report.as_dict(), "driver": driver, "results": results})
    return json.dumps({k: [run] if k == "runs" else v for k, v in _DOCUMENT.items()}, indent=2, ensure_ascii=False)


#: The nine points of Annex IV, and what each asks for.
_SECTIONS = [("General description", "Purpose, provider, versions, users, interfaces and instructions."), ("Development and components", "Design, third parties, data, training, tests, oversight and security."), ("Monitoring and logs", "Capabilities, limits, foreseeable risks and input specifications."),
             ("Performance metrics", "Why these metrics fit, thresholds and robustness."), ("Risk management", "Hazards, residual risks, controls and owners."), ("Lifecycle changes", "History, approvals and revalidation."), ("Standards", "Standards that were really applied, and alternatives."),
             ("Declaration of conformity", "A copy of the declaration; this draft issues none."), ("Post-market monitoring", "Plan, sources, metrics and incidents.")]


def to_dossier(report: Report, system: str = "AI system", version: str = "1.0.0") -> str:
    out = ["# Draft: technical documentation (Annex IV)", "", "> Needs review and evidence; certifies nothing.", "", f"- System: {safe(system)}", f"- Version: {safe(version)}", f"- Scan: {safe(report.timestamp)}", ""]
    for n, (title, asks) in enumerate(_SECTIONS, 1):
        out += [f"## Section {n}: {title}", "", "**To be completed and validated.**", asks, ""]
        if n == 2:
            out += ["### Imports seen", *(f"- {safe(p)}: {safe(_KNOWN.get(m, m))}" for p, ms in sorted(report.source_imports.items()) for m in ms)]
            out += ["- No inventory in this report."] * (not report.source_imports) + [""]
    return "\n".join([*out, "## Appendix", "", to_markdown(report, evidence=True)])


def to_terminal(report: Report) -> str:
    s = report.summary
    out = [f"{s['total_findings']} findings in {s['total_files_scanned']} files, {s['total_lines_scanned']} lines", ""]
    out += [f"{f['severity']:8} {f['rule_id']:16} {display(f['location']['file_path'])}:{f['location']['start_line']}  {f['title']}" for f in report.findings]
    return "\n".join(out)


def to_html(report: Report) -> str:
    """A page that lists the findings; display only."""
    e = lambda x: html.escape(display(str(x)))
    item = lambda f: f"<li><b>{e(f['severity'])}</b> {e(f['rule_id'])}: {e(f['title'])}<br>{e(f['location']['file_path'])}:{f['location']['start_line']}" + (f"<pre>{e(f['code_snippet'])}</pre>" if f["code_snippet"] else "") + f"<p>{e(f['remediation'])}</p></li>"
    rows = "".join(map(item, report.findings)) or "<li>No findings in this scope. This does not show conformity.</li>"
    return f"<!DOCTYPE html><html lang=en><meta charset=utf-8><title>{TOOL}</title><h1>{len(report.findings)} findings in {report.summary['total_files_scanned']} files</h1><p>{e(report.target_path)}, scan {e(report.scan_id)}</p><ol>{rows}</ol></html>"


RENDERERS = {"json": to_json, "markdown": to_markdown, "sarif": to_sarif, "terminal": to_terminal, "dossier": to_dossier}


def write_report(path: str, text: str) -> None:
    """Into place in one step; never through a link or over anything but a file."""
    if os.path.lexists(path) and (os.path.islink(path) or not os.path.isfile(path)):
        raise ValueError(f"not a regular file: {path}")
    fd, own = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, path)
    except BaseException:
        os.unlink(own)
        raise
