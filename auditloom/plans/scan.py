"""The scan: sources and rules to findings, and to a report.

`scan` is one logical plan over a table of sources (path, text): each engine's joins,
suppressions, identity and the choice of one finding per rule, file and line. It never
collects and has no limits, so that a table of repositories is scanned like one folder.
`scan_path` adds what a single tree needs: discovery, limits, validation and the report.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.manifests import decode
from ..functions.text import MARKER
from ..operators import facts as ft
from ..operators import findings as fd
from ..operators import match
from ..sources.srctree import SourceTree
from . import rules as rl
from .config import Config, load_config

LIMITATIONS = [
    "Heuristic signals; they prove neither breach nor legal class.",
    "No findings do not mean conformity; review scope, exclusions and rules.",
    "Python is analysed within functions; other languages by text patterns only.",
    "Data, contracts, purpose and operation are not assessed.",
    "Maximum fines are references, no predictions.",
]


def matches(sources: DataFrame, catalog: rl.Catalog, marker: str = MARKER, python_regex: bool | str = "bounded", timed: DataFrame | None = None) -> DataFrame:
    """Matches of all engines that no suppression covers. sources: path, text."""
    structured, text = [], match.regex_findings(sources, catalog, python_regex, timed)
    if catalog.patterns("ast_call", "ast_import", "ast_assignment", "ast_function_def", "ast_absence", "data_flow"):
        structured.append(match.python_findings(ft.python_facts(sources, match.flow_specs(catalog)), catalog))
    if catalog.patterns("infra_dependency"):
        structured.append(match.dependency_findings(sources, catalog))
    if catalog.patterns("infra_docker"):
        structured += [match.docker_findings(sources, catalog), match.compose_findings(sources, catalog)]
    out = match.without_suppressed(text, ft.suppressions(sources, marker, ",;#/"))
    if structured:
        whole = structured[0]
        for x in structured[1:]:
            whole = whole.unionByName(x)
        out = match.without_suppressed(whole, ft.suppressions(sources, marker)).unionByName(out)
    return out


def scan(sources: DataFrame, catalog: rl.Catalog, marker: str = MARKER, python_regex: bool | str = "bounded") -> DataFrame:
    """Findings of sources (path, text): one row each, with its rule's attributes. A file on which a custom
    text pattern takes too long ends the job, which names it; `scan_all` goes on without it."""
    return fd.first_of_each(fd.identified(matches(sources, catalog, marker, python_regex), catalog))


def scan_all(sources: DataFrame, catalog: rl.Catalog, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """Findings, and (path, error) of the files on which custom text patterns took more time or matches than a
    scan grants. Such a file fails as a whole, and has no findings; all others are scanned."""
    timed = match.timed(sources, catalog)
    failed = match.over_time_budget(timed, sources)
    if timed is None:
        return scan(sources, catalog, marker), failed
    sources = sources.join(failed.select("path"), "path", "left_anti")
    timed = timed.join(failed.select("path"), "path", "left_anti")
    return fd.first_of_each(fd.identified(matches(sources, catalog, marker, timed=timed), catalog)), failed


def read_tree(spark: SparkSession, path: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """(path, content, size) and (path, reason) of a tree on this machine."""
    spark.dataSource.register(SourceTree)
    reader = lambda: spark.read.format("srctree").option("path", path).option("excludes", json.dumps(config.exclude_paths))
    return reader().load(), reader().option("table", "exclusions").load()


def decoded(raw: DataFrame) -> DataFrame:
    """path, text, problem: text by each file's declared encoding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append((p, decode(p, bytes(data)), None))
                except (ValueError, SyntaxError, LookupError) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    return raw.select("path", "content").mapInPandas(run, "path string, text string, problem string")


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


@dataclass
class Report:
    scan_id: str
    timestamp: str
    target_path: str
    summary: dict
    findings: list[dict]
    source_imports: dict[str, list[str]]
    source_manifest: list[dict]
    source_manifest_hash: str
    active_rule_ids: list[str]
    rules_fingerprint: str
    config_fingerprint: str
    effective_config: dict
    exclusions: dict[str, str]
    analysis_status: str = "completed"
    legal_assessment: str = "not_assessed"
    limitations: list[str] = field(default_factory=lambda: list(LIMITATIONS))

    def as_dict(self) -> dict:
        return asdict(self)


def _finding(row) -> dict:
    r = row.asDict(recursive=True)
    place = {"file_path": r["path"], **{k: r[k] for k in ("start_line", "end_line", "start_col", "end_col")}}
    keep = ("id", "rule_id", "article", "severity", "risk_tier", "title", "message", "remediation", "max_fine", "confidence")
    steps = [{"step_type": s["step_type"], "message": s["message"], "location": {"file_path": r["path"], **{k: s[k] for k in ("start_line", "end_line", "start_col", "end_col")}}, "code_snippet": s["snippet"]} for s in r["steps"] or []]
    return {**{k: r[k] for k in keep}, "location": place, "code_snippet": r["snippet"], "flow_steps": steps or None}


def active_rules(config: Config, root: str, catalog: rl.Catalog | None = None, articles: list[str] | None = None) -> rl.Catalog:
    catalog = catalog or rl.builtin()
    if config.custom_rules_dir:
        catalog = catalog.plus(rl.from_dir(os.path.join(root, config.custom_rules_dir)))
    if set(config.ignore_rules) - set(catalog.ids()):
        raise ValueError("the configuration ignores an unknown rule")
    return (catalog.for_articles(articles) if articles else catalog).without(config.ignore_rules)


def scan_path(spark: SparkSession, path: str, catalog: rl.Catalog | None = None, config: Config | None = None, articles: list[str] | None = None, marker: str = MARKER) -> Report:
    """Report of one file or folder. One input that can't be read in full fails the scan. A
    tree is bounded by the reader's limits; so are the findings and entries collected here."""
    began = time.perf_counter()
    path = os.path.abspath(path)
    if not os.path.lexists(path):
        raise ValueError(f"no such file or folder: {path}")
    root = path if os.path.isdir(path) else os.path.dirname(path)
    config = config or load_config(root)
    catalog = active_rules(config, root, catalog, articles)
    raw, left_out = read_tree(spark, path, config)
    raw = raw.persist(StorageLevel.DISK_ONLY)  # every engine sees the bytes that were captured once
    texts = decoded(raw).persist(StorageLevel.DISK_ONLY)
    try:
        sources = texts.filter("problem IS NULL").select("path", "text")
        problems = texts.filter("problem IS NOT NULL").select("path", F.col("problem").alias("error")).unionByName(ft.validation_errors(sources)).unionByName(match.over_match_budget(sources, catalog))
        if bad := problems.orderBy("path").first():
            raise ValueError(f"can't be read in full: {bad['path']} ({bad['error']})")
        found = [_finding(r) for r in fd.in_order(scan(sources, catalog, marker, python_regex="custom")).collect()]
        manifest = [r.asDict() for r in fd.manifest(raw).orderBy(F.split("path", "/")).collect()]
        lines = sources.agg(F.sum(F.size(ft.lines(F.col("text"))))).first()[0] or 0
        imports = {r["path"]: r["imports"] for r in ft.import_inventory(sources).orderBy(F.split("path", "/")).collect()}
        exclusions = {r["path"]: r["reason"] for r in left_out.orderBy("path").collect()}
    finally:
        texts.unpersist()
        raw.unpersist()
    ids = sorted(f["id"] for f in found)
    summary = {"total_files_scanned": len(manifest), "total_lines_scanned": lines, "total_findings": len(found),
               "findings_by_tier": {t: sum(f["risk_tier"] == t for f in found) for t in rl.TIERS}, "findings_by_severity": {s: sum(f["severity"] == s for f in found) for s in rl.SEVERITIES},
               "rules_loaded": len(catalog.rules), "execution_time_ms": round((time.perf_counter() - began) * 1000, 2)}
    effective = config.effective(articles)
    return Report(scan_id=hashlib.sha256(("|".join(ids) or fd.EMPTY).encode()).hexdigest(), timestamp=datetime.now(UTC).isoformat(), target_path=path, summary=summary, findings=found, source_imports=imports,
                  source_manifest=manifest, source_manifest_hash=fingerprint(manifest), active_rule_ids=sorted(catalog.ids()), rules_fingerprint=fingerprint(sorted(catalog.rules, key=lambda r: r["id"])),
                  config_fingerprint=fingerprint(effective), effective_config=effective, exclusions=exclusions)


def exit_code(report: Report, allowed: str | None = None) -> int:
    """0 if the gate passes, 1 if it doesn't: any finding, or one stricter than the allowed tier."""
    limit = len(rl.TIERS) if allowed is None else rl.TIERS.index(allowed)
    return int(any(rl.TIERS.index(f["risk_tier"]) < limit for f in report.findings))
