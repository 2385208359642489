"""Rule catalogs: loading, integrity, selection, and their tables.

Rules are few and live on the driver; what scans need of them becomes literals or small
tables whose size is bounded by the catalog's own limits.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.strict import load_policy_yaml, yaml_errors
from ..sources import srctree
from .builtin import BUILTIN

TYPES = ("ast_call", "ast_import", "ast_assignment", "ast_function_def", "ast_absence", "regex", "data_flow", "infra_dependency", "infra_docker")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
#: Strictest first.
TIERS = ("prohibited", "high_risk", "limited_risk", "minimal_risk")
LIMITS = {"entries": 10_000, "files": 1_000, "rules": 10_000, "bytes": 10 << 20, "file": 4 << 20}
MAX_PATTERNS, MAX_PATTERN_LENGTH = 256, 4096
_FIELDS = {"id", "article", "title", "severity", "risk_tier", "description", "remediation", "max_fine", "confidence", "patterns"}
_ID = re.compile(r"[A-Z0-9]{3,8}-(?:ART\d+|GEN)-\d{3}")


class CatalogError(ValueError):
    pass


def _checked(rule: dict) -> dict:
    if not isinstance(rule, dict) or set(rule) - _FIELDS or _FIELDS - set(rule) - {"confidence", "max_fine", "remediation"}:
        raise CatalogError("a rule has unknown or missing fields")
    rule = {"confidence": "HIGH", "max_fine": "", "remediation": "", **rule}
    text = lambda k, low, high=10**6: isinstance(rule[k], str) and low <= len(rule[k]) <= high
    if not (isinstance(rule["id"], str) and _ID.fullmatch(rule["id"])):
        raise CatalogError(f"malformed rule id {rule['id']!r}")
    if not (text("title", 5, 150) and text("description", 10) and text("article", 1)):
        raise CatalogError(f"{rule['id']}: title, description or article")
    if rule["severity"] not in SEVERITIES or rule["risk_tier"] not in TIERS or rule["confidence"] not in CONFIDENCES:
        raise CatalogError(f"{rule['id']}: severity, tier or confidence")
    if not rule["patterns"]:
        raise CatalogError(f"{rule['id']}: no patterns")
    for p in rule["patterns"]:
        if p.get("type") not in TYPES:
            raise CatalogError(f"{rule['id']}: pattern type")
        if p["type"] == "data_flow":
            flow = p.get("data_flow") or {}
            if not flow.get("sources") or not flow.get("sinks"):
                raise CatalogError(f"{rule['id']}: a flow needs sources and sinks")
        elif not p.get("target"):
            raise CatalogError(f"{rule['id']}: pattern without a target")
        if p["type"] == "regex":
            if len(p["target"]) > MAX_PATTERN_LENGTH:
                raise CatalogError(f"{rule['id']}: pattern too long")
            try:
                re.compile(p["target"])
            except re.error as e:
                raise CatalogError(f"{rule['id']}: {e}") from e
    return rule


class Catalog:
    """Validated rules in their order, with distinct ids."""

    def __init__(self, rules: Iterable[dict]) -> None:
        self.rules = [_checked(r) for r in rules]
        ids = [r["id"] for r in self.rules]
        if len(ids) != len(set(ids)):
            raise CatalogError("duplicate rule ids")
        if sum(p["type"] == "regex" for r in self.rules for p in r["patterns"]) > MAX_PATTERNS:
            raise CatalogError("too many regular expressions")

    def ids(self) -> list[str]:
        return [r["id"] for r in self.rules]

    def plus(self, other: Catalog) -> Catalog:
        return Catalog([*self.rules, *other.rules])

    def for_articles(self, articles: Iterable[str]) -> Catalog:
        """Rules whose id or article text names one of the articles (`5`, `Art. 05`, `gen`)."""
        wanted = {re.sub(r"[^0-9a-z]", "", a.lower()).replace("art", "").lstrip("0") for a in articles} - {""}

        def named(rule: dict) -> set[str]:
            found = {n.lstrip("0") for n in re.findall(r"(?i)art(?:icle)?\.?\s*(\d+)", f"{rule['id']} {rule['article']}")}
            return found | {rule["id"].split("-")[1].lower().replace("art", "").lstrip("0")}

        return Catalog(r for r in self.rules if wanted & named(r))

    def without(self, ignored: Iterable[str]) -> Catalog:
        ignored = {x.strip().upper() for x in ignored}
        return Catalog(r for r in self.rules if r["id"] not in ignored)

    def patterns(self, *types: str) -> list[tuple[int, int, dict, dict]]:
        """(rule order, pattern order, rule, pattern) of the given types."""
        return [(i, j, r, p) for i, r in enumerate(self.rules) for j, p in enumerate(r["patterns"]) if p["type"] in types]


#: Text patterns whose time on any line is known to be short.
KNOWN_PATTERNS = frozenset(p["target"] for r in BUILTIN for p in r["patterns"] if p["type"] == "regex")


def builtin() -> Catalog:
    return Catalog(BUILTIN)


def from_dir(folder: str | Path) -> Catalog:
    """All .yaml and .yml files below folder, in order of their paths; one rule or a list each.
    Links and special files are refused, and files that change while they are read."""
    root = srctree.checked_path(str(folder))
    if not os.path.isdir(root):
        raise CatalogError(f"no folder: {folder}")
    found = []
    try:
        for e in srctree.entries(root, {"maxEntries": LIMITS["entries"], "maxDepth": srctree.LIMITS["maxDepth"]}, lambda e: True):
            if e.size < 0:
                raise CatalogError(f"neither file nor folder: {e.path}")
            if not e.folder and e.name.lower().endswith((".yaml", ".yml")):
                found.append(e)
        if len(found) > LIMITS["files"] or sum(e.size for e in found) > LIMITS["bytes"]:
            raise CatalogError("rule folder exceeds its limits")
        rules: list[dict] = []
        for e in sorted(found, key=lambda e: e.path.split("/")):
            try:
                document = load_policy_yaml(srctree.read_stable(os.path.join(root, e.path), LIMITS["file"]).decode("utf-8-sig"))
                rules += [_checked(r) for r in (document if isinstance(document, list) else [document])]
            except (ValueError, yaml_errors()) as x:
                raise CatalogError(f"{e.path} ({str(x).splitlines()[0]})") from x
            if len(rules) > LIMITS["rules"]:
                raise CatalogError("too many rules")
    except OSError as x:
        raise CatalogError(str(x)) from x
    if not rules:
        raise CatalogError("no rules found")
    return Catalog(rules)


RULE_SCHEMA = "rule_ord int, rule_id string, article string, title string, severity string, risk_tier string, confidence string, remediation string, max_fine string"


def rules_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    keys = ("id", "article", "title", "severity", "risk_tier", "confidence", "remediation", "max_fine")
    return spark.createDataFrame([(i, *(r[k] for k in keys)) for i, r in enumerate(catalog.rules)], RULE_SCHEMA)


def flows_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(i, j, r["id"], role, x["target"]) for i, j, r, p in catalog.patterns("data_flow") for role in ("sources", "sanitizers", "sinks") for x in p["data_flow"].get(role, [])]
    return spark.createDataFrame(rows, "rule_ord int, pattern_ord int, rule_id string, role string, target string")
