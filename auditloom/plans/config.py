"""Project configuration: one file at the root of a scanned tree, strictly typed."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from ..functions.strict import load_policy_yaml
from ..sources.srctree import DEFAULT_EXCLUDES, IGNORED_DIRS, INFRA_NAMES, LIMITS, TEXT_SUFFIXES, read_stable
from .rules import TIERS

FILES = (".auditloom.yaml", ".auditloom.yml", "auditloom.yaml")
MAX_CONFIG = 1 << 20


@dataclass(frozen=True)
class Config:
    exclude_paths: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    ignore_rules: list[str] = field(default_factory=list)
    enforce_risk_tier: str | None = None
    custom_rules_dir: str | None = None

    def __post_init__(self) -> None:
        for name in ("exclude_paths", "ignore_rules"):
            v = getattr(self, name)
            if not isinstance(v, list) or not all(isinstance(x, str) and x.strip() for x in v):
                raise ValueError(f"{name} must be a list of strings")
        if self.enforce_risk_tier is not None and self.enforce_risk_tier not in TIERS:
            raise ValueError(f"enforce_risk_tier must be one of {', '.join(TIERS)}")
        if self.custom_rules_dir is not None:
            relative_path(self.custom_rules_dir)

    def effective(self, articles: list[str] | None = None) -> dict:
        """All that decides what is scanned, for the configuration's fingerprint."""
        return {**asdict(self), "target_articles": sorted(articles or []), "ignored_directories": sorted(IGNORED_DIRS), "text_extensions": sorted(TEXT_SUFFIXES), "infra_filenames": sorted(INFRA_NAMES), "max_source_bytes": LIMITS["maxFileBytes"], "max_scan_bytes": LIMITS["maxTotalBytes"], "max_scan_entries": LIMITS["maxEntries"]}


def relative_path(path: object) -> str:
    """A path below the project, in slashes."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError("expected a relative path")
    path = path.replace("\\", "/")
    if path.startswith("/") or ".." in path.split("/") or ":" in path.split("/")[0]:
        raise ValueError(f"{path} leaves the project")
    return path


def load_config(root: str) -> Config:
    """The configuration of the tree at root; the default if there is none."""
    there = [f for f in FILES if os.path.lexists(os.path.join(root, f))]
    if len(there) > 1:
        raise ValueError(f"more than one configuration: {', '.join(there)}")
    if not there:
        return Config()
    document = load_policy_yaml(read_stable(os.path.join(os.path.abspath(root), there[0]), MAX_CONFIG).decode("utf-8"))
    if document is None:
        return Config()
    if not isinstance(document, dict) or set(document) - set(Config.__dataclass_fields__):
        raise ValueError(f"{there[0]} has unknown settings")
    return Config(**document)
