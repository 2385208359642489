"""Strict parsers: YAML, TOML and JSON that reject what the usual ones let pass."""

from __future__ import annotations

import json

try:
    import yaml
except ImportError:  # only needed for rule files, configuration and compose files
    yaml = None

MAX_DEPTH, MAX_EVENTS, MAX_ALIASES = 64, 20_000, 256


def unique_pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate JSON key")
    return out


def load_json(text: str) -> object:
    def never(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=unique_pairs, parse_constant=never)


def yaml_errors() -> type[Exception]:
    return yaml.YAMLError if yaml is not None else RuntimeError


def _loader():
    if yaml is None:
        raise RuntimeError("YAML input needs PyYAML")

    class Strict(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            own = [self.construct_object(k, deep=True) for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
            if not all(isinstance(k, str) for k in own):
                raise ValueError("YAML keys must be strings")
            if len(own) != len(set(own)):
                raise ValueError("duplicate YAML key")
            return super().construct_mapping(node, deep)

    return Strict


def load_policy_yaml(text: str) -> object:
    """Unique string keys, no aliases."""
    loader = _loader()
    if any(isinstance(e, yaml.events.AliasEvent) for e in yaml.parse(text)):
        raise ValueError("aliases are not allowed in policy files")
    return yaml.load(text, Loader=loader)


def load_compose_yaml(text: str) -> object:
    """Anchors and merges are expanded; depth, events and aliases are bounded."""
    loader, depth, aliases = _loader(), 0, 0
    for n, e in enumerate(yaml.parse(text)):
        depth += isinstance(e, (yaml.events.MappingStartEvent, yaml.events.SequenceStartEvent)) - isinstance(e, (yaml.events.MappingEndEvent, yaml.events.SequenceEndEvent))
        aliases += isinstance(e, yaml.events.AliasEvent)
        if depth > MAX_DEPTH or n >= MAX_EVENTS or aliases > MAX_ALIASES:
            raise ValueError("compose file exceeds its budget")
    return yaml.load(text, Loader=loader)
