"""Selection settings and TypeScript path aliases, read on the driver from a project's small configuration files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

import regex

try:
    import yaml
except ImportError:  # settings then have their defaults
    yaml = None

MODES = ("shadow", "conservative", "standard", "aggressive")
EXTENDS_DEPTH = 5


@dataclass
class SelectionConfig:
    """Settings with their defaults; ``read`` takes each key in camel or kebab case and ignores values of a wrong type."""

    # fixed values: the defaults
    mode: str = "shadow"
    test_runner: str = "auto"
    test_dir: str = "__tests__"
    run_all_tests_on: list[str] = field(default_factory=lambda: ["package.json", "requirements.txt", "*.config.ts", ".env*", ".github/workflows/**"])
    always_run: list[str] = field(default_factory=list)
    never_run: list[str] = field(default_factory=list)
    architecture_notes: str = ""
    flaky_test_threshold: float = 0.15
    flaky_test_quarantine: float = 0.40
    full_suite_every: int = 50

    @classmethod
    def read(cls, path: str) -> SelectionConfig:
        try:
            with open(path, encoding="utf-8") as f:
                raw = yaml.safe_load(f) if yaml else None
        except Exception:  # noqa: BLE001 - a broken or absent file means defaults
            raw = None
        return cls.of(raw if isinstance(raw, dict) else {})

    @classmethod
    def of(cls, raw: dict) -> SelectionConfig:
        made = cls()
        for f in fields(cls):
            words = f.name.split("_")
            camel, kebab = words[0] + "".join(w.title() for w in words[1:]), "-".join(words)
            value = raw[camel] if raw.get(camel) is not None else raw.get(kebab)
            if _fits(getattr(made, f.name), value) and (f.name != "mode" or value in MODES):
                setattr(made, f.name, list(value) if isinstance(value, list) else value)
        return made


def _fits(default, value) -> bool:
    if isinstance(default, list):
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    if isinstance(default, str):
        return isinstance(value, str)
    return isinstance(value, (int, float)) and not isinstance(value, bool)


_JSONC = regex.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', regex.S)
_TRAILING = regex.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', regex.S)


def parse_jsonc(raw: str):
    """JSON with comments and trailing commas; strings are left alone, so "@/*" begins no comment."""
    bare = _JSONC.sub(lambda m: m.group(1) or " ", raw)
    return json.loads(_TRAILING.sub(lambda m: m.group(1) or "", bare))


def _load(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as f:
            found = parse_jsonc(f.read())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def _chain(path: str) -> list[dict] | None:
    """A configuration and those it extends, nearest first, at most EXTENDS_DEPTH; a link that can't be read ends the chain."""
    out: list[dict] = []
    while len(out) < EXTENDS_DEPTH:
        own = _load(path)
        if own is None:
            break
        out.append(own)
        parent = own.get("extends")
        if not isinstance(parent, str):
            break
        parent = os.path.join(os.path.dirname(path), parent)
        path = parent if parent.endswith(".json") or os.path.exists(parent) else parent + ".json"
    return out or None


def ts_aliases(root: str) -> list[dict] | None:
    """Alias rules of root/tsconfig.json in the order they apply: longer patterns first, exact before wildcard. None if there are none.

    Nearer configurations win key by key; the base folder is taken relative to the root configuration.
    """
    chain = _chain(os.path.join(root, "tsconfig.json"))
    if not chain:
        return None
    paths: dict[str, list[str]] = {}
    base = "."
    for own in reversed(chain):
        options = own.get("compilerOptions") or {}
        paths |= options.get("paths") or {}
        base = options.get("baseUrl", base)
    rules = [{"pattern": p, "wildcard": "*" in p, "prefix": p.split("*")[0], "targets": list(t), "base": os.path.normpath(base)} for p, t in paths.items()]
    return sorted(rules, key=lambda r: (-len(r["pattern"]), r["wildcard"])) or None
