"""Small documents of a project: configuration, suppression stores, scopes, changed files.

They are read on the driver, because they are bounded by caps, checked there and handed on as frames.
"""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Mapping
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from credence.functions.identity import SCHEME

#: Caps on what a store or a scope may hold.
MOST_BYTES, MOST_ITEMS = 16 * 1024 * 1024, 100_000
_HEX = re.compile(r"[0-9a-f]{64}")


class StoreError(ValueError):
    """A store that can't be trusted: wrong scheme, bad fingerprint, duplicate, or too large."""


def read_confined(root: Path, name: str) -> str | None:
    """The text of a regular file inside ``root``; None if there is none.  Links aren't followed."""
    path = root / name
    if path.is_symlink():
        raise StoreError(f"{name} is a link")
    if not path.exists():
        return None
    if not path.is_file() or not path.resolve().is_relative_to(root.resolve()):
        raise StoreError(f"{name} is no regular file inside the project")
    if path.stat().st_size > MOST_BYTES:
        raise StoreError(f"{name} has more than {MOST_BYTES} bytes")
    return path.read_text("utf-8")


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _entries(text: str | None, section: str, version: int = 1) -> list[Mapping]:
    if text is None:
        return []
    data = _yaml(text) or {}
    if data.get("fingerprint_scheme") != SCHEME or data.get("version") != version:
        raise StoreError(f"{section}: the scheme or version isn't {SCHEME} {version}; rekey the store first")
    rows = data.get(section) or []
    seen = set()
    for r in rows:
        fp = str(r.get("fingerprint", "")).removeprefix(f"{SCHEME}:")
        if not _HEX.fullmatch(fp) or fp in seen:
            raise StoreError(f"{section}: bad or repeated fingerprint {fp[:80]!r}")
        seen.add(fp)
    return rows


def _fp(row: Mapping) -> str:
    return str(row["fingerprint"]).removeprefix(f"{SCHEME}:")


def baseline(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([(_fp(r),) for r in _entries(text, "entries")], "fingerprint string")


def waivers(spark: SparkSession, text: str | None) -> DataFrame:
    rows = []
    for r in _entries(text, "waivers"):
        if not str(r.get("reason") or "").strip():
            raise StoreError("a waiver needs a reason")
        end = r.get("expires")
        rows.append((_fp(r), str(r["reason"]), date.fromisoformat(end) if isinstance(end, str) else end))
    return spark.createDataFrame(rows, "fingerprint string, reason string, expires date")


def judged(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([(_fp(r), str(r.get("rationale", ""))) for r in _entries(text, "findings") if r.get("verdict") == "FALSE_POSITIVE"], "fingerprint string, rationale string")


def write_store(section: str, rows: list[Mapping]) -> str:
    """A store as text: sorted, one entry per fingerprint, with its scheme."""
    body = {"fingerprint_scheme": SCHEME, "version": 1, section: [{k: str(v) if isinstance(v, date) else v for k, v in r.items()} for r in rows]}
    return json.dumps(body, indent=1, sort_keys=True) + "\n"


def config(text: str | None, section: str = "credence") -> dict:
    """The settings of a TOML document; unknown keys and wrong types are errors."""
    kinds = {"source_roots": list, "exclude": list, "untrusted_sources": list, "sanitisers": list, "packs": list, "provenance_clash": bool, "rules": dict, "artifacts": dict}
    found = tomllib.loads(text).get(section, {}) if text else {}
    for key, value in found.items():
        if key not in kinds:
            raise StoreError(f"unknown setting {key}")
        if not isinstance(value, kinds[key]):
            raise StoreError(f"{key} must be a {kinds[key].__name__}")
    return {"source_roots": ["."], "exclude": [], "untrusted_sources": [], "sanitisers": [], "packs": [], "provenance_clash": False, "rules": {}, "artifacts": {}} | found


def affected_scope(spark: SparkSession, text: str) -> DataFrame:
    """(locator, sei) of a worklist: a bare list, or an object whose data.items are entities."""
    if len(text.encode()) > MOST_BYTES:
        raise StoreError("the scope is too large")
    data = json.loads(text)
    items = data if isinstance(data, list) else [i.get("entity", i) for i in (data.get("data") or {}).get("items", [])]
    if len(items) > MOST_ITEMS:
        raise StoreError(f"the scope has more than {MOST_ITEMS} items")
    if not all(isinstance(i, dict) and (i.get("locator") or i.get("sei")) for i in items):
        raise StoreError("every item needs a locator or an sei")
    return spark.createDataFrame([(i.get("locator"), i.get("sei")) for i in items], "locator string, sei string").distinct()


def changed_files(spark: SparkSession, root: Path, since: str) -> DataFrame:
    """(path) of files changed since a commit, and of untracked ones."""
    if since.startswith("-"):
        raise StoreError("a reference can't begin with a dash")
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True, timeout=60).stdout
    commit = git("rev-parse", "--verify", f"{since}^{{commit}}").strip()
    names = {*git("diff", "--name-only", "--relative", "-z", commit).split("\0"), *git("ls-files", "--others", "--exclude-standard", "-z").split("\0")} - {""}
    return spark.createDataFrame([(n,) for n in sorted(names)], "path string")


class Ignore:
    """Layered ignore patterns: the last that matches wins, and ``!`` takes a path back."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            pattern = line[1:] if keep else line
            only_dirs = pattern.endswith("/")
            pattern = pattern.rstrip("/")
            anchored = "/" in pattern
            body = "".join({"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|[^*?\[/]+|.", pattern.lstrip("/")))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + ("/.*" if only_dirs else "(?:/.*)?") + r"\Z"), not keep))

    def __call__(self, path: str) -> bool:
        """Is ``path`` ignored?"""
        out = False
        for rule, ignored in self.rules:
            if rule.match(path):
                out = ignored
        return out
