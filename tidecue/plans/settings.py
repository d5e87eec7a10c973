"""Driver settings: one JSON file, values of a profile nested under its id. Nothing here touches data."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path


def load(path: str | Path) -> dict:
    """An unreadable file counts as empty."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(path: str | Path, **changes: object) -> dict:
    """Merge changes in and replace the file at once; others' values stay."""
    path = Path(path)
    merged = load(path) | changes
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(merged, f, ensure_ascii=False, indent=1)
    os.replace(name, path)
    return merged


def of_profile(path: str | Path, profile: str) -> dict:
    return dict(load(path).get("by_profile", {}).get(profile, {}))


def save_of_profile(path: str | Path, profile: str, **changes: object) -> dict:
    every = load(path).get("by_profile", {})
    return save(path, by_profile=every | {profile: every.get(profile, {}) | changes})


def resolve(name: str, given: str, path: str | Path, environment: Mapping[str, str] = os.environ) -> tuple[str, str]:
    """A value and where it is from: what was given, then the environment, then the file."""
    for source, value in (("given", given), ("environment", environment.get(name, "")), ("file", str(load(path).get(name, "")))):
        if value.strip():
            return value.strip(), source
    return "", ""
