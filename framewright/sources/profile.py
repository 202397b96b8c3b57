"""Strict TOML profiles."""

from __future__ import annotations

import tomllib
from typing import Any

#: Sections and their fields with the types they take.
SECTIONS: dict[str, dict[str, type | tuple[type, ...]]] = {
    "source": {"name": str, "fps": (int, float, str)},
    "video": {"width": int, "height": int, "mode": str},
    "output": {"dither": str},
    "encoder": {"cold_cap": (int, str), "quality_budget_bytes": int},
    "palette": {"lines": int, "algorithm": str},
    "analysis": {"enabled": bool},
}
VERSION = 5


def load(text: str, sections: dict[str, dict[str, Any]] = SECTIONS, version: int = VERSION) -> dict[str, Any]:
    """Parse and check a profile: another version, unknown sections or fields, and wrong types are errors."""
    found = tomllib.loads(text)
    if found.pop("schema_version", None) != version:
        raise ValueError(f"schema_version must be {version}")
    wrong = [s for s in found if s not in sections] + [f"{s}.{k}" for s, fields in found.items() if s in sections for k, v in fields.items() if k not in sections[s] or not isinstance(v, sections[s][k]) or isinstance(v, bool) and sections[s][k] is not bool]
    if wrong:
        raise ValueError(f"unknown or of a wrong type: {', '.join(wrong)}")
    return {s: found.get(s, {}) for s in sections}
