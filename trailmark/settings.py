"""Settings in layers: options, then environment, then file, then the mode's defaults."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

PREFIX = "TRAILMARK_"


@dataclass(frozen=True)
class Settings:
    """Folding is on and shortening off unless asked for; shadow decides without acting."""

    mode: str = "on"
    dedupe: str = "on"
    sieve: str = "off"
    max_age: int = 12_000
    same_epoch: bool = True
    threshold: float = 0.10
    min_share: float = 0.30
    min_saved: int = 1000


#: What a mode sets where nothing else does.
MODES: dict[str, dict[str, str]] = {"on": {}, "off": {"dedupe": "off", "sieve": "off"}, "shadow": {"sieve": "on"}}
_SWITCH: Callable[[Any], bool] = lambda v: v in ("on", "off")
_COUNT: Callable[[Any], bool] = lambda v: isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 53
_SHARE: Callable[[Any], bool] = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) and 0 <= v <= 1
VALID: dict[str, Callable[[Any], bool]] = {
    "mode": lambda v: v in MODES, "dedupe": _SWITCH, "sieve": _SWITCH, "max_age": _COUNT, "same_epoch": lambda v: isinstance(v, bool),
    "threshold": _SHARE, "min_share": _SHARE, "min_saved": _COUNT,
}


def checked(values: Mapping[str, Any]) -> dict[str, Any]:
    """The known fields with valid values; others are ignored one by one."""
    return {k: v for k, v in values.items() if k in VALID and VALID[k](v)}


def from_file(path: str | Path) -> dict[str, Any]:
    """A JSON object's valid fields; nothing if it can't be read."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return checked(found) if isinstance(found, dict) else {}


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_environment(environment: Mapping[str, str]) -> dict[str, Any]:
    own = {k[len(PREFIX) :].lower(): _parsed(v) for k, v in environment.items() if k.startswith(PREFIX)}
    return checked(own)


def dotenv(path: str | Path) -> dict[str, str]:
    """KEY=value lines; quotes around a value go, comments and other lines count nothing."""
    try:
        lines = Path(path).read_text().splitlines()
    except OSError:
        return {}
    out = {}
    for line in lines:
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and name.strip().isidentifier():
            out[name.strip()] = value.strip().strip("\"'")
    return out


def resolve(options: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, path: str | Path | None = None) -> Settings:
    """One resolver for every start: what was not asked for stays at the documented default."""
    layers = [checked(options or {}), from_environment(os.environ if environment is None else environment), from_file(path) if path else {}]
    mode = next((layer["mode"] for layer in layers if "mode" in layer), Settings.mode)
    merged: dict[str, Any] = dict(MODES[mode])
    for layer in reversed(layers):
        merged |= layer
    return replace(Settings(), **merged | {"mode": mode})
