"""Options of an engine: defaults, then a TOML file, then the environment, then what the caller gives."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

PREFIX = "FACTLOOM_"
TRUE, FALSE = frozenset({"1", "true", "yes", "on"}), frozenset({"0", "false", "no", "off"})


@dataclass(frozen=True)
class Settings:
    queue_size: int = 6
    watermark: int = 3
    max_streak: int = 2
    diversity: float = 0.6
    unexpected_share: float = 0.25
    recent_hours: float = 6.0
    near: float = 0.58
    shortlist: int = 20
    model_calls: int = 10
    model_cost: float | None = None
    input_price: float = 0.0
    output_price: float = 0.0
    quality_lane: bool = False
    model_url: str = ""
    api_key: str = ""
    model_id: str = ""
    strong_model_id: str = ""


def _typed(name: str, value: object, kind: str) -> object:
    """A value as its field's type; words that are no booleans, and numbers that are none, are errors."""
    if kind == "bool":
        word = str(value).strip().lower()
        if word not in TRUE | FALSE:
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return word in TRUE
    if value is None or "None" in kind and str(value).strip() == "":
        return None
    return {"int": int, "float": float, "float | None": float, "str": str}[kind](value)


def load(path: str | None = None, env: Mapping[str, str] | None = None, **given: object) -> Settings:
    """Later layers win; names that no layer should have are errors in the file and from the caller."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    layers: list[Mapping[str, object]] = []
    if path:
        with open(path, "rb") as f:
            layers.append(tomllib.load(f))
    env = os.environ if env is None else env
    layers.append({n: env[PREFIX + n.upper()] for n in kinds if PREFIX + n.upper() in env})
    layers.append({k: v for k, v in given.items() if v is not None})
    out = Settings()
    for layer in layers:
        if unknown := set(layer) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **{k: _typed(k, v, kinds[k]) for k, v in layer.items()})
    return out


def capabilities(s: Settings) -> dict[str, bool]:
    """What this installation can do; secrets are told by presence only."""
    from importlib.util import find_spec

    return {"precise_html": bool(find_spec("trafilatura")), "pdf": bool(find_spec("docling")), "model": bool(s.model_url and s.api_key and s.model_id), "quality_lane": s.quality_lane and bool(s.model_url and s.api_key and s.model_id)}


def shown(s: Settings) -> dict[str, object]:
    """All settings, secrets masked."""
    return asdict(s) | {"api_key": "***" if s.api_key else ""}
