"""Parameters: canonical form and hash, merging, overrides, layered configuration."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

# Keys that annotate a parameter set and never enter its hash.
ANNOTATIONS = frozenset({"_nohash", "description", "comment", "note", "name"})


def without_annotations(value: Any) -> Any:
    """The value without annotation keys, at every level; a dict may list further keys under ``_nohash``."""
    if isinstance(value, dict):
        hidden = ANNOTATIONS.union(value.get("_nohash") or ())
        return {key: without_annotations(inner) for key, inner in value.items() if key not in hidden}
    return [without_annotations(inner) for inner in value] if isinstance(value, (list, tuple)) else value


def canonical_json(value: Any) -> str:
    """JSON with sorted keys, no blanks and plain non-ASCII signs."""
    return json.dumps(without_annotations(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def params_hash(params: Any, length: int = 8) -> str:
    return hashlib.sha1(canonical_json(params).encode()).hexdigest()[:length]


def merged(base: dict, over: dict) -> dict:
    """`over` laid upon `base`; dicts under the same key are merged in turn."""
    both = {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
    return {**base, **both}


def typed(text: str) -> Any:
    """A command-line value: true/false, null/none/empty, int, float, else the text itself."""
    word = text.strip().lower()
    fixed = {"true": True, "false": False, "null": None, "none": None, "": None}
    if word in fixed:
        return fixed[word]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def overrides(pairs: list[str] | None) -> dict[str, Any]:
    """``["a.b=1"]`` as ``{"a": {"b": 1}}``; a pair without '=' is an error."""
    out: dict[str, Any] = {}
    for pair in pairs or ():
        path, sign, raw = pair.partition("=")
        if not sign:
            raise ValueError(f"expected key=value, got {pair!r}")
        value: Any = typed(raw)
        for step in reversed(path.strip().split(".")):
            value = {step: value}
        out = merged(out, value)
    return out


@dataclass
class Paths:
    artifacts: str = "artifacts"
    fixtures: str = "fixtures"
    corpora: str = "corpora"
    results: str = "artifacts/results"


@dataclass
class Defaults:
    chunker: str = "recursive"
    embedder: str = "hash"
    retriever: str = "dense"
    k: int = 10


@dataclass
class Settings:
    seed: int = 42
    paths: Paths = field(default_factory=Paths)
    defaults: Defaults = field(default_factory=Defaults)
    log_level: str = "info"
    json_logs: bool = False
    extra: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def read_mapping(path: str | Path) -> dict[str, Any]:
    """A JSON or (where the yaml package is there) YAML file as a dict; an empty file is an empty dict."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no such configuration file: {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text or "{}")
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading YAML needs the yaml package; JSON works without it") from missing
    return yaml.safe_load(text) or {}


def load_settings(path: str | Path | None = None, over: dict[str, Any] | None = None, default: str | Path | None = None) -> Settings:
    """Overrides beat the given file, which beats the default file, which beats the defaults in code; unknown keys go to ``extra``."""
    data: dict[str, Any] = read_mapping(default) if default and Path(default).exists() else {}
    for layer in (read_mapping(path) if path else {}, over or {}):
        data = merged(data, layer)
    known = {f.name for f in fields(Settings)}
    extra = merged(data.get("extra") or {}, {k: v for k, v in data.items() if k not in known})
    plain = {k: v for k, v in data.items() if k in known - {"paths", "defaults", "extra"}}
    return Settings(**plain, paths=Paths(**(data.get("paths") or {})), defaults=Defaults(**(data.get("defaults") or {})), extra=extra)
