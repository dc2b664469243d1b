"""Checks of the surroundings; only core failures are fatal."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys
from dataclasses import dataclass
from pathlib import Path

from gleanery.functions.vectors import EMBEDDERS


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    detail: str
    core: bool = False
    needed_for: str = ""


#: What a folder of fixtures holds.
FIXTURES = ("documents", "chunks", "indexes", "evalset", "results")
#: Where the client library of real models looks for its key.
KEY = "ANTHROPIC_API_KEY"


def run(artifacts: str = ".", fixtures: str | None = None) -> list[Check]:
    present = lambda module: importlib.util.find_spec(module) is not None
    out = [Check("python", sys.version_info >= (3, 10), sys.version.split()[0], True)]
    out += [Check(m, present(m), "installed" if present(m) else "missing", True) for m in ("pyspark", "pyarrow", "pandas", "numpy", "regex")]
    java = shutil.which("java") or os.environ.get("JAVA_HOME")
    out.append(Check("java", bool(java), str(java or "not found"), True))
    for module, use in (
        ("tiktoken", "byte-level BPE encodings"), ("ahocorasick", "needle hosts"), ("yaml", "YAML configurations"),
        ("sentence_transformers", "model embedders"),
    ):
        out.append(Check(module, present(module), "installed" if present(module) else "missing", False, use))
    free = shutil.disk_usage(artifacts if Path(artifacts).exists() else ".").free / 1e9
    out.append(Check("disk", free > 1, f"{free:.1f} GB free", True))
    for name in FIXTURES if fixtures else ():
        held = any(Path(fixtures, name).glob("*"))
        out.append(Check(f"fixtures {name}", held, "there" if held else f"none below {fixtures}", False, "runs on fixtures"))
    told = bool(os.environ.get(KEY))
    out.append(Check("model key", told, "set" if told else f"{KEY} is not set", False, "real models"))
    cache = Path(os.environ.get("HF_HOME", Path.home() / ".cache/huggingface")) / "hub"
    for spec in EMBEDDERS.values():
        if spec.model:
            there = (cache / f"models--{spec.model.replace('/', '--')}").exists()
            out.append(Check(f"model {spec.name}", there, "cached" if there else "not cached", False, f"embedder {spec.name}"))
    return out


def render(checks: list[Check]) -> str:
    mark = lambda c: "ok" if c.ok else "FAIL" if c.core else "absent"
    return "\n".join(f"{mark(c):6} {c.name}: {c.detail}" + (f" (for {c.needed_for})" if c.needed_for and not c.ok else "") for c in checks)


def healthy(checks: list[Check]) -> bool:
    return all(c.ok for c in checks if c.core)
