"""Settings: defaults, then a JSON file, then environment variables ``TIDEMARK_<NAME>``."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    namespace: str = "default"
    schema_version: str = "1"
    payload_size_threshold: int = 64 * 1024
    dedupe: bool = True
    chunk_min: int = 4096
    chunk_avg: int = 16384
    chunk_max: int = 65536
    retention_days: float = 30.0
    margin_days: float = 7.0
    grace_hours: float = 1.0
    orphan_ref_days: float = 90.0

    def __post_init__(self):
        if self.schema_version != "1":
            raise ValueError(f"schema version {self.schema_version!r} is not supported")
        if not 0 < self.chunk_min <= self.chunk_avg <= self.chunk_max:
            raise ValueError("chunk sizes must grow from min over avg to max")


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings of a file, overridden by the environment; unknown names are an error."""
    known = {f.name: f.type for f in fields(Settings)}
    values = json.loads(Path(path).read_text()) if path else {}
    if odd := values.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(odd)}")
    for name, value in (os.environ if env is None else env).items():
        short = name.removeprefix("TIDEMARK_").lower()
        if name.startswith("TIDEMARK_") and short in known:
            kind = {"int": int, "float": float, "bool": lambda v: v.lower() in ("1", "true", "yes")}.get(str(known[short]), str)
            values[short] = kind(value)
    return Settings(**values)


def check_retention(configured_days: float, namespace_days: float) -> str | None:
    """Why a configured retention must be refused, if it is shorter than the namespace keeps histories."""
    if configured_days < namespace_days:
        return f"retention of {configured_days:g} days is shorter than the namespace's {namespace_days:g}"
    return None
