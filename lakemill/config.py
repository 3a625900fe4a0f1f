"""Settings from defaults, files and the environment, later ones over earlier ones, checked."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from lakemill.errors import EngineError

PREFIX = "LAKEMILL_"


@dataclass(frozen=True)
class Config:
    warehouse: str = "lakemill-warehouse"
    compression: str = "zstd"
    cache_entries: int = 1000
    cache_bytes: int = 100 << 20
    cache_seconds: float = 300.0
    shuffle_partitions: int = 200

    def spark(self) -> dict[str, str]:
        return {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.parquet.compression.codec": self.compression,
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
        }


def _typed(name: str, value: object) -> object:
    kind = {f.name: type(f.default) for f in fields(Config)}.get(name)
    if kind is None:
        raise EngineError(f"unknown setting {name}")
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise EngineError(f"{name} must be {kind.__name__}: {value!r}") from None


def load(files: list[str | Path] = (), env: Mapping[str, str] = os.environ) -> Config:
    """Defaults, then TOML files in order (missing ones are skipped), then LAKEMILL_* variables."""
    out = Config()
    for file in files:
        if Path(file).exists():
            out = replace(out, **{k: _typed(k, v) for k, v in tomllib.loads(Path(file).read_text()).items()})
    out = replace(out, **{k[len(PREFIX) :].lower(): _typed(k[len(PREFIX) :].lower(), v) for k, v in env.items() if k.startswith(PREFIX)})
    for name in ("cache_entries", "cache_bytes", "cache_seconds", "shuffle_partitions"):
        if getattr(out, name) <= 0:
            raise EngineError(f"{name} must be above 0")
    if out.compression not in ("none", "uncompressed", "snappy", "gzip", "lz4", "zstd"):
        raise EngineError(f"unknown compression {out.compression}")
    return out
