"""The global configuration file (TOML)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from ..functions.glob import EXCLUDE_DEFAULTS, VENDOR_DEFAULTS


@dataclass
class Config:
    exclude: list[str] = field(default_factory=list)
    vendor: list[str] = field(default_factory=list)
    debounce_ms: int = 300
    backend: str = "local"
    batch_size: int = 64

    def effective_rules(self) -> tuple[list[str], list[str]]:
        """Shipped rules, then the file's own."""
        return [*EXCLUDE_DEFAULTS, *self.exclude], [*VENDOR_DEFAULTS, *self.vendor]


def parse(text: str) -> Config:
    """A configuration; unknown keys and wrong types raise ValueError."""
    raw = tomllib.loads(text)
    known = {"index": {"exclude": list, "vendor": list}, "watcher": {"debounce_ms": int}, "embeddings": {"backend": str, "batch_size": int}}
    values = {}
    for section, own in raw.items():
        if section not in known or not isinstance(own, dict):
            raise ValueError(f"unknown section {section}")
        for key, value in own.items():
            if key not in known[section]:
                raise ValueError(f"unknown key {section}.{key}")
            if not isinstance(value, known[section][key]) or isinstance(value, bool):
                raise ValueError(f"{section}.{key} must be {known[section][key].__name__}")
            values[key] = value
    config = Config(**values)
    if config.debounce_ms < 0 or config.batch_size < 1:
        raise ValueError("debounce_ms and batch_size must not be negative or zero")
    return config
