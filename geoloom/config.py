"""Settings: arguments, then a TOML file, then defaults."""

from __future__ import annotations

import logging
import re
import tomllib
from pathlib import Path

log = logging.getLogger(__name__)

NAMES = ("geoloom.toml", ".geoloom.toml", "pyproject.toml")
DEFAULTS: dict[str, dict] = {
    "global": {"temp_dir": None, "parallelism": None, "log_level": "INFO"},
    "tile": {"partition_size": None, "sort": "zorder", "compression": "zstd", "sample_cap": 10_000, "sample_ratio": 1.0, "csv_split_size": "32mb", "grid_size": 4096, "dtype": "float64", "sfc_bits": 16, "seed": 42, "covering_bbox": True},
    "mvt": {"zoom": 7, "threshold": 0.0, "pmtiles": False, "pmtiles_compression": "gzip", "feature_capacity": 10_000, "extent": 4096, "buffer": 256},
    "build": {},
    "serve": {"host": "127.0.0.1", "port": 8765, "cache_size": 256},
}
#: Sections in which a setting is looked for after its own.
FALLBACKS = {"build": ("tile", "mvt"), "serve": ("mvt",)}
_SIZE = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(b|kb|mb|gb|tb)?\s*", re.I)
_chosen: Path | None = None


def parse_size(value: str | int | float | None) -> int | None:
    """Bytes of a number or of a text such as 256mb (units of 1024)."""
    if value is None or isinstance(value, (int, float)):
        return None if value is None else int(value)
    m = _SIZE.fullmatch(value)
    if not m:
        raise ValueError(f"{value!r} is no size")
    return int(float(m[1]) * 1024 ** ("b", "kb", "mb", "gb", "tb").index((m[2] or "b").lower()))


def use_file(path: str | Path | None) -> None:
    """Take settings from this file; None: look for one again."""
    global _chosen
    _chosen = None if path is None else Path(path)


def load(folder: str | Path = ".") -> dict:
    """The sections of the chosen file, or of the first that is found; a file that can't be read counts as empty."""
    for path in [_chosen] if _chosen else [Path(folder) / n for n in NAMES]:
        if not path.is_file():
            continue
        try:
            found = tomllib.loads(path.read_text())
        except (tomllib.TOMLDecodeError, UnicodeDecodeError, OSError) as e:
            log.warning("%s can't be read (%s); defaults hold", path, e)
            return {}
        if path.name == "pyproject.toml":
            found = (found.get("tool") or {}).get("geoloom")
            if found is None:
                continue
        return {k: v for k, v in found.items() if isinstance(v, dict)}
    return {}


def resolve(section: str, key: str, given: object = None, folder: str | Path = ".") -> object:
    """``given`` unless None; else the file's value in the section, its fallbacks, or global; else the default."""
    if given is not None:
        return given
    found = load(folder)
    sections = (section, *FALLBACKS.get(section, ()), "global")
    for name in sections:
        if key in found.get(name, {}):
            return found[name][key]
    return next((DEFAULTS[n][key] for n in sections if key in DEFAULTS.get(n, {})), None)
