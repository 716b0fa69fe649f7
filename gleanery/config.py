"""Settings of a corpus scan: defaults, YAML file, command line."""

from __future__ import annotations

import fnmatch
import math
import os
import re
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIG_FILE = ".gleanery.yaml"
NEAR_METHODS = ("simhash", "minhash")
DEFAULT_EXCLUDES = (".git", "__pycache__", "node_modules", ".venv", ".env")


@dataclass(frozen=True)
class ScanConfig:
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    sampling_rate: float = 0.10
    sampling_rate_auto: bool = True
    sampling_min_per_type: int = 30
    pii_custom_patterns: tuple[tuple[str, str], ...] = ()
    show_pii_samples: bool = False
    pii_min_confidence: float = 0.0
    simhash_threshold: int = 5
    simhash_bits: int = 64
    near_method: str = "simhash"
    pii_critical: float = 0.05
    duplicate_critical: float = 0.10
    corrupt_critical: float = 0.01
    seed: int = 42
    extra: dict = field(default_factory=dict, compare=False)

    def with_excludes(self, *more: str) -> ScanConfig:
        return replace(self, exclude=(*self.exclude, *[m for m in more if m not in self.exclude]))


def clamp(value: Any, low: float = 0.0, high: float = 1.0) -> float:
    return min(high, max(low, float(value)))


def from_mapping(raw: Any, base: ScanConfig | None = None) -> ScanConfig:
    """A config from the mapping that a YAML file holds; parts that do not fit are skipped."""
    out = base or ScanConfig()
    if not isinstance(raw, dict):
        return out

    def section(name: str) -> dict:
        return raw[name] if isinstance(raw.get(name), dict) else {}

    if isinstance(raw.get("exclude"), list):
        out = out.with_excludes(*[str(x) for x in raw["exclude"]])
    sampling, pii, simhash, limits = section("sampling"), section("pii"), section("simhash"), section("thresholds")
    if "rate" in sampling:
        out = replace(out, sampling_rate=clamp(sampling["rate"]), sampling_rate_auto=False)
    if "min_per_type" in sampling:
        out = replace(out, sampling_min_per_type=max(0, int(sampling["min_per_type"])))
    if "seed" in sampling:
        out = replace(out, seed=int(sampling["seed"]))
    custom = []
    for entry in pii.get("custom_patterns") or []:
        if isinstance(entry, dict) and entry.get("name") and entry.get("pattern"):
            try:
                re.compile(str(entry["pattern"]))
                custom.append((str(entry["name"]), str(entry["pattern"])))
            except re.error:
                warnings.warn(f"pattern {entry['name']!r} is not valid and is left out", stacklevel=2)
    out = replace(out, pii_custom_patterns=tuple(custom), show_pii_samples=bool(pii.get("show_samples", out.show_pii_samples)), pii_min_confidence=clamp(pii.get("min_confidence", out.pii_min_confidence)))
    bits = int(simhash.get("bits", out.simhash_bits))
    bits = bits if bits in (64, 128) else out.simhash_bits
    if section("near_duplicates").get("method") in NEAR_METHODS:
        out = replace(out, near_method=section("near_duplicates")["method"])
    out = replace(out, simhash_bits=bits, simhash_threshold=int(clamp(simhash.get("threshold", out.simhash_threshold), 0, bits)))
    return replace(
        out, pii_critical=clamp(limits.get("pii_critical", out.pii_critical)), duplicate_critical=clamp(limits.get("duplicate_critical", out.duplicate_critical)),
        corrupt_critical=clamp(limits.get("corrupt_critical", out.corrupt_critical)),
    )


def from_flat(raw: Any, base: ScanConfig | None = None) -> ScanConfig:
    """A config from the flat keys of the scan service (and the sections of a YAML file, where they are mappings).

    Numbers out of range are clamped; a value of the wrong kind is an error.
    """
    if not isinstance(raw, dict):
        raise ValueError("config is not a mapping")
    out = from_mapping(raw, base)
    known = {"sampling_rate", "show_pii_samples", "pii_min_confidence", "simhash_bits", "simhash_threshold", "exclude", "sampling", "pii", "simhash", "thresholds", "near_duplicates"}
    if unknown := sorted(set(map(str, raw)) - known):
        warnings.warn(f"unknown settings are left out: {', '.join(unknown)}", stacklevel=2)
    number = {}
    for key in ("sampling_rate", "pii_min_confidence", "simhash_bits", "simhash_threshold"):
        if key in raw:
            try:
                number[key] = float(raw[key])
            except (TypeError, ValueError):
                raise ValueError(f"{key} must be a number, not {raw[key]!r}") from None
            if not math.isfinite(number[key]):
                raise ValueError(f"{key} must be a finite number")
    if "sampling_rate" in number:
        out = replace(out, sampling_rate=clamp(number["sampling_rate"]), sampling_rate_auto=False)
    if "pii_min_confidence" in number:
        out = replace(out, pii_min_confidence=clamp(number["pii_min_confidence"]))
    if "simhash_bits" in number:
        out = replace(out, simhash_bits=int(number["simhash_bits"]) if number["simhash_bits"] in (64, 128) else 64)
    threshold = number.get("simhash_threshold", out.simhash_threshold)
    out = replace(out, simhash_threshold=int(clamp(threshold, 0, out.simhash_bits)))
    if "show_pii_samples" in raw:
        out = replace(out, show_pii_samples=bool(raw["show_pii_samples"]))
    return out


def load_config(scan_path: str, config_path: str | None = None) -> ScanConfig:
    """The config beside the data or at ``config_path``; a missing or broken file means the defaults."""
    path = config_path or os.path.join(scan_path, CONFIG_FILE)
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except FileNotFoundError:
        if config_path:
            warnings.warn(f"{config_path} is not there; defaults are used", stacklevel=2)
        return ScanConfig()
    except Exception as e:  # noqa: BLE001 - any unreadable file: not YAML, not UTF-8, no permission
        warnings.warn(f"{path} cannot be read ({e}); defaults are used", stacklevel=2)
        return ScanConfig()
    if raw is not None and not isinstance(raw, dict):
        warnings.warn(f"{path} is not a mapping; defaults are used", stacklevel=2)
    return from_mapping(raw)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, good for Java and RE2, for one glob."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 if pattern[i : i + 1] != "!" else i + 2)) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = f"^{body[1:]}" if body[:1] == "!" else f"\\{body}" if body[:1] == "^" else body
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)^(?:{''.join(out)})$"


def excluded(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether a relative path, or any of its components, matches one of the globs."""
    either = "|".join(glob_regex(p).removeprefix("(?s)") for p in patterns)
    if not either:
        return F.lit(False)
    return path.rlike(f"(?s){either}") | F.exists(F.split(path, "/"), lambda part: part.rlike(f"(?s){either}"))


def should_exclude(relative_path: str, patterns: tuple[str, ...] | list[str]) -> bool:
    """The same for one path on the driver, for pruning while walking."""
    parts = [relative_path, *relative_path.split("/")]
    return any(fnmatch.fnmatchcase(x, p) for p in patterns for x in parts)
