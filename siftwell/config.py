"""Frozen registries and constants of the corpus and the audit, with a hash that stamps results."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from datetime import UTC, datetime

# Fixed values of the study design.
STRATA = tuple(f"S{i}" for i in range(1, 13))
CALIBRATION = "S6"
FORECAST = ("S10", "S11", "S12")
FIT = tuple(s for s in STRATA if s not in FORECAST)
PAIRS = (("S3", "S4"), ("S5", "S6"))
TARGET_FPR = 0.05
SEED = 42
CUTOFF_YEAR = 2021
MIN_TOKENS, MAX_TOKENS, LENGTH_BINS = 150, 400, 5
DOCS_PER_STRATUM = 1000
SOURCE_CAP = 3
SOURCE_CAPS = {"pelic": 4, "ami": 8}
SIMILARITY = 0.8
INTENSITIES = (0.25, 0.5, 1.0)
DOCS_PER_EDIT = 300
MIN_AUROC = 0.80
FLIPPABLE = ("D5",)
TRAINED = ("D3", "D4", "D5")
# The distribution each instance measures distance from.
FAMILIES = {
    "D1@R1": "WebText", "D1@R2": "Pile", "D1@R3": "Pile", "D1@R4": "OLMo mix", "D1@R5": "multilingual web",
    "D2@R4": "OLMo mix", "D2@R5": "multilingual web", "D3": "gpt2 outputs", "D4": "hc3", "D5": "adversarial",
}
# Thresholds of the registered analysis.
ANALYSIS = {
    "alpha": 0.05, "min_delta_r2": 0.10, "fail_delta_r2": 0.05, "max_attenuation": 0.30, "max_mae": 0.10, "partial_mae": 0.15,
    "min_skill": 0.25, "max_slope_ratio": 0.25, "length_spread": 0.03,
}
PREDICTOR = "independent"


def settings() -> dict:
    """Every constant of this module, as plain values."""
    plain = (str, int, float, tuple, dict)
    return {k: v for k, v in sorted(globals().items()) if k.isupper() and isinstance(v, plain)}


def config_hash() -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the settings in canonical JSON."""
    return hashlib.sha256(json.dumps(settings(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def check_independence() -> None:
    """The predictor is no detector, pairs are declared strata, and the calibration stratum is not held out."""
    if PREDICTOR in FAMILIES or PREDICTOR in set(FAMILIES.values()):
        raise AssertionError("the independent predictor also serves a detector")
    if not {s for pair in PAIRS for s in pair} <= set(STRATA):
        raise AssertionError("a pair names an unknown stratum")
    if CALIBRATION in FORECAST:
        raise AssertionError("the calibration stratum is held out")


def run_id(now: datetime | None = None, tag: str = "") -> str:
    """UTC time and a short digest, so that text order is the order of runs."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S")
    return f"{stamp}-{hashlib.sha256((stamp + tag).encode()).hexdigest()[:6]}"


def provenance() -> dict:
    """What made a result: package version, settings, revision, Python and time."""
    from siftwell import __version__

    try:
        revision = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        revision = "unknown"
    return {"package_version": __version__, "config_hash": config_hash(), "git_sha": revision, "python": platform.python_version(), "utc": datetime.now(UTC).isoformat(timespec="seconds")}


check_independence()
