"""Thresholds for well-known public data sets: format, least information gain, least step, least gap of a loop closure."""

from __future__ import annotations

from typing import NamedTuple


class Preset(NamedTuple):
    #: The ending of its files: g2o, graph (TORO) or snapshot.
    format: str
    entropy_threshold: float
    dx_threshold: float
    loop_gap: int


# Fixed values.
PRESETS = {
    "MIT": Preset("g2o", 1.0, 1e-3, 4),
    "Intel": Preset("g2o", 0.72, 1e-6, 4),
    "CSAIL": Preset("graph", 0.95, 1e-5, 4),
    "FR079": Preset("graph", 0.6, 1e-4, 4),
    "FRH": Preset("graph", 0.45, 1e-7, 1),
    "MITP": Preset("snapshot", 1.0, 1e-3, 4),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown data set: {name}")
    return PRESETS[name]
