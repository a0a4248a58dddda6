"""Constants that change results, and the static dimension of conditions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Length of a frame, size of a pixel, and how much farther than the nearest a neighbour may be.
    frame_s: float = 0.82817
    pixel_mm: float = 0.0324
    neighbour_factor: float = 1.3
    gap_fill_us: int = 6 * 3600 * 1_000_000
    long_gap_us: int = 6 * 3600 * 1_000_000
    cut_us: int = 20 * 86400 * 1_000_000
    merge_gap_us: int = 2 * 86400 * 1_000_000


CONFIG = Config()

#: The region that each kind of event stands for; -1 is outside of all regions.
REGIONS = {"view": -1, "click": 0, "error": 1, "purchase": 2, "signup": 3}

#: Condition ids by density and layout.
CONDITIONS = {
    "0": {"close": 17, "med": 18, "far": 19, "superfar": 20, "cluster": 21},
    "0.2": {"close": 0, "med": 1, "far": 2, "superfar": 14, "cluster": 3},
    "0.5": {"close": 4, "med": 5, "far": 6, "superfar": 15, "cluster": 7},
    "1.25": {"close": 12, "med": 8, "far": 13, "superfar": 16},
    "0.2+0.5": {"med": 9},
    "0.5+1.25": {"med": 10},
}
#: Regions of a plate by layout.
PATCHES = {"close": 52, "med": 24, "far": 7, "superfar": 3, "cluster": 25}
