"""Thresholds, in microseconds or plain units, and the names that columns may hold."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

SECOND = 1_000_000
#: a piece of this length or less is a sliver
EPS_US = 1
LAYOUTS = ("cam_full", "pip", "screen_full")
VISIBLE = ("pip", "screen_full")


@dataclass(frozen=True)
class Settings:
    """Fixed values of the domain: results depend on them."""

    click_pre: int = 400_000
    click_post: int = 1_800_000
    move_pre: int = 300_000
    move_post: int = 1_500_000
    click_gap: int = 2_500_000
    click_distance: float = 0.15
    merge_gap: int = 800_000
    zoom_min: int = 1_000_000
    zoom_max: int = 6_000_000
    zoom_level: float = 1.5
    move_window: int = 1_500_000
    move_step: float = 0.02
    move_total: float = 0.08
    shake_window: int = 150_000
    shake_distance: float = 0.99
    stop_padding: int = 500_000
    hint_tolerance: int = 500_000
    agree_gap: int = 500_000
    agree_min: int = 2_000_000
    idle_min: int = 2_000_000
    cut_min: int = 10_000_000
    fast_min: int = 3_000_000
    scroll_pre: int = 200_000
    scroll_post: int = 600_000
    scroll_min: int = 600_000
    scroll_max: int = 4_000_000
    topic_gap: int = 15_000_000
    chunk: int = 60_000_000
    snap_px: float = 150.0

    @classmethod
    def from_env(cls, prefix: str = "TEMPOGRAPH_") -> Settings:
        """Defaults overridden by environment variables, cast to each field's type."""
        found = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**found)


DEFAULTS = Settings()
#: zoom for a hint's strength, and for any other strength
STRENGTH = {"soft": 1.25, "normal": 1.5, "strong": 1.7}
#: numbers of sentences compared on both sides of a gap
SCALES = (5, 7, 11, 17, 37, 53, 73, 97)
