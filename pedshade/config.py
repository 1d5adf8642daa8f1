"""Model constants.  Overrides go through :meth:`Config.with_`, which checks them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

MODES = ("fastest", "balanced", "coolest")
SCENARIOS = ("09:00", "12:00", "15:00")
SHADE_COLUMNS = {"09:00": "shade_0900", "12:00": "shade_1200", "15:00": "shade_1500"}
SCENARIO_DATE, SCENARIO_ZONE = "2026-09-23", "Asia/Tokyo"

#: Two Earth radii are in use: snapping, and the sampler's straight distance.
SNAP_EARTH_RADIUS_M = 6_371_008.8
SAMPLER_EARTH_RADIUS_M = 6_371_000.0

#: Inclusive upper bounds in metres and the penalty up to each; farther is 1.
WATER_TIERS = ((100.0, 0.0), (300.0, 0.3), (500.0, 0.6))

#: (name, lower bound, upper bound); the last one includes its upper bound.
STRATA = (("short", 400.0, 1000.0), ("medium", 1000.0, 2000.0), ("long", 2000.0, 3500.0))

COORDINATE_SCALE = 10_000_000
SEARCH_GRID_DEGREES = 0.001
MAJOR_COMPONENT_NODES = 1000
RETAINED_COMPONENT_NODES = 25


@dataclass(frozen=True)
class Config:
    walking_speed: float = 1.4
    max_snap_m: float = 300.0
    green_weight: float = 0.7
    water_weight: float = 0.3
    shade_weight: float = 0.25
    balanced_lambda: float = 1.0
    coolest_lambda: float = 3.0
    max_extra_distance_ratio: float | None = None
    bbox: tuple[float, float, float, float] = (139.60, 35.55, 140.10, 36.05)

    def __post_init__(self) -> None:
        numbers = (self.green_weight, self.water_weight, self.balanced_lambda, self.coolest_lambda, self.max_snap_m)
        if not all(math.isfinite(x) and x >= 0 for x in numbers):
            raise ValueError("weights, lambdas and limits must be finite and not negative")
        if abs(self.green_weight + self.water_weight - 1) > 1e-12:
            raise ValueError("green and water weights must sum to 1")
        if not 0 <= self.shade_weight <= 1:
            raise ValueError("the shade weight must lie in [0, 1]")
        if not (math.isfinite(self.walking_speed) and self.walking_speed > 0):
            raise ValueError("walking speed must be positive")
        ratio = self.max_extra_distance_ratio
        if ratio is not None and not (math.isfinite(ratio) and ratio >= 0):
            raise ValueError("the detour ratio must be null or finite and not negative")
        west, south, east, north = self.bbox
        if not (west < east and south < north):
            raise ValueError("the bounding box is reversed")

    def with_(self, **overrides) -> Config:
        return replace(self, **overrides)

    def lam(self, mode: str) -> float:
        try:
            return {"fastest": 0.0, "balanced": self.balanced_lambda, "coolest": self.coolest_lambda}[mode]
        except KeyError:
            raise ValueError(f"unknown routing mode {mode!r}") from None


DEFAULT = Config()
