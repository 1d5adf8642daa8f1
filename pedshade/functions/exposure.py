"""Heat exposure of an edge and its routing cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pedshade.config import DEFAULT, SHADE_COLUMNS, Config


def _lit(x: float) -> Column:
    return F.lit(float(x))


def _unit(col: Column, name: str) -> Column:
    """The value, or an error if it is null, NaN or outside [0, 1]."""
    ok = col.isNotNull() & ~F.isnan(col) & (col >= 0) & (col <= 1)
    return F.when(ok, col).otherwise(F.raise_error(F.lit(f"{name} must lie in [0, 1]")).cast("double"))


def base_exposure(config: Config = DEFAULT, strict: bool = True, green: str = "green_score", water: str = "water_penalty") -> Column:
    """Exposure from greenery and water.  ``strict`` checks the inputs and holds the result in [0, 1]."""
    g, w = F.col(green), F.col(water)
    if strict:
        g, w = _unit(g, green), _unit(w, water)
    x = _lit(config.green_weight) * (_lit(1) - g) + _lit(config.water_weight) * w
    return F.least(_lit(1), F.greatest(_lit(0), x)) if strict else x


def shade_exposure(shade: Column, config: Config = DEFAULT, strict: bool = True) -> Column:
    s = _unit(shade, "shade score") if strict else shade
    k = config.shade_weight
    x = _lit(1 - k) * base_exposure(config, strict) + _lit(k) * (_lit(1) - s)
    return F.least(_lit(1), F.greatest(_lit(0), x)) if strict else x


def exposure(scenario: str | None, config: Config = DEFAULT, strict: bool = True) -> Column:
    """Exposure with a scenario's building shade, or without shade if it is None."""
    if scenario is None:
        return base_exposure(config, strict)
    if scenario not in SHADE_COLUMNS:
        raise ValueError(f"unsupported scenario {scenario!r}")
    return shade_exposure(F.col(SHADE_COLUMNS[scenario]), config, strict)


def edge_cost(mode: str, scenario: str | None = None, config: Config = DEFAULT, strict: bool = True) -> Column:
    """length * (1 + lambda * exposure); with lambda 0 exactly the length, the rest unread."""
    length = F.col("length")
    if strict:
        ok = length.isNotNull() & ~F.isnan(length) & (length >= 0) & (length < float("inf"))
        length = F.when(ok, length).otherwise(F.raise_error(F.lit("length must be finite and not negative")).cast("double"))
    lam = config.lam(mode)
    return length if lam == 0 else length * (_lit(1) + _lit(lam) * exposure(scenario, config, strict))
