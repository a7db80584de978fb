"""Interval texts and bar counts, on the driver."""

from __future__ import annotations

import re

#: Hours of the units of an interval text.
UNIT_HOURS = {"s": 1 / 3600, "sec": 1 / 3600, "m": 1 / 60, "min": 1 / 60, "t": 1 / 60, "h": 1.0, "hour": 1.0, "hours": 1.0, "d": 24.0, "day": 24.0, "days": 24.0, "w": 168.0}


def interval_hours(text: str, default: float | None = None) -> float:
    """Hours of `4h`, `15m`, `1D`, `30min` and the like; an unreadable text gives the default or raises."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([A-Za-z]+)\s*", text or "")
    unit = UNIT_HOURS.get(m.group(2).lower()) if m else None
    if unit is None or (m.group(1) and float(m.group(1)) <= 0):
        if default is None:
            raise ValueError(f"not an interval: {text!r}")
        return default
    return float(m.group(1) or 1) * unit


def bars_of(hours: float, step_hours: float, least: int = 1) -> int:
    """Bars in so many hours, rounded half to even, at least `least`."""
    return max(least, int(round(hours / step_hours)))


def step_hours(freq_per_year: float) -> float:
    """Hours of a step of which a year of 365 days has so many."""
    return 24.0 * 365.0 / freq_per_year
