"""Checks of what a user passes in."""

from __future__ import annotations

from typing import Any


def checked_int(name: str, value: Any, least: int, optional: bool = False) -> int | None:
    """``value`` as a whole number from ``least`` on, or None where that is allowed."""
    if optional and value is None:
        return None
    if type(value) is not int:
        raise TypeError(f"{name}: expected a whole number, got {value!r}")
    if value < least:
        raise ValueError(f"{name}: {value} is below {least}")
    return value


def checked_seconds(name: str, value: Any, above: float | None = None, finite: bool = False) -> float:
    """``value``, a number or a timedelta, in seconds."""
    seconds = getattr(value, "total_seconds", None)
    if seconds is None and type(value) not in (int, float):
        raise TypeError(f"{name}: expected seconds or a timedelta, got {value!r}")
    found = float(value) if seconds is None else seconds()
    if found != found or (above is not None and found <= above) or (finite and abs(found) == float("inf")):
        raise ValueError(f"{name}: {value!r} is out of range")
    return found
