"""Texts about a run: progress, duration, numbers."""

from __future__ import annotations


def progress(processed: int, total: int) -> int:
    """Whole per cent done; 0 of 0 is 0."""
    return processed * 100 // total if total > 0 else 0


def progress_events(total: int) -> list[int]:
    """The per cents a run over ``total`` records reports: 0 first, then each change once."""
    return list(dict.fromkeys([0, *(progress(i, total) for i in range(1, total + 1))])) if total > 0 else []


def duration(milliseconds: int) -> str:
    """``1h 2m 3s``; minutes show once there are hours."""
    s = milliseconds // 1000
    hours, minutes, seconds = s // 3600 % 24, s // 60 % 60, s % 60
    return (f"{hours}h " if hours else "") + (f"{minutes}m " if minutes or hours else "") + f"{seconds}s"


def brazilian(n: int) -> str:
    """A whole number with points between thousands."""
    return f"{n:,}".replace(",", ".")
