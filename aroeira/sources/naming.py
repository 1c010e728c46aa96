"""Prefixes of file names that a subset selects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Protocol


class NamingStrategy(Protocol):
    def prefixes(self, subset: Mapping) -> list[str]: ...


def _listed(x: object) -> bool:
    return isinstance(x, Sequence) and not isinstance(x, str)


class StatePeriod:
    """Source, state, yymm: months outermost, both ends included.

    Years before 2008 or after this one and months outside 1 to 12 are an error; a
    start after the end selects nothing.  Without a period all months are meant,
    without states the whole source.
    """

    def prefixes(self, subset: Mapping) -> list[str]:
        src, states, period = subset["src"], subset.get("states"), subset.get("period")
        if states is None:
            return [src]
        if period is None:
            return [f"{src}{s}" for s in states]
        (y0, m0), (y1, m1) = ((int(period[k]["year"]), int(period[k]["month"])) for k in ("start", "end"))
        if y0 < 2008 or y1 > date.today().year or not (1 <= m0 <= 12 and 1 <= m1 <= 12):
            raise ValueError("Invalid Period.")
        months = range(y0 * 12 + m0 - 1, y1 * 12 + m1)
        return [f"{src}{s}{k // 12 % 100:02d}{k % 12 + 1:02d}" for k in months for s in states]


class StateYear:
    """Source, state, year of four digits: states outermost."""

    def prefixes(self, subset: Mapping) -> list[str]:
        src, states, years = subset["src"], subset.get("states"), subset.get("year")
        if states is None:
            return [src]
        return [f"{src}{s}{y}" for s in states for y in years] if _listed(years) else [f"{src}{s}" for s in states]


class CountryYear:
    """Source, BR, year of two digits."""

    def prefixes(self, subset: Mapping) -> list[str]:
        years = subset.get("year")
        return [f"{subset['src']}BR{str(y)[-2:]}" for y in years] if _listed(years) else [subset["src"]]
