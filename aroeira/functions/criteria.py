"""Serialisable filters: equality and membership criteria, conjunctions of them.

A criterion compares text only, exactly and case-sensitively.  On a column that is
absent or not text it holds for no row.  :meth:`CriteriaSet.set` merges criteria on
the same column into the union of their values; loading from dictionaries does not
merge, so two different equalities on one column then contradict each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text_column(df: DataFrame, prop: str) -> Column | None:
    """The column named exactly ``prop`` if it is there and holds text."""
    return F.col(f"`{prop}`") if dict(df.dtypes).get(prop) == "string" else None


@dataclass(frozen=True)
class StringCriteria:
    value: str
    prop: str

    def column(self, df: DataFrame) -> Column:
        c = _text_column(df, self.prop)
        return F.lit(False) if c is None else c == F.lit(self.value)

    def to_dict(self) -> dict:
        return {"type": "string", "prop": self.prop, "value": self.value}


@dataclass(frozen=True)
class ArrayCriteria:
    values: tuple[str, ...]
    prop: str

    def __init__(self, values: Sequence[str], prop: str) -> None:
        object.__setattr__(self, "values", tuple(values))
        object.__setattr__(self, "prop", prop)

    def column(self, df: DataFrame) -> Column:
        c = _text_column(df, self.prop)
        return F.lit(False) if c is None or not self.values else c.isin(*self.values)

    def to_dict(self) -> dict:
        return {"type": "array", "prop": self.prop, "value": list(self.values)}


@dataclass(frozen=True)
class CustomCriteria:
    """A predicate of the caller's own; it works in process but cannot be serialised whole."""

    predicate: Callable[[DataFrame], Column]
    name: str = "CUSTOM_FILTER"

    def column(self, df: DataFrame) -> Column:
        return self.predicate(df)

    def to_dict(self) -> dict:
        return {"type": "string", "prop": self.name.removesuffix("_FILTER"), "value": None}


Criterion = StringCriteria | ArrayCriteria | CustomCriteria


class CriteriaSet:
    """A conjunction; the empty one holds for every row."""

    def __init__(self, criteria: Iterable[Criterion] = ()) -> None:
        self._criteria = list(criteria)

    @classmethod
    def set(cls, criteria: Iterable[Criterion]) -> CriteriaSet:
        """Criteria on one column become one criterion over all their values."""
        merged: dict[str, dict[str, None]] = {}
        custom: list[Criterion] = []
        for c in criteria:
            if isinstance(c, CustomCriteria):
                custom.append(c)
            else:
                values = (c.value,) if isinstance(c, StringCriteria) else c.values
                merged.setdefault(c.prop, {}).update(dict.fromkeys(values))
        plain = [StringCriteria(*v, p) if len(v) == 1 else ArrayCriteria(list(v), p) for p, v in merged.items()]
        return cls([*plain, *custom])

    @classmethod
    def from_dict(cls, objects: Iterable[dict]) -> CriteriaSet:
        return cls(StringCriteria(o["value"], o["prop"]) if o["type"] == "string" else ArrayCriteria(o["value"], o["prop"]) for o in objects)

    def to_dict(self) -> list[dict]:
        return [c.to_dict() for c in self._criteria]

    def is_empty(self) -> bool:
        return not self._criteria

    def values(self) -> list[Criterion]:
        return list(self._criteria)

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (c.column(df) for c in self._criteria), F.lit(True))

    def filter(self, df: DataFrame) -> DataFrame:
        return df if self.is_empty() else df.where(self.column(df))
