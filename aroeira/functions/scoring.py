"""Block keys, field comparison and link scores as expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def key_text(df: DataFrame, field: str) -> Column:
    """A field as text in a key; null and absent are empty, 1.0 reads as 1."""
    kind = dict(df.dtypes).get(field)
    if kind is None:
        return F.lit("")
    c = F.col(f"`{field}`")
    if kind in ("float", "double"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        text = F.when(F.isnan(d), F.lit("")).when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def block_key(df: DataFrame, fields: Sequence[str]) -> Column:
    """Fields joined by ``_``, separators kept where a field is empty."""
    return F.concat_ws("_", *(key_text(df, f) for f in fields)) if fields else F.lit("")


def same(cohort: DataFrame, target: DataFrame, a: str, b: str) -> Column:
    """Whether cohort.a equals target.b: null equals null, text never equals a number.

    A field absent from both sides is equal, from one side it is not; not-a-number
    counts as null.
    """
    ka, kb = dict(cohort.dtypes).get(a), dict(target.dtypes).get(b)
    if ka is None or kb is None:
        return F.lit(ka is None and kb is None)
    x, y = F.col(f"cohort.`{a}`"), F.col(f"target.`{b}`")
    if ka in NUMBERS and kb in NUMBERS:
        real = lambda c, k: F.nanvl(c, F.lit(None).cast(k)) if k in ("float", "double") else c
        x, y = real(x, ka), real(y, kb)
        return x.eqNullSafe(y) if ka == kb else x.cast("double").eqNullSafe(y.cast("double"))
    return x.eqNullSafe(y) if ka == kb else x.isNull() & y.isNull()


def _number(w: object) -> bool:
    return isinstance(w, (int, float)) and not isinstance(w, bool)


def simple_weights(on: Mapping[str, str], weights: Mapping[str, object] | None) -> dict[str, float]:
    """A number is a field's weight; anything else, or nothing, weighs 1."""
    return {f: float(w) if _number(w := (weights or {}).get(f)) else 1.0 for f in on}


def log2_ratio(a: float, b: float) -> float:
    """log2(a / b) with infinities instead of errors."""
    if b == 0:
        if a == 0 or math.isnan(a):
            return math.nan
        q = math.copysign(math.inf, a)
    else:
        q = a / b
    if math.isnan(q) or q < 0:
        return math.nan
    return -math.inf if q == 0 else math.log2(q)


def fellegi_sunter_weights(on: Mapping[str, str], weights: Mapping[str, object] | None) -> dict[str, tuple[float, float]]:
    """(agreement, disagreement) per field.

    {m, u} gives log-likelihood ratios, {agreement, disagreement} is taken as it is,
    a number or nothing gives +1 and -1, any other object 0 and 0.
    """
    out = {}
    for f in on:
        w = (weights or {}).get(f)
        if w is None or _number(w):
            out[f] = (1.0, -1.0)
        elif "m" in w and "u" in w:
            out[f] = (log2_ratio(w["m"], w["u"]), log2_ratio(1 - w["m"], 1 - w["u"]))
        elif "agreement" in w and "disagreement" in w:
            out[f] = (float(w["agreement"]), float(w["disagreement"]))
        else:
            out[f] = (0.0, 0.0)
    return out


def falsy(x: float | None) -> bool:
    return x is None or x == 0 or math.isnan(x)


def weighted(tests: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weight of the equal fields as a share of all weight; 0 if that is not positive."""
    total = sum(weights.values())
    if not total > 0:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, (F.when(t, F.lit(weights[f])).otherwise(F.lit(0.0)) for f, t in tests.items())) / F.lit(total)


def fellegi_sunter(tests: Mapping[str, Column], weights: Mapping[str, tuple[float, float]]) -> Column:
    parts = [F.when(t, F.lit(weights[f][0])).otherwise(F.lit(weights[f][1])) for f, t in tests.items()]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))
