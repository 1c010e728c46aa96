"""Mortality indicator: deaths of facilities and disease codes per 100,000 persons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_code(c: Column) -> Column:
    """Trimmed, upper case, without its first dot."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\A([^.]*)\.", "$1")


def respiratory(c: Column) -> Column:
    """Codes J, U07.1 and U07.2; null is not one."""
    k = clean_code(c)
    return F.coalesce(k.startswith("J") | k.isin("U071", "U072"), F.lit(False))


def tuberculosis_or_respiratory(c: Column) -> Column:
    return F.coalesce(F.substring(clean_code(c), 1, 3).isin("A15", "A16", "A17", "A18", "A19"), F.lit(False)) | respiratory(c)


def deaths(df: DataFrame, facilities: Sequence[str], facility: str = "CODESTAB", cause: str = "CAUSABAS", lines: Sequence[str] = ("LINHAA", "LINHAB", "LINHAC", "LINHAD", "LINHAII")) -> DataFrame:
    """Certificates of the facilities whose cause, or any line, is of the disease."""
    tests = [respiratory(F.col(cause))] if cause in df.columns else []
    tests += [tuberculosis_or_respiratory(F.col(x)) for x in lines if x in df.columns]
    return df.where(F.col(facility).isin(*facilities)).where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def rate(cases: DataFrame, population: int) -> DataFrame:
    """(deaths, rate): deaths and deaths per 100,000; no population gives a null rate."""
    per = F.lit(100000.0 / population) if population > 0 else F.lit(None).cast("double")
    return cases.agg(F.count(F.lit(1)).alias("deaths")).select("deaths", (F.col("deaths") * per).alias("rate"))
