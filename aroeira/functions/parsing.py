"""Row transforms applied after filtering, as projections."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Dictionary = Mapping[str, Callable[[Column], Column]]


def dictionary(mapping: Dictionary) -> Callable[[DataFrame], DataFrame]:
    """Replaces each present field by its function of it; absent fields are not created."""

    def parse(df: DataFrame) -> DataFrame:
        return df.withColumns({f: fn(F.col(f"`{f}`")) for f, fn in mapping.items() if f in df.columns})

    return parse


def concat_and_drop(field: str, appended: str, mapping: Dictionary | None = None) -> Callable[[DataFrame], DataFrame]:
    """``field`` becomes ``field`` + ``appended``, which is dropped; then the dictionary.

    A null part counts as empty; if either field is absent nothing is joined.
    """

    def parse(df: DataFrame) -> DataFrame:
        if field in df.columns and appended in df.columns:
            empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
            df = df.withColumn(field, F.concat(empty(field), empty(appended))).drop(appended)
        return dictionary(mapping or {})(df)

    return parse


def rename(names: Mapping[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Only the named fields, under their new names."""
    return lambda df: df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))


def constant(name: str, value: object) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(name, F.lit(value))


def hex_text(c: Column) -> Column:
    """UTF-8 bytes of a text in lower-case hexadecimal."""
    return F.lower(F.hex(F.encode(c, "UTF-8")))


#: Financing type joined with its sub-type, as in the outpatient files.
outpatient = concat_and_drop("TPFIN", "SUBFIN")
