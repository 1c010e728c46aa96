"""Catalogues of files as DataFrames: prefix selection, de-duplication, chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

T = TypeVar("T")


def unique(names: Sequence[T]) -> list[T]:
    """First occurrences, in order."""
    return list(dict.fromkeys(names))


def chunks(items: Sequence[T], size: int) -> list[list[T]]:
    """Pieces of ``size`` in order, the last one shorter."""
    if size < 1:
        raise ValueError("a chunk holds at least one item")
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def select(catalog: DataFrame, prefixes: Sequence[str], name: str = "name") -> DataFrame:
    """Entries whose name starts with a prefix, with ``prefix_no``, the prefix's place.

    An entry comes once per prefix it starts with.  Prefixes are met by equality on
    the leading characters, one join per length of prefix.
    """
    spark = catalog.sparkSession
    parts = []
    for n in sorted({len(p) for p in prefixes}):
        rows = [(p, i) for i, p in enumerate(prefixes) if len(p) == n]
        wanted = spark.createDataFrame(rows, "lead string, prefix_no int")
        parts.append(catalog.withColumn("lead", F.substring(name, 1, n)).join(wanted, "lead").drop("lead"))
    if not parts:
        return catalog.withColumn("prefix_no", F.lit(0)).where(F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_files(listing: DataFrame, name: str = "name", position: str = "pos") -> DataFrame:
    """(name, pos): each name once, at its first position."""
    return listing.groupBy(name).agg(F.min(position).alias(position))


def numbered_chunks(files: DataFrame, size: int, position: str = "pos") -> DataFrame:
    """Files with ``chunk``, the number of their chunk in order of position.

    Positions become dense ranks from counts per range of positions, so no task
    orders the whole catalogue.
    """
    if size < 1:
        raise ValueError("a chunk holds at least one item")
    ranged = files.withColumn("__range", F.floor(F.col(position) / 65536))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(position)) - 1
    return ranged.withColumn("__rank", rank).join(before.select("__range", "before"), "__range").withColumn("chunk", F.floor((F.col("before") + F.col("__rank")) / size)).drop("__range", "__rank", "before")
