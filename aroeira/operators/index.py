"""Index operators: a multimap from block key to rows, as tables and joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import block_key


def build(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(key, value): one row per indexed record; records with an empty key are left out."""
    return df.select(block_key(df, fields).alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("value")).where("key <> ''")


def entries(index: DataFrame) -> DataFrame:
    """(key, n): how many records each key holds."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def get(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of the asked keys; a key without records gives none."""
    return index.join(keys.select("key").distinct(), "key", "left_semi")


def has(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found) of each distinct asked key; null is never found."""
    known = index.select("key").distinct().withColumn("hit", F.lit(True))
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


def full_chunks(records: int, chunk_size: int = 1000) -> int:
    """How many full chunks a chunked build announces."""
    if chunk_size < 1:
        raise ValueError("a chunk holds at least one record")
    return records // chunk_size


def persist(index: DataFrame, table_name: str, buckets: int, append: bool = False) -> None:
    """The index as a table bucketed by key; later joins on it need no shuffle.

    It replaces an earlier one unless told to append.
    """
    index.write.mode("append" if append else "overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table_name)


class Index(Protocol):
    """What a linkage needs of an index: the keyed cohort, laid out."""

    def built(self, keyed: DataFrame) -> DataFrame: ...


@dataclass
class ExternalIndex:
    """The cohort as a table bucketed by block key, kept outside the run; joins on it do not shuffle it.

    ``path``: a folder of shared storage, the session's warehouse by default.  It replaces
    an earlier table of the name, so a second run finds no doubled candidates.
    """

    table: str
    buckets: int = 200
    path: str | None = None

    def built(self, keyed: DataFrame) -> DataFrame:
        writer = keyed.write.mode("overwrite").bucketBy(self.buckets, "block_key").sortBy("block_key")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)
        return keyed.sparkSession.table(self.table)

    def drop(self, spark) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


@dataclass
class ChunkedIndex:
    """A sorted index that tells of every full chunk of ``chunk_size`` records: (number of the chunk, records so far)."""

    chunk_size: int = 1000
    on_chunk: Callable[[int, int], None] | None = None

    def built(self, keyed: DataFrame) -> DataFrame:
        if self.on_chunk is not None:
            for i in range(1, full_chunks(keyed.count(), self.chunk_size) + 1):
                self.on_chunk(i, i * self.chunk_size)
        return keyed.hint("merge")
