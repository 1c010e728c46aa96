"""Where matches go: a repository of matches, and a callback over records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class MatchRepository:
    """Matches kept in the session: ``save`` appends, ``all`` gives everything saved, ``clear`` forgets it."""

    def __init__(self) -> None:
        self._saved: list[DataFrame] = []

    def save(self, matches: DataFrame) -> None:
        self._saved.append(matches)

    def all(self) -> DataFrame | None:
        """All saved matches, None if nothing was saved."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._saved) if self._saved else None

    def clear(self) -> None:
        self._saved = []


class StoredMatchRepository:
    """Matches as documents in a folder of shared storage; ``save`` appends files, whole rows as JSON."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def save(self, matches: DataFrame) -> None:
        matches.select(*(F.to_json(c).alias(c) if "struct" in k else F.col(c) for c, k in matches.dtypes)).write.mode("append").parquet(self.folder)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.all().schema).write.mode("overwrite").parquet(self.folder)


def for_each(records: DataFrame, callback: Callable[[Row], object]) -> None:
    """Calls ``callback`` with every record, in the tasks that hold them; an error in it fails the run."""

    def run(rows) -> None:
        for r in rows:
            callback(r)

    records.foreachPartition(run)
