"""A run over many files: select, scan, filter, parse, summarise.

One lazy plan takes the place of a process per file: the scan has a task per file,
and filter, parser and sink are part of the plan.  A failed file fails the run.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.criteria import CriteriaSet
from ..sources import catalog
from ..sources.datasource import register


class DbcProvider:
    """Files as a linkage service; a subset means nothing to a file and is passed over with a warning."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def subset(self, subset: object) -> DbcProvider:
        warnings.warn("a provider of files has no subsets: all its records are read", stacklevel=2)
        return self

    def exec(self) -> DataFrame:
        register(self.spark)
        return self.spark.read.format("dbc").load(self.path)


@dataclass(frozen=True)
class RunConfig:
    data_path: str = "./"
    concurrency: int = 2
    verbose: bool = True
    filters: CriteriaSet = field(default_factory=CriteriaSet)
    parser: Callable[[DataFrame], DataFrame] | None = None
    scan: Callable[[SparkSession, list[str]], DataFrame] | None = None


FILTERS = "array<struct<type:string,prop:string,value:array<string>>>"


class FailToScheduleJob(RuntimeError):
    """A chunk of files that could not be run, with its files."""

    def __init__(self, error: Exception, chunk: list[str]) -> None:
        super().__init__(f"files {', '.join(chunk)} failed: {error}")
        self.error, self.chunk = error, chunk


def filters_column(criteria: CriteriaSet) -> Column:
    """The criteria as an array of (type, prop, value), one value or many."""
    rows = [(o["type"], o["prop"], o["value"] if isinstance(o["value"], list) else [] if o["value"] is None else [o["value"]]) for o in criteria.to_dict()]
    text = lambda x: F.lit(x).cast("string")
    return F.array(*(F.struct(text(k).alias("type"), text(p).alias("prop"), F.array(*map(text, v)).cast("array<string>").alias("value")) for k, p, v in rows)).cast(FILTERS)


def file_summary(rows: DataFrame, criteria: CriteriaSet, file: str = "file") -> DataFrame:
    """(file, total, founds, errors, filters) of each file, in one pass; a run that ends has no errors."""
    kept = criteria.column(rows)
    counts = rows.groupBy(file).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(kept, 1)).alias("founds"))
    return counts.select(file, "total", "founds", F.lit(0).cast("bigint").alias("errors"), filters_column(criteria).alias("filters"))


def global_summary(summaries: DataFrame) -> DataFrame:
    """Sums of all files' summaries and the number of files."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return summaries.agg(F.count(F.lit(1)).alias("files"), whole("total"), whole("founds"), whole("errors"))


def scan_dbc(spark: SparkSession, files: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("dbc").option("path", ",".join(files)).option("file_column", "file").load()


class Orchestrator:
    """``Orchestrator(spark, gateway, config).subset(s).exec()`` gives the parsed rows.

    Calling ``exec`` again evaluates the same plan again.
    """

    def __init__(self, spark: SparkSession, gateway, config: RunConfig = RunConfig()) -> None:
        self.spark, self.gateway, self.config = spark, gateway, config
        self.files: list[str] = []
        self._landed: set[str] = set()

    def subset(self, subset: Mapping) -> Orchestrator:
        self.files = catalog.unique(self.gateway.list(subset, "short"))
        return self

    @property
    def chunks(self) -> list[list[str]]:
        return catalog.chunks(self.files, self.config.concurrency)

    def _land(self, files: list[str]) -> list[str]:
        """Paths of the files, fetched where they are not there yet, ``concurrency`` at a time."""
        missing = [f for f in files if f not in self._landed]
        with ThreadPoolExecutor(max(1, self.config.concurrency)) as pool:
            list(pool.map(lambda f: self.gateway.get(f, self._place(f)), missing))
        self._landed.update(missing)
        return [self._place(f) for f in files]

    def _place(self, file: str) -> str:
        return str(Path(self.config.data_path) / file)

    def rows(self, files: list[str] | None = None) -> DataFrame | None:
        """The raw rows of the files (all of the subset by default), None if there are none."""
        landed = self._land(self.files if files is None else files)
        return (self.config.scan or scan_dbc)(self.spark, landed) if landed else None

    def run(self, sink: Callable[[DataFrame], object], parser: Callable[[DataFrame], DataFrame] | None = None, on_error: Callable[[FailToScheduleJob, list[str]], object] | None = None) -> int:
        """Hands the parsed rows to ``sink`` chunk by chunk; the number of files that went through.

        A chunk that fails is raised as :class:`FailToScheduleJob`, or given to ``on_error``
        with its files, and the next chunk follows.
        """
        done = 0
        for chunk in self.chunks:
            try:
                sink(self._parsed(self.rows(chunk), parser))
                done += len(chunk)
            except Exception as e:
                failed = FailToScheduleJob(e, chunk)
                if on_error is None:
                    raise failed from e
                on_error(failed, chunk)
        return done

    def _parsed(self, rows: DataFrame, parser: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        kept = self.config.filters.filter(rows)
        parse = parser or self.config.parser
        return parse(kept) if parse else kept

    def exec(self, parser: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], "file string")
        return self._parsed(rows, parser)

    def summary(self) -> DataFrame:
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], "file string, total bigint, founds bigint, errors bigint, filters " + FILTERS)
        return file_summary(rows, self.config.filters)

    def write_summary(self, folder: str) -> None:
        """One JSON object a line, appended."""
        self.summary().write.mode("append").json(folder)
