"""Only new files: a structured stream over landed records.

Each run with ``available_now`` takes the files that came since the last one, filters
and parses them, and appends the result; its checkpoint remembers what was taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.criteria import CriteriaSet


def landed(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest(stream: DataFrame, criteria: CriteriaSet, parser: Callable[[DataFrame], DataFrame] | None, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the filtered, parsed records of new files to ``sink`` and stops."""
    kept = criteria.filter(stream)
    out = parser(kept) if parser else kept
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, time: str, by: str, late: str = "2 days") -> DataFrame:
    """Records per day and ``by`` in event time; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count(F.lit(1)).alias("records"))
