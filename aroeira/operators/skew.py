"""Per-key results where a few keys hold most records.

Loads are estimated first (one narrow aggregate, no rows move).  Keys above the
load of a task are *heavy*: each is cut into shards in proportion to its load.
All other keys fall into a fixed number of small bins by hash, and shards and bins
are packed onto tasks, largest first.  Rows then move once, straight to their
task; the matching side of a join is replicated only to the shards of its key.

The driver sees at most one line per task for heavy keys (a key above the load of
a task exists at most once per task) plus ``BINS_PER_TASK`` lines per task for
bins, whatever the number of rows or keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, parallelism

BINS_PER_TASK = 8


@dataclass(frozen=True)
class ShardPlan:
    """Heavy keys (group, key, tasks of its shards in order) and the task of each bin."""

    tasks: int
    heavy: tuple[tuple[str, str | None, tuple[int, ...]], ...]
    bins: tuple[int, ...]

    def heavy_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(g, k, list(t)) for g, k, t in self.heavy]
        return spark.createDataFrame(rows, "h_group string, h_key string, h_tasks array<int>")


def _bin(group: Column, key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(group, key), F.lit(bins)).cast("int")


def pack(loads: Sequence[tuple[object, int]], tasks: int) -> dict[object, int]:
    """Largest-first packing of (name, load) onto the least loaded of ``tasks``."""
    heap = [(0, t) for t in range(tasks)]
    placed = {}
    for name, load in sorted(loads, key=lambda x: (-x[1], repr(x[0]))):
        total, t = heapq.heappop(heap)
        placed[name] = t
        heapq.heappush(heap, (total + load, t))
    return placed


def plan_shards(keyed: DataFrame, group: str, key: str, tasks: int) -> ShardPlan:
    """Shards and bins of ``keyed`` from its exact key loads (a map-side combined count)."""
    bins = tasks * BINS_PER_TASK
    loads = keyed.groupBy(group, key).agg(F.count(F.lit(1)).alias("load"))
    loads = loads.withColumn("bin", _bin(F.col(group), F.col(key), bins))
    total = loads.agg(F.sum("load").alias("total"))
    marked = loads.crossJoin(F.broadcast(total)).withColumn("heavy", F.col("load") * tasks > F.col("total"))
    rows = (
        marked.groupBy(F.when(F.col("heavy"), F.struct(group, key)).alias("k"), F.when(~F.col("heavy"), F.col("bin")).alias("bin"))
        .agg(F.sum("load").alias("load"), F.max("total").alias("total"))
        .collect()
    )
    size = max(1, (rows[0]["total"] if rows else 0) // tasks // 2)
    items: list[tuple[object, int]] = []
    counts: dict[tuple, int] = {}
    for r in rows:
        if r["k"] is not None:
            k = (r["k"][0], r["k"][1])
            counts[k] = -(-r["load"] // size)
            items += [((k, i), r["load"] // counts[k]) for i in range(counts[k])]
        else:
            items.append((r["bin"], r["load"]))
    placed = pack(items, tasks)
    heavy = tuple((k[0], k[1], tuple(placed[(k, i)] for i in range(n))) for k, n in sorted(counts.items(), key=repr))
    return ShardPlan(tasks, heavy, tuple(placed.get(b, b % tasks) for b in range(bins)))


def to_tasks(df: DataFrame, plan: ShardPlan, group: str, key: str, spread: Column, replicate: bool = False) -> DataFrame:
    """``df`` moved to the plan's tasks with columns ``task`` and ``shard``.

    ``spread`` chooses the shard of a heavy key's row, so equal ``spread`` stay
    together.  With ``replicate`` a row goes to every shard of its key instead: the
    matching side of a join.  The broadcast table has at most ``plan.tasks`` rows.
    """
    h = F.broadcast(plan.heavy_frame(df.sparkSession))
    j = df.join(h, (df[group] == h["h_group"]) & df[key].eqNullSafe(h["h_key"]), "left")
    shards = F.size("h_tasks")
    # one folded literal, however many bins there are
    at = F.split(F.lit(",".join(map(str, plan.bins))), ",")[_bin(F.col(group), F.col(key), len(plan.bins))].cast("int")
    if replicate:
        j = j.withColumn("shard", F.explode(F.when(F.col("h_tasks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), shards - 1))))
    else:
        j = j.withColumn("shard", F.when(F.col("h_tasks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), shards).cast("int")))
    j = j.withColumn("task", F.when(F.col("h_tasks").isNull(), at).otherwise(F.expr("h_tasks[shard]")))
    return j.drop("h_group", "h_key", "h_tasks").repartitionById(plan.tasks, F.col("task"))


def long_keys(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per record and key column: (column_name, key_value, *keep)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("key_value")) for c in columns))
    return df.select(*keep, F.explode(pairs).alias("p")).select("p.*", *keep)


def per_key(df: DataFrame, columns: Sequence[str], record: str, measures: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Per value of each of ``columns``: records and sums of ``measures``, each record once.

    Rows that repeat a record agree in key and measures (a redelivery), so they
    share a shard and are taken once inside it.  A null record id counts every row
    on its own.  Missing values are keys like any other.
    """
    tasks = tasks or parallelism(df.sparkSession)
    rows = long_keys(df, columns, [record, *measures])
    plan = plan_shards(rows.select("column_name", "key_value"), "column_name", "key_value", tasks)
    own = F.when(F.col(record).isNull(), F.monotonically_increasing_id())
    placed = to_tasks(rows.withColumn("__own", own), plan, "column_name", "key_value", F.struct(record, "__own"))
    first = [F.max(m).alias(m) for m in measures]
    unique = placed.groupBy("task", "column_name", "key_value", "shard", record, "__own").agg(*(first or [F.lit(1).alias("__one")]))
    partial = unique.groupBy("task", "column_name", "key_value", "shard").agg(F.count(F.lit(1)).alias("records"), *(F.sum(m).alias(m) for m in measures))
    return partial.groupBy("column_name", "key_value").agg(
        F.sum("records").alias("records"), F.count(F.lit(1)).alias("shards"), *(F.sum(m).alias(m) for m in measures)
    )


def dominant(df: DataFrame, columns: Sequence[str], record: str, least_share: str = "0.05") -> DataFrame:
    """(column_name, key_value) of the exact, not missing values holding ``least_share`` of all records."""
    results = durable(per_key(df, columns, record))  # small; read for the total and for the shares
    total = results.where(F.col("column_name") == columns[0]).agg(F.sum("records").alias("total"))
    share = F.expr(f"cast({least_share} as decimal(6,4))") * F.col("total").cast("decimal(20,0)")
    return (
        results.crossJoin(F.broadcast(total))
        .where(F.col("key_value").isNotNull() & (F.trim("key_value") != "") & (F.col("records") >= share))
        .select("column_name", "key_value")
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, record: str, tasks: int | None = None) -> DataFrame:
    """Inner join on a string ``key`` without a hot task: left sharded, right replicated to shards.

    Both sides move once, to the tasks of the plan, and are merged there: the strategy is
    fixed, as a broadcast chosen at run time would gather the sharded side again.

    Null keys never join.  Clashing names of other columns come out as ``right_<name>``.
    """
    tasks = tasks or parallelism(left.sparkSession)
    l = left.where(F.col(key).isNotNull()).withColumn("__g", F.lit(""))
    clash = {c: f"right_{c}" for c in right.columns if c != key and c in left.columns}
    r = right.withColumnsRenamed(clash).where(F.col(key).isNotNull()).withColumn("__g", F.lit(""))
    plan = plan_shards(l.select("__g", key), "__g", key, tasks)
    a = to_tasks(l, plan, "__g", key, F.col(record))
    b = to_tasks(r, plan, "__g", key, F.lit(0), replicate=True)
    return a.hint("merge").join(b, ["task", "shard", "__g", key]).drop("task", "shard", "__g")
