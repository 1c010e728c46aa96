"""Consolidating pairwise matches into groups.

Alternating large-star and small-star edge rewrites until nothing changes; every
record then hangs on the smallest identifier of its component.  Both rewrites take
the minimum of a node's neighbours by a map-side combined aggregate and hand it back
by a join on the node, so the edges of a hub are never gathered in one task: the
joins are ordinary equi-joins that adaptive execution splits where a node is hot.

Defined results: null ends and self-links make no edge; repeated and reversed pairs
count once; an empty table of pairs gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import durable, release


def edges_of(pairs: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Distinct (v, u) with v > u of the pairs with two different, present ends."""
    p = pairs.select((F.col(a) if isinstance(a, str) else a).alias("x"), (F.col(b) if isinstance(b, str) else b).alias("y"))
    return p.where("x <> y").select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least of the node and its neighbours."""
    least = e.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "u")
    # a node's neighbours larger than itself are the v of its rows as u; a smaller
    # neighbour exists only where the node is some row's v, otherwise it is the least
    return e.join(least, "u", "left").select("v", F.coalesce("m", "u").alias("u")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the least of them."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.withColumnRenamed("m", "u")).distinct()


def _counted(e: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``e`` written, with the number of its rows and the sum of their hashes, taken while it is written."""
    seen = Observation()
    out = durable(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, group_id) for every end of ``edges`` (v, u with v > u)."""
    e, state = _counted(edges)
    while state[0]:
        after, new = _counted(_small_star(_large_star(e)))
        release(e)
        e, before, state = after, state, new
        if state == before:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("group_id")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("group_id")).distinct())


def counts(matches: DataFrame) -> DataFrame:
    """The match documents that count: both records there, and deterministic or not below threshold.

    A score or threshold that is null or not a number never counts.
    """
    deterministic = F.coalesce(F.lower(F.trim("link_type")) == "deterministic", F.lit(False))
    scored = F.coalesce(~F.isnan("score") & ~F.isnan("threshold") & (F.col("score") >= F.col("threshold")), F.lit(False))
    return matches.where(F.col("cohort.rec_id").isNotNull() & F.col("target.rec_id").isNotNull() & (deterministic | scored))


def match_groups(matches: DataFrame) -> DataFrame:
    """(rec_id, group_id) for each record that has a counting match with another record."""
    return components(edges_of(counts(matches), "cohort.rec_id", "target.rec_id")).withColumnRenamed("node", "rec_id")
