"""Record linkage: blocked equi-join with a scored residual predicate.

Both sides carry their whole row as a struct; the join is one inner join on the
block key with the match condition inside it, so losing candidates are never written.
Deterministic equalities become further hash keys, which splits large blocks.  A scored
step counts the candidate pairs of its blocks first; a block with more than a task's
share is cut into shards in proportion: the larger side is divided, the smaller one
replicated to the shards.

Matches form a bag: every pair of every step that holds, without best-match choice.
All steps probe the keys the *first* step defines for the cohort, unless
``reindex_per_step``.  A step of unknown type or strategy matches nothing.

Counting makes no pairs where it can be helped: rows of a block that the step's comparisons
cannot tell apart are one row with their number, and a matching pair of such rows counts
the product of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import parallelism
from . import index as indexes

Parser = Callable[[DataFrame], DataFrame]
#: How an index is laid out, as a join hint: let Spark choose, sort and merge, or build hashes.
INDEXES = {"memory": None, "sort-merge": "merge", "hash": "shuffle_hash"}


@dataclass(frozen=True)
class CohortConfig:
    name: str
    subset: object = None
    parser: Parser | None = None


@dataclass(frozen=True)
class LinkageConfig:
    """One step.  ``on`` and ``blocking`` map cohort fields to target fields."""

    name: str
    type: str
    on: Mapping[str, str]
    blocking: Mapping[str, str] | None = None
    score_strategy: str | None = None
    weights: Mapping[str, object] = field(default_factory=dict)
    threshold: float | None = None
    subset: object = None

    @property
    def block(self) -> Mapping[str, str]:
        return self.on if self.blocking is None else self.blocking


def _rows(service: object, subset: object) -> DataFrame:
    """A service is a DataFrame, or anything with ``exec()`` and perhaps ``subset()``."""
    if isinstance(service, DataFrame):
        return service
    if subset is not None and hasattr(service, "subset"):
        service.subset(subset)
    return service.exec()


def _keyed(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.struct(F.lit(None).alias("none"))
    return df.select(scoring.block_key(df, fields).alias("block_key"), whole.alias(name)).where("block_key <> ''")


def _decision(cohort: DataFrame, target: DataFrame, step: LinkageConfig) -> tuple[Column, Column]:
    """(whether a candidate matches, its score)."""
    tests = {a: scoring.same(cohort, target, a, b) for a, b in step.on.items()}
    none = F.lit(None).cast("double")
    if step.type == "deterministic":
        return reduce(lambda a, b: a & b, tests.values(), F.lit(True)), none
    strategy = step.score_strategy or "simple"
    if step.type == "probabilistic" and strategy == "simple":
        score = scoring.weighted(tests, scoring.simple_weights(step.on, step.weights))
        return score >= F.lit(0.85 if scoring.falsy(step.threshold) else float(step.threshold)), score
    if step.type == "probabilistic" and strategy == "fellegi-sunter":
        score = scoring.fellegi_sunter(tests, scoring.fellegi_sunter_weights(step.on, step.weights))
        return ~F.isnan(score) & (score >= F.lit(0.0 if scoring.falsy(step.threshold) else float(step.threshold))), score
    return F.lit(False), none


def hot_blocks(cohort_keys: DataFrame, target_keys: DataFrame, tasks: int) -> list[tuple[str, int, bool]]:
    """(block key, shards, whether the target is divided) of blocks with more than a task's share of all candidate pairs.

    Only block keys are read; fewer than ``tasks`` blocks can be hot, so the list is short.
    """
    n = lambda df, name: df.groupBy("block_key").agg(F.count(F.lit(1)).alias(name))
    loads = n(cohort_keys, "nc").join(n(target_keys, "nt"), "block_key").withColumn("pairs", F.col("nc").cast("double") * F.col("nt"))
    whole = loads.agg(F.sum("pairs").alias("whole"))
    hot = loads.crossJoin(F.broadcast(whole)).where(F.col("pairs") * tasks > F.col("whole")).collect()
    return sorted((r["block_key"], min(int(-(-r["pairs"] * 2 * tasks // r["whole"])), max(r["nc"], r["nt"])), r["nt"] >= r["nc"]) for r in hot)


def _sharded(df: DataFrame, side: str, blocks: list[tuple[str, int, bool]]) -> DataFrame:
    """``df`` with ``shard``: rows of a hot block's divided side in one, of its other side in all of the block's shards."""
    if not blocks:
        return df.withColumn("shard", F.lit(0))
    plan = F.broadcast(df.sparkSession.createDataFrame([(k, n, divided == (side == "target")) for k, n, divided in blocks], "hot_key string, shards int, divided boolean"))
    one = F.array(F.pmod(F.xxhash64(side), F.coalesce("shards", F.lit(1))).cast("int"))
    shard = F.when(F.col("shards").isNull(), F.array(F.lit(0))).when(F.col("divided"), one).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
    return df.join(plan, df["block_key"] == plan["hot_key"], "left").withColumn("shard", F.explode(shard)).select(*df.columns, "shard")


def _alike(keyed: DataFrame, name: str, compared: list[str]) -> DataFrame:
    """(block_key, ``name``, n_``name``): rows of a block with the same compared fields as one, with their number."""
    fields = F.struct(*(F.col(f"{name}.`{c}`") for c in compared)) if compared else F.struct(F.lit(None).alias("none"))
    return keyed.select("block_key", fields.alias(name)).groupBy("block_key", name).agg(F.count(F.lit(1)).alias(f"n_{name}"))


def _matching(cohort: DataFrame, target: DataFrame, step: LinkageConfig, cohort_fields: list[str], hint: str | None, tasks: int | None, index: object, alike: bool) -> tuple[DataFrame, Column]:
    """(matching pairs of one step, their score); ``alike``: of rows of :func:`_alike` with their numbers."""
    matches, score = _decision(cohort, target, step)
    c, t = _keyed(cohort, cohort_fields, "cohort"), _keyed(target, list(step.block.values()), "target")
    if index is not None:
        c = index.built(c)
    if alike:
        both = [(a, b) for a, b in step.on.items() if a in cohort.columns and b in target.columns]
        c, t = _alike(c, "cohort", list(dict.fromkeys(a for a, _ in both))), _alike(t, "target", list(dict.fromkeys(b for _, b in both)))
    on = F.col("block_key") == F.col("t_key")
    if step.type == "probabilistic" or not step.on:
        blocks = hot_blocks(c.select("block_key"), t.select("block_key"), tasks or parallelism(cohort.sparkSession))
        if blocks:
            c, t = _sharded(c, "cohort", blocks), _sharded(t, "target", blocks).withColumnRenamed("shard", "t_shard")
            on = on & (F.col("shard") == F.col("t_shard"))
    t = t.withColumnRenamed("block_key", "t_key")
    return (c.hint(hint) if hint else c).join(t, on & matches, "inner"), score


def link_step(cohort: DataFrame, target: DataFrame, step: LinkageConfig, cohort_fields: list[str], hint: str | None = None, tasks: int | None = None, index: object = None) -> DataFrame:
    """(cohort, target, score) of one step; ``tasks``: into how many tasks a scored step is to spread."""
    joined, score = _matching(cohort, target, step, cohort_fields, hint, tasks, index, alike=False)
    return joined.select("cohort", "target", score.alias("score"))


def count_step(cohort: DataFrame, target: DataFrame, step: LinkageConfig, cohort_fields: list[str], hint: str | None = None, tasks: int | None = None, index: object = None) -> DataFrame:
    """(n): how many rows :func:`link_step` gives."""
    joined, _ = _matching(cohort, target, step, cohort_fields, hint, tasks, index, alike=True)
    return joined.agg(F.coalesce(F.sum(F.col("n_cohort") * F.col("n_target")), F.lit(0)).alias("n"))


class LinkageStrategy:
    """``LinkageStrategy(name).cohort(rows, cfg).link(rows, cfg)….exec()`` gives the matches."""

    def __init__(self, name: str, index: str | indexes.Index = "memory", reindex_per_step: bool = False, tasks: int | None = None, repository: object = None) -> None:
        """``index``: a layout of ``INDEXES`` or an index object; ``repository``: takes the matches with ``save``."""
        self.name, self.reindex_per_step, self.tasks, self.repository = name, reindex_per_step, tasks, repository
        self.hint, self.index = (INDEXES[index], None) if isinstance(index, str) else (None, index)
        self._cohort: tuple[object, CohortConfig] | None = None
        self._links: list[tuple[object, LinkageConfig]] = []

    def cohort(self, service: object, config: CohortConfig) -> LinkageStrategy:
        self._cohort = (service, config)
        return self

    def link(self, service: object, config: LinkageConfig) -> LinkageStrategy:
        self._links.append((service, config))
        return self

    def _steps(self) -> Iterator[tuple[DataFrame, DataFrame, LinkageConfig, list[str]]]:
        """(cohort, target, step, cohort fields of its block key) of every step."""
        if self._cohort is None:
            raise ValueError("Cohort not defined. Call cohort() first.")
        if not self._links:
            raise ValueError("No linkage defined.")
        service, config = self._cohort
        cohort = _rows(service, config.subset)
        if config.parser is not None:
            cohort = config.parser(cohort)
        first = list(self._links[0][1].block)
        for target_service, step in self._links:
            yield cohort, _rows(target_service, step.subset), step, list(step.block) if self.reindex_per_step else first

    def count(self) -> DataFrame:
        """(n): how many matches ``exec`` gives, without making them; a repository gets none."""
        parts = [count_step(*s, self.hint, self.tasks, self.index) for s in self._steps()]
        return reduce(lambda a, b: a.unionByName(b), parts).agg(F.sum("n").alias("n"))

    def exec(self) -> DataFrame:
        """(cohort, target, score, step, matched_at); structs of steps are named alike only if rows are."""
        parts = []
        for cohort, target, step, fields in self._steps():
            m = link_step(cohort, target, step, fields, self.hint, self.tasks, self.index)
            described = F.struct(F.lit(step.name).alias("name"), F.lit(step.type).alias("type"), F.lit(step.score_strategy).cast("string").alias("score_strategy"), F.lit(step.threshold).cast("double").alias("threshold"))
            parts.append(m.withColumn("step", described).withColumn("matched_at", F.current_timestamp()))
        if len({p.schema["target"].dataType.json() for p in parts}) > 1:
            # targets of different shape meet as JSON documents
            parts = [p.withColumn("target", F.to_json("target")) for p in parts]
        found = reduce(lambda a, b: a.unionByName(b), parts)
        if self.repository is not None:
            self.repository.save(found)
        return found
