"""Queries of the operators for training text (problems 4 to 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, table
from . import components, entities, mixing, subjects, tokens


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with their confidence."""
    return entities.match_people(table(spark, sf_dir, "cohort_people"), table(spark, sf_dir, "target_people"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("cohort_id", "target_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(table(spark, sf_dir, "linkage_matches", "cohort", "target", "link_type", "threshold", "score"))


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p5_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("records"))
    return sizes.groupBy("records").agg(F.count(F.lit(1)).alias("groups"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and subjects of every message; the subjects are those of p8."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    model = subjects.fitted(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))
    return durable(mixing.sized(documents, model))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the mix and how often each is used."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.mix(_sized(spark, sf_dir), targets), targets)


def p7_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of every language and topic, and what raking left open."""
    sizes = _sized(spark, sf_dir)
    mixed, raked = mixing.drawn(sizes, table(spark, sf_dir, "mix_targets"))
    return mixing.marginals(durable(mixed), sizes, raked)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of each source treat each subject."""
    per = durable(p8_found(spark, sf_dir)).join(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    return per.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("messages"))


QUERIES = {f.__name__: f for f in (p4_found, p4_matches, p5_found, p5_group_sizes, p6_ids, p7_mix, p7_report, p7_marginals, p8_found, p8_composition)}

_REACH = """WITH RECURSIVE m AS (SELECT cohort.rec_id AS a, target.rec_id AS b FROM linkage_matches WHERE cohort.rec_id IS NOT NULL AND target.rec_id IS NOT NULL AND cohort.rec_id <> target.rec_id
  AND (lower(trim(link_type)) = 'deterministic' OR (score >= threshold AND NOT isnan(score) AND NOT isnan(threshold)))),
  e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
  r AS (SELECT DISTINCT a AS rec_id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.rec_id WHERE r.g < e.b)"""
_GROUPS = f"{_REACH} SELECT rec_id, min(g) AS group_id FROM r GROUP BY rec_id"
ORACLE: dict[str, str] = {
    "p5_found": _GROUPS,
    "p5_group_sizes": f"SELECT records, count(*) AS groups FROM (SELECT group_id, count(*) AS records FROM ({_GROUPS}) GROUP BY group_id) GROUP BY records",
}
