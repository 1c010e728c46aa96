"""Queries of the general training-data operators (problems 1 to 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, quality, skew
from ..session import durable, new_folder, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "sia_records"))


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per load and column: counters and range, from the mergeable states, and how many values differ, exactly."""
    records = table(spark, sf_dir, "sia_records")
    counted = quality.distinct_values(records).toDF("f", "c", "distinct_values")
    states = quality.profile(records).drop("distinct_values")
    return states.join(counted, states["file"].eqNullSafe(counted["f"]) & (states["column_name"] == counted["c"])).drop("f", "c")


def _close(estimate: str, exact: str) -> Column:
    """Whether a sketch's estimate is within 5 % (three standard errors) of the exact count, or within 2."""
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(2.0), 0.05 * F.col(exact))).alias("sketch_is_close")


def p1_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per column over all loads: exactly, and whether the loads' sketches, merged, come close."""
    records = table(spark, sf_dir, "sia_records")
    s = quality.states(records, "file", quality.RECORD_RULES)  # repeated rows add nothing to a sketch
    estimated = s.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return estimated.join(quality.distinct_values(records.withColumn("file", F.lit(""))), "column_name").select("column_name", "distinct_values", _close("estimate", "distinct_values"))


def p1_load_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each column differ in each load, exactly."""
    return quality.distinct_values(table(spark, sf_dir, "sia_records", "file", *(r.name for r in quality.RECORD_RULES)))


def _merged_halves(spark: SparkSession, sf_dir: str, sketch: bool) -> DataFrame:
    """States of two halves of every load, by a hash of the record, stored as two batches, read back and added up."""
    records = quality.once(table(spark, sf_dir, "sia_records"), "rec_id", ["file", *(r.name for r in quality.RECORD_RULES)])
    half, store = F.pmod(F.xxhash64("rec_id"), F.lit(2)), new_folder(spark, "states")
    for i in range(2):
        quality.append_states(quality.states(records.where(half == i), "file", quality.RECORD_RULES, sketch=sketch), store, str(i))
    return quality.merge_states(quality.stored_states(spark, store), load="file", numeric=("idade", "qt_aprov", "vl_aprov"))


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all records, merged from the stored states of two halves of every load profiled apart."""
    return _merged_halves(spark, sf_dir, sketch=False)


def p1_incremental_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per load and column: exactly, and whether the halves' sketches, merged, come close."""
    s = _merged_halves(spark, sf_dir, sketch=True).select(F.col("file").alias("f"), F.col("column_name").alias("c"), F.hll_sketch_estimate("sketch").alias("estimate"))
    exact = p1_load_distinct(spark, sf_dir)
    return exact.join(s, exact["file"].eqNullSafe(s["f"]) & (exact["column_name"] == s["c"])).select("file", "column_name", "distinct_values", _close("estimate", "distinct_values"))


def p1_control_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads whose missing share lies outside the control limits of the loads before."""
    return quality.limits_of_missing(table(spark, sf_dir, "sia_records")).select("file", "column_name", F.round("observed", 6).alias("observed"), "history")


def p1_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the missing and the broken share and shifts, for every column of the records."""
    return quality.departures(table(spark, sf_dir, "sia_records"))


def p1_limits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing share, broken share and distinct count of every column outside their control limits."""
    return quality.limits_of_states(table(spark, sf_dir, "sia_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "file_metadata"), table(spark, sf_dir, "raw_records"))


def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct schema with its fingerprint and the files that have it."""
    return drift.versions(drift.current_lists(table(spark, sf_dir, "file_metadata")))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw records in one consistent table."""
    return drift.consistent(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "file_metadata"))


def p2_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every migration step with the fingerprints it leads from and to."""
    lists = durable(drift.current_lists(table(spark, sf_dir, "file_metadata")))
    return drift.steps(lists, table(spark, sf_dir, "raw_records"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and values of each file that are in the consistent table: all there are."""
    return drift.kept_values(p2_table(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.dominant(table(spark, sf_dir, "sia_records"), ["sexo", "cges"], "rec_id")


def p3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and approved quantity per value of sexo and cges, each record once."""
    return skew.per_key(table(spark, sf_dir, "sia_records"), ["sexo", "cges"], "rec_id", ["qt_aprov"]).drop("shards")


def p3_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record joined with the mean of its sexo, then counted per file: a skewed join."""
    records = table(spark, sf_dir, "sia_records", "rec_id", "file", "sexo", "qt_aprov")
    unique = quality.once(records, "rec_id", ["file", "sexo", "qt_aprov"])
    means = unique.groupBy("sexo").agg((F.sum("qt_aprov") / F.count("qt_aprov")).alias("mean_qt"))
    joined = skew.skew_join(unique, means, "sexo", "rec_id")
    return joined.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("qt_aprov") > F.col("mean_qt"), 1)).alias("above_mean"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_profile, p1_distinct, p1_load_distinct, p1_incremental, p1_incremental_distinct, p1_control_limits, p1_departures, p1_limits_all, p2_found, p2_versions, p2_steps, p2_table, p2_kept, p3_found, p3_per_key, p3_join)
}

_ONCE = "d AS (SELECT rec_id, file, {cols} FROM sia_records GROUP BY ALL)"
_SERIES = r"""s AS (SELECT file, lag(file) OVER (PARTITION BY regexp_extract(file, '^(.*[A-Za-z]{4})([0-9]{4})(\.[^./]*)$', 1) ORDER BY file) AS prev,
  regexp_extract(file, '^(.*[A-Za-z]{4})([0-9]{4})(\.[^./]*)$', 1) AS series FROM (SELECT DISTINCT file FROM d WHERE file IS NOT NULL))"""
_HIST = """h AS (SELECT file, column_name, CASE WHEN trim(v, ' ') <> '' THEN v END AS v, count(*) AS n FROM (
  SELECT file, 'sexo' AS column_name, sexo AS v FROM d UNION ALL SELECT file, 'cges', cges FROM d UNION ALL SELECT file, 'tpfin', tpfin FROM d)
  GROUP BY ALL), t AS (SELECT file, column_name, CAST(sum(n) AS BIGINT) AS r, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS m FROM h GROUP BY ALL)"""
_FORM = {
    "sexo": "regexp_full_match({c}, '[MFI]')",
    "cges": "regexp_full_match({c}, '[0-9]{{2}}') AND {c} <> '00'",
    "tpfin": "regexp_full_match({c}, '[0-9]{{6}}')",
    "competencia": "regexp_full_match({c}, '[0-9]{{4}}(0[1-9]|1[0-2])')",
    "coduni": "regexp_full_match({c}, '[0-9]{{7}}')",
    "ufmun": "regexp_full_match({c}, '[0-9]{{6}}')",
    "cboprof": "regexp_full_match({c}, '[0-9A-Z]{{6}}')",
    "cns_pac": "regexp_full_match({c}, '[0-9]{{15}}')",
    "idade": "{c} >= 0 AND {c} <= 130",
    "dt_atend": "regexp_full_match({c}, '[0-9]{{4}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')",
    "qt_aprov": "{c} >= 0",
    "vl_aprov": "{c} >= 0",
}
_NUMERIC = ("idade", "qt_aprov", "vl_aprov")


def _profile_sql() -> str:
    cols = ", ".join(_FORM)
    parts = []
    for c, form in _FORM.items():
        there = f"{c} IS NOT NULL" if c in _NUMERIC else f"trim({c}, ' ') <> ''"
        ok = form.format(c=c)
        parts.append(
            f"SELECT file, '{c}' AS column_name, count(*) AS records, count(*) FILTER (NOT coalesce({there}, false)) AS missing, "
            f"count(*) FILTER ({there} AND NOT ({ok})) AS broken, CAST(min({c}) FILTER ({there}) AS VARCHAR) AS low, "
            f"CAST(max({c}) FILTER ({there}) AS VARCHAR) AS high FROM d GROUP BY file"
        )
    return f"WITH {_ONCE.format(cols=cols)} " + " UNION ALL ".join(parts)


def _profile_with_distinct_sql() -> str:
    return f"SELECT p.*, x.distinct_values FROM ({_profile_sql()}) p JOIN ({_distinct_sql()}) x ON p.file IS NOT DISTINCT FROM x.file AND p.column_name = x.column_name"


def _distinct_sql() -> str:
    there = {c: c if c in _NUMERIC else f"CASE WHEN trim({c}, ' ') <> '' THEN {c} END" for c in _FORM}
    return " UNION ALL ".join(f"SELECT file, '{c}' AS column_name, count(DISTINCT {v}) AS distinct_values FROM sia_records GROUP BY file" for c, v in there.items())


_FOUND_COLS = "sexo, cges, tpfin"
ORACLE = {
    "p1_found": f"""WITH {_ONCE.format(cols=_FOUND_COLS)}, {_SERIES}, {_HIST},
      p AS (SELECT s.file, s.prev, a.column_name, a.r, a.m, b.r AS pr, b.m AS pm FROM s JOIN t a ON a.file = s.file JOIN t b ON b.file = s.prev AND b.column_name = a.column_name),
      v AS (SELECT p.file, p.column_name, h.v, CAST(h.n AS HUGEINT) * (p.pr - p.pm) AS x, p.r - p.m AS k, p.pr - p.pm AS pk FROM p JOIN h ON h.file = p.file AND h.column_name = p.column_name WHERE h.v IS NOT NULL
        UNION ALL SELECT p.file, p.column_name, h.v, -CAST(h.n AS HUGEINT) * (p.r - p.m), p.r - p.m, p.pr - p.pm FROM p JOIN h ON h.file = p.prev AND h.column_name = p.column_name WHERE h.v IS NOT NULL)
      SELECT 'pattern' AS case_kind, file, 'sexo' AS column_name, rec_id FROM d WHERE trim(sexo, ' ') <> '' AND NOT ({_FORM['sexo'].format(c='sexo')})
      UNION ALL SELECT 'pattern', file, 'cges', rec_id FROM d WHERE trim(cges, ' ') <> '' AND NOT ({_FORM['cges'].format(c='cges')})
      UNION ALL SELECT 'pattern', file, 'tpfin', rec_id FROM d WHERE trim(tpfin, ' ') <> '' AND NOT ({_FORM['tpfin'].format(c='tpfin')})
      UNION ALL SELECT 'missing_jump', file, column_name, -1 FROM p WHERE r >= 200 AND pr >= 200 AND 5 * abs(m * pr - pm * r) > r * pr
      UNION ALL SELECT 'shift', file, column_name, -1 FROM (SELECT file, column_name, v, k, pk, abs(sum(x)) AS y FROM v WHERE k >= 200 AND pk >= 200 GROUP BY ALL)
        GROUP BY file, column_name, k, pk HAVING 10 * sum(y) > 8 * k * pk""",
    "p1_profile": _profile_with_distinct_sql(),
    "p1_distinct": f"SELECT column_name, distinct_values, true AS sketch_is_close FROM ({_distinct_sql().replace('SELECT file, ', 'SELECT ').replace(' GROUP BY file', '')})",
    "p1_incremental_distinct": f"SELECT file, column_name, distinct_values, true AS sketch_is_close FROM ({_distinct_sql()})",
    "p1_incremental": _profile_sql(),
    "p1_load_distinct": _distinct_sql(),
    "p1_control_limits": f"""WITH {_ONCE.format(cols=_FOUND_COLS)}, {_SERIES}, {_HIST},
      m AS (SELECT t.file, column_name, m / r AS x, series FROM t JOIN s USING (file)),
      w AS (SELECT *, count(*) OVER k AS history, avg(x) OVER k AS c, greatest(3 * stddev_pop(x) OVER k, 0.02) AS lim FROM m
        WINDOW k AS (PARTITION BY series, column_name ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT file, column_name, round(x, 6) AS observed, history FROM w WHERE history >= 4 AND abs(x - c) > lim""",
    "p2_versions": """SELECT sha256(f) AS fingerprint, f AS fields, count(*) AS files, min(file) AS first_file, max(file) AS last_file FROM (
      SELECT file, string_agg(n || ':' || k, ',' ORDER BY n) AS f FROM (
        SELECT file, upper(trim(x.name)) AS n, min(upper(trim(x.type))) AS k FROM (
          SELECT file, unnest(fields) AS x FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY loaded_at DESC) AS r FROM file_metadata) WHERE r = 1)
        GROUP BY ALL) GROUP BY file) GROUP BY f""",
    "p2_kept": r"""WITH r AS (SELECT DISTINCT lower(regexp_extract(file, '([^/\s]+)/([A-Za-z]{4}[0-9]{4})\.[dD][bB][cC]\s*$', 1)) || '/' || upper(regexp_extract(file, '([^/\s]+)/([A-Za-z]{4}[0-9]{4})\.[dD][bB][cC]\s*$', 2)) || '.dbc' AS file, line_no, payload FROM raw_records),
      v AS (SELECT file, payload, CASE WHEN json_valid(payload) THEN len(list_filter(json_keys(payload), lambda k: coalesce(trim(json_extract_string(payload, '$."' || k || '"'), ' ') <> '', false))) WHEN trim(payload, ' ') <> '' THEN 1 ELSE 0 END AS n FROM r)
      SELECT file, count(*) AS records, CAST(sum(n) AS BIGINT) AS kept_values FROM v GROUP BY file""",
    "p3_found": """WITH d AS (SELECT rec_id, sexo, cges FROM sia_records GROUP BY ALL), n AS (SELECT count(*) AS n FROM d),
      k AS (SELECT 'sexo' AS column_name, sexo AS key_value, count(*) AS c FROM d GROUP BY ALL UNION ALL SELECT 'cges', cges, count(*) FROM d GROUP BY ALL)
      SELECT column_name, key_value FROM k, n WHERE trim(key_value, ' ') <> '' AND 20 * c >= n""",
    "p3_per_key": """WITH d AS (SELECT rec_id, sexo, cges, qt_aprov FROM sia_records GROUP BY ALL)
      SELECT 'sexo' AS column_name, sexo AS key_value, count(*) AS records, CAST(sum(qt_aprov) AS BIGINT) AS qt_aprov FROM d GROUP BY ALL
      UNION ALL SELECT 'cges', cges, count(*), CAST(sum(qt_aprov) AS BIGINT) FROM d GROUP BY ALL""",
    "p3_join": """WITH d AS (SELECT rec_id, file, sexo, qt_aprov FROM sia_records GROUP BY ALL), a AS (SELECT sexo, sum(qt_aprov) / count(qt_aprov) AS q FROM d GROUP BY sexo)
      SELECT file, count(*) AS records, count(*) FILTER (qt_aprov > q) AS above_mean FROM d JOIN a USING (sexo) GROUP BY file""",
}
