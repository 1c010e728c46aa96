"""Column-level data quality profile.

Checks are declared as :class:`ColumnRule` objects and compiled into one shared
aggregate scan.  The scan yields *states* that merge by addition, of two kinds: one
line per (load, column) with counters, range and a HyperLogLog sketch (:func:`states`),
and value counts per (load, column, value), which also name the records that break a
form (:func:`value_states`).  States are appended to a store batch by batch
(:func:`append_states`), read back and added up (:func:`merge_states`,
:func:`merge_value_states`).  Violations, jumps of the missing share, shifts of the
distribution and control limits over the history of a metric read only stored states,
never the rows again.

Batches of one load must hold different records; a record redelivered within a batch
counts once.

Defined results: a null row key cannot be told from another null row key, so rows
without a key are all kept; a null load keeps its rows' pattern violations but has
no load before it; an empty table gives an empty profile.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, new_folder

SERIES_PATTERN = r"(?s)\A(.*[A-Za-z]{4})([0-9]{4})(\.[^./]*)\z"


@dataclass(frozen=True)
class ColumnRule:
    """What a column may hold.

    ``allowed``: the exact values of its form.  ``pattern``: a Java regular
    expression that must match from ``\\A`` to ``\\z``.  ``forbidden``: values that
    match the pattern but do not count.  ``low``/``high``: inclusive range of the
    value read as a number.
    """

    name: str
    allowed: tuple[str, ...] = ()
    pattern: str = ""
    forbidden: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None

    def missing(self, dtype: str) -> Column:
        c = F.col(f"`{self.name}`")
        return c.isNull() | (F.trim(c) == "") if dtype == "string" else c.isNull()

    def well_formed(self) -> Column:
        c = F.col(f"`{self.name}`").cast("string")
        tests = []
        if self.allowed:
            tests.append(c.isin(*self.allowed))
        if self.pattern:
            tests.append(c.rlike(rf"\A(?:{self.pattern})\z"))
        if self.forbidden:
            tests.append(~c.isin(*self.forbidden))
        if self.low is not None:
            tests.append(F.expr(f"coalesce(try_cast(`{self.name}` as double) >= {self.low}D, false)"))
        if self.high is not None:
            tests.append(F.expr(f"coalesce(try_cast(`{self.name}` as double) <= {self.high}D, false)"))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


#: Forms of the outpatient records.
RECORD_RULES = (
    ColumnRule("sexo", allowed=("M", "F", "I")),
    ColumnRule("cges", pattern="[0-9]{2}", forbidden=("00",)),
    ColumnRule("tpfin", pattern="[0-9]{6}"),
    ColumnRule("competencia", pattern="[0-9]{4}(0[1-9]|1[0-2])"),
    ColumnRule("coduni", pattern="[0-9]{7}"),
    ColumnRule("ufmun", pattern="[0-9]{6}"),
    ColumnRule("cboprof", pattern="[0-9A-Z]{6}"),
    ColumnRule("cns_pac", pattern="[0-9]{15}"),
    ColumnRule("idade", low=0, high=130),
    ColumnRule("dt_atend", pattern="[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"),
    ColumnRule("qt_aprov", low=0),
    ColumnRule("vl_aprov", low=0),
)
FOUND_COLUMNS = ("sexo", "cges", "tpfin")


def once(df: DataFrame, key: str | Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each record once: distinct rows of key and ``keep``, on which redelivered rows agree.

    Rows without a key cannot be told apart and all stay.  Grouping by every column
    hashes; picking a first row per key would sort.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(dict.fromkeys([*keys, *keep]))
    salt = F.when(F.col(f"`{keys[0]}`").isNull(), F.monotonically_increasing_id())
    return df.select(*(F.col(f"`{c}`") for c in cols), salt.alias("__row")).distinct().drop("__row")


def states(df: DataFrame, load: str, rules: Sequence[ColumnRule], sketch: bool = True) -> DataFrame:
    """The mergeable state of every (load, column): one scan, one shuffle.

    Every rule's tests become aggregates over the same input, so the number of
    rules does not multiply the rows.  Values are compared as text in
    ``low``/``high`` unless the column is numeric.
    """
    kinds = dict(df.dtypes)
    aggs: list[Column] = [F.count(F.lit(1)).alias("records")]
    for r in rules:
        c, kind = F.col(f"`{r.name}`"), kinds[r.name]
        there = ~r.missing(kind)
        value = F.when(there & ~F.isnan(c), c) if kind in ("double", "float") else F.when(there, c)
        aggs += [
            F.count(F.when(~there, 1)).alias(f"{r.name}.missing"),
            F.count(F.when(there & ~r.well_formed(), 1)).alias(f"{r.name}.broken"),
            F.min(value).cast("string").alias(f"{r.name}.low"),
            F.max(value).cast("string").alias(f"{r.name}.high"),
        ]
        if sketch:
            aggs.append(F.hll_sketch_agg(value.cast("string"), 12).alias(f"{r.name}.sketch"))
    wide = df.groupBy(load).agg(*aggs)
    parts = ["missing", "broken", "low", "high", *(["sketch"] if sketch else [])]
    per_column = F.array(
        *(
            F.struct(F.lit(r.name).alias("column_name"), *(F.col(f"`{r.name}.{p}`").alias(p) for p in parts))
            for r in rules
        )
    )
    return wide.select(load, "records", F.explode(per_column).alias("s")).select(load, "records", "s.*")


def merge_states(*parts: DataFrame, load: str, numeric: Sequence[str] = ()) -> DataFrame:
    """States of disjoint row sets added up; the same as profiling the rows together."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    as_number = F.col("column_name").isin(*numeric) if numeric else F.lit(False)

    def extreme(c: str, by) -> Column:
        number = by(F.struct(F.expr(f"try_cast({c} as double)").alias("n"), F.col(c).alias("t")))
        return F.when(F.first(as_number), number["t"]).otherwise(by(F.col(c)))

    aggs = [F.sum(c).alias(c) for c in ("records", "missing", "broken")]
    aggs += [
        extreme("low", lambda c: F.min(c)).alias("low"),
        extreme("high", lambda c: F.max(c)).alias("high"),
    ]
    if "sketch" in both.columns:
        aggs.append(F.hll_union_agg("sketch").alias("sketch"))
    return both.groupBy(load, "column_name").agg(*aggs)


def with_previous(loads: DataFrame, load: str) -> DataFrame:
    """Adds ``series`` and ``prev``, the load before it in its series, to distinct loads."""
    name = F.col(load)
    series = F.concat_ws("|", F.regexp_extract(name, SERIES_PATTERN, 1), F.regexp_extract(name, SERIES_PATTERN, 3))
    named = loads.where(name.rlike(SERIES_PATTERN)).select(load, series.alias("series"), F.regexp_extract(name, SERIES_PATTERN, 2).alias("yymm"))
    w = Window.partitionBy("series").orderBy("yymm", load)
    return named.withColumn("prev", F.lag(load).over(w))


def exact_text(df: DataFrame, column: str) -> Column:
    """The exact value of any column as text, null if missing; both zeros of a float are one value."""
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] in ("double", "float"):
        c = c + F.lit(0.0)
    text = c.cast("string")
    return F.when(F.trim(text) != "", text)


def value_states(df: DataFrame, load: str, key: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """(load, column_name, value, broken, record, n): the value counts of every column in one scan and one shuffle.

    A missing value is null.  A record whose value breaks its form is a line of its own
    with its ``record`` key; all others share the line of their value.  Lines of disjoint
    rows merge by adding ``n``.
    """
    kinds = dict(df.dtypes)
    entries = []
    for r in rules:
        broken = ~r.missing(kinds[r.name]) & ~r.well_formed()
        entries.append(F.struct(F.lit(r.name).alias("column_name"), exact_text(df, r.name).alias("value"), broken.alias("broken"), F.when(broken, F.col(key)).alias("record")))
    by = [load, "column_name", "value", "broken", "record"]
    return df.select(load, F.explode(F.array(*entries)).alias("p")).select(load, "p.*").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def merge_value_states(states: DataFrame) -> DataFrame:
    by = [c for c in states.columns if c != "n"]
    return states.groupBy(*by).agg(F.sum("n").alias("n"))


def histogram(values: DataFrame, load: str) -> DataFrame:
    """(load, column_name, value, n) of value states: exact values, a missing value as null."""
    return values.groupBy(load, "column_name", "value").agg(F.sum("n").alias("n"))


def append_states(states: DataFrame, store: str, batch: str) -> None:
    """Adds the states of one batch to the folder ``store``; a batch of the same name is replaced."""
    states.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def stored_states(spark: SparkSession, store: str) -> DataFrame:
    """The states of all batches, one below the other."""
    return spark.read.parquet(store).drop("batch")


def load_totals(hist: DataFrame, load: str) -> DataFrame:
    return hist.groupBy(load, "column_name").agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing")
    )


def changes(hist: DataFrame, load: str, jump: str = "0.2", shift: str = "0.4", least: int = 200) -> DataFrame:
    """(case_kind, load, column_name) where a load departs from the one before it.

    Shares are compared as integers, so a share exactly at a limit never departs.
    """
    totals = load_totals(hist, load)
    order = with_previous(totals.select(load).distinct(), load).where("prev is not null").select(load, "prev")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    pair = (
        order.join(totals, load)
        .join(
            totals.select(F.col(load).alias("prev"), "column_name", F.col("records").alias("p_records"), F.col("missing").alias("p_missing")),
            ["prev", "column_name"],
        )
        .select(load, "prev", "column_name", "records", "missing", "p_records", "p_missing")
    )
    jumped = pair.where((F.col("records") >= least) & (F.col("p_records") >= least)).where(
        F.abs(F.col("missing") * F.col("p_records").cast("decimal(18,0)") - F.col("p_missing") * F.col("records").cast("decimal(18,0)"))
        > F.expr(f"cast({jump} as decimal(6,4))") * (F.col("records").cast("decimal(14,0)") * F.col("p_records").cast("decimal(14,0)"))
    )
    sized = pair.select(load, "prev", "column_name", (F.col("records") - F.col("missing")).alias("m"), (F.col("p_records") - F.col("p_missing")).alias("pm")).where(
        (F.col("m") >= least) & (F.col("pm") >= least)
    )
    values = hist.where("value is not null")
    own = sized.join(values, [load, "column_name"]).select(load, "column_name", "value", "m", "pm", (big("n") * big("pm")).cast("decimal(38,0)").alias("d"))
    before = sized.join(values.withColumnRenamed(load, "prev"), ["prev", "column_name"]).select(
        load, "column_name", "value", "m", "pm", (-big("n") * big("m")).cast("decimal(38,0)").alias("d")
    )
    moved = (
        own.unionByName(before)
        .groupBy(load, "column_name", "value", "m", "pm")
        .agg(F.abs(F.sum("d")).cast("decimal(28,0)").alias("d"))
        .groupBy(load, "column_name", "m", "pm")
        .agg(F.sum("d").alias("d"))
        .where(F.col("d") > 2 * F.expr(f"cast({shift} as decimal(6,4))") * (F.col("m").cast("decimal(14,0)") * F.col("pm").cast("decimal(14,0)")))
    )
    return jumped.select(F.lit("missing_jump").alias("case_kind"), load, "column_name").unionByName(
        moved.select(F.lit("shift").alias("case_kind"), load, "column_name")
    )


#: How values of columns that are near unique, or follow the calendar, are compared between loads; others exactly.
COMPARED = {"competencia": "months", "dt_atend": "months", "coduni": "code", "cns_pac": "code", "idade": "decade", "vl_aprov": "power"}


def compared(df: DataFrame, load: str, column: str) -> Column:
    """The class in which the shift of ``column`` is tested, null if missing.

    Exact values of these columns differ between any two loads, whatever they hold.
    ``months``: the month, which :func:`apart` counts from the load's own; ``code``: the first
    character and one of 2 bins by hash, few enough classes that loads of a few hundred records agree;
    ``decade``; ``power``: of 2.  A value without a class stands for itself.
    """
    text, c, how = exact_text(df, column), F.col(f"`{column}`"), COMPARED.get(column)
    if how == "months":
        return F.when(text.rlike(r"\A[0-9]{4}(0[1-9]|1[0-2])([0-9]{2})?\z"), F.substring(c, 1, 6)).otherwise(text)
    if how == "code":
        return F.when(text.isNotNull(), F.concat(F.substring(text, 1, 1), F.lit("#"), F.pmod(F.xxhash64(text), F.lit(2)).cast("string")))
    if how == "decade":
        return F.floor(c / 10).cast("string")
    if how == "power":
        return F.when((c > 0) & (c < float("inf")), F.floor(F.log2(c)).cast("string")).when(c < 0, "negative").otherwise(text)
    return text


def apart(load: str) -> Column:
    """The class of a (load, column_name, value) row, a month as the months since the load's own."""
    yymm, value = F.regexp_extract(F.col(load), SERIES_PATTERN, 2), F.col("value")
    months = lambda y, m: y.try_cast("int") * 12 + m.try_cast("int")
    own = months(F.concat(F.lit("20"), F.substring(yymm, 1, 2)), F.substring(yymm, 3, 2))
    since = (months(F.substring(value, 1, 4), F.substring(value, 5, 2)) - own).cast("string")
    dated = F.col("column_name").isin(*(c for c, how in COMPARED.items() if how == "months"))
    return F.when(dated & value.rlike(r"\A[0-9]{4}(0[1-9]|1[0-2])\z"), F.coalesce(since, value)).otherwise(value)


def departures(records: DataFrame, load: str = "file", key: str = "rec_id", rules: Sequence[ColumnRule] = RECORD_RULES) -> DataFrame:
    """(case_kind, load, column_name) where a load departs from the one before it, over every rule's column.

    ``missing_jump`` and ``broken_jump``: the share of records without a value, or with one
    that breaks its form; ``shift``: the distribution of the :func:`compared` values.
    """
    kinds = dict(records.dtypes)
    unique = once(records, key, [load, *(r.name for r in rules)])
    entries = F.array(
        *(
            F.struct(F.lit(r.name).alias("column_name"), compared(unique, load, r.name).alias("value"), (~r.missing(kinds[r.name]) & ~r.well_formed()).alias("broken"))
            for r in rules
        )
    )
    hist = unique.select(load, F.explode(entries).alias("p")).groupBy(load, "p.column_name", "p.value", "p.broken").agg(F.count(F.lit(1)).alias("n"))
    hist = durable(hist.withColumn("value", apart(load)))
    form = hist.groupBy(load, "column_name", F.when(~F.col("broken"), "kept").alias("value")).agg(F.sum("n").alias("n"))
    broken = changes(form, load).where("case_kind = 'missing_jump'").withColumn("case_kind", F.lit("broken_jump"))
    return changes(hist.drop("broken"), load).unionByName(broken)


def found_in_states(values: DataFrame, load: str, key: str) -> DataFrame:
    """(case_kind, load, column_name, key) from value states: violations, jumps of the missing share, shifts."""
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i")  # one line a record; more only without a key
    broken = values.where("broken").select(F.lit("pattern").alias("case_kind"), load, "column_name", F.col("record").alias(key), each).drop("i")
    whole = changes(durable(histogram(values, load)), load).withColumn(key, F.lit(-1).cast("bigint"))
    return broken.unionByName(whole.select("case_kind", load, "column_name", key))


def found(records: DataFrame, load: str = "file", key: str = "rec_id", columns: Sequence[str] = FOUND_COLUMNS) -> DataFrame:
    """Pattern violations, jumps of the missing share and shifts, each record once.

    One scan of the records makes the value states; they are stored and read back, and
    every case comes from them.
    """
    rules = [r for r in RECORD_RULES if r.name in columns]
    store = new_folder(records.sparkSession, "states")
    append_states(value_states(once(records, key, [load, *columns]), load, key, rules), store, "all")
    return found_in_states(stored_states(records.sparkSession, store), load, key)


def limits_of_missing(records: DataFrame, load: str = "file", key: str = "rec_id", columns: Sequence[str] = FOUND_COLUMNS) -> DataFrame:
    """Loads whose missing share lies outside the control limits of the loads before, from stored states."""
    rules = [r for r in RECORD_RULES if r.name in columns]
    store = new_folder(records.sparkSession, "states")
    append_states(value_states(once(records, key, [load, *columns]), load, key, rules), store, "all")
    totals = load_totals(stored_states(records.sparkSession, store), load)
    return control_limits(totals.select(load, "column_name", (F.col("missing") / F.col("records")).alias("missing_share")), load, "missing_share")


def profile(records: DataFrame, load: str = "file", key: str = "rec_id", rules: Sequence[ColumnRule] = RECORD_RULES) -> DataFrame:
    """Per load and column: records, missing, broken, range and estimated distinct values.

    The distinct count is a HyperLogLog estimate (about 1.6 % standard error).
    """
    s = states(once(records, key, [load, *(r.name for r in rules)]), load, rules)
    return s.select(load, "column_name", "records", "missing", "broken", "low", "high", F.hll_sketch_estimate("sketch").alias("distinct_values"))


def distinct_values(records: DataFrame, load: str = "file", columns: Sequence[str] = tuple(r.name for r in RECORD_RULES)) -> DataFrame:
    """(load, column_name, distinct_values): how many values differ, counted exactly.

    Repeated rows add no value, so records need not be taken once; missing values do not count.
    """
    seen = records.select(load, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), exact_text(records, c).alias("value")) for c in columns))).alias("p")).select(load, "p.*").distinct()
    return seen.groupBy(load, "column_name").agg(F.count("value").alias("distinct_values"))


def control_limits(metrics: DataFrame, load: str, value: str, sigmas: float = 3.0, least: int = 4, floor: float = 0.02) -> DataFrame:
    """Loads whose ``value`` lies outside the limits of the loads before it in its series.

    Limits are mean ± max(``sigmas`` standard deviations, ``floor``) over all earlier
    loads; a load with fewer than ``least`` earlier loads is not tested.  ``metrics``
    has one row per load and column_name.
    """
    order = with_previous(metrics.select(load).distinct(), load)
    w = Window.partitionBy("series", "column_name").orderBy("yymm", load).rowsBetween(Window.unboundedPreceding, -1)
    h = (
        metrics.join(order.select(load, "series", "yymm"), load)
        .withColumn("history", F.count(value).over(w))
        .withColumn("center", F.avg(value).over(w))
        .withColumn("width", F.greatest(F.lit(sigmas) * F.stddev_pop(value).over(w), F.lit(floor)))
    )
    return h.where((F.col("history") >= least) & (F.abs(F.col(value) - F.col("center")) > F.col("width"))).select(
        load, "column_name", F.col(value).alias("observed"), "center", "width", "history"
    )


def limits_of_states(records: DataFrame, load: str = "file", key: str = "rec_id", rules: Sequence[ColumnRule] = RECORD_RULES) -> DataFrame:
    """(load, column_name, metric, observed, history) outside the control limits, for every rule's column.

    Metrics: missing share, broken share, and the distinct count, tested as a logarithm
    so that its limits are in proportion (a tenth at least).
    """
    store = new_folder(records.sparkSession, "states")
    append_states(states(once(records, key, [load, *(r.name for r in rules)]), load, rules), store, "all")
    s = stored_states(records.sparkSession, store)
    s = durable(s.select(load, "column_name", "records", "missing", "broken", F.hll_sketch_estimate("sketch").alias("distinct")))
    share = lambda c: F.col(c) / F.col("records")
    tested = (("missing_share", share("missing"), 0.02), ("broken_share", share("broken"), 0.02), ("distinct_values", F.log1p("distinct"), 0.1))
    parts = [
        control_limits(s.select(load, "column_name", value.alias(metric)), load, metric, floor=floor).select(load, "column_name", F.lit(metric).alias("metric"), "observed", "history")
        for metric, value, floor in tested
    ]
    plain = F.when(F.col("metric") == "distinct_values", F.round(F.expm1("observed"))).otherwise(F.round("observed", 6))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("observed", plain)
