"""Queries of the ingestion and linkage operators and their SQL, over whole tables."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, parsing
from ..functions.criteria import ArrayCriteria, CriteriaSet, CustomCriteria, StringCriteria
from ..operators import index, indicators, matches
from ..operators.linkage import CohortConfig, LinkageConfig, LinkageStrategy
from ..session import new_folder, table
from ..sources import catalog, dbc, dbf
from ..sources.datasource import files_of, register
from ..sources.ftp import FolderClient, Gateway
from ..sources.naming import CountryYear, StatePeriod, StateYear
from ..sources.systems import SYSTEMS, states
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RECORD = ("rec_id", "file", "sexo", "cges", "tpfin", "cboprof", "qt_aprov")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "sia_records", *RECORD, *more)


_R = "SELECT rec_id, file, sexo, cges, tpfin, cboprof, qt_aprov FROM sia_records"


# Filters


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_all(spark, d):
    """An empty conjunction passes every row."""
    return CriteriaSet().filter(table(spark, d, "part"))


@query(f"{_R} WHERE sexo = 'F'")
def filter_string(spark, d):
    return CriteriaSet.set([StringCriteria("F", "sexo")]).filter(_records(spark, d))


@query(f"{_R} WHERE cges IN ('01', '07')")
def filter_array(spark, d):
    return CriteriaSet.set([ArrayCriteria(["01", "07"], "cges")]).filter(_records(spark, d))


@query(f"{_R} WHERE sexo = 'F' AND cges IN ('01', '07')")
def filter_and(spark, d):
    return CriteriaSet.set([StringCriteria("F", "sexo"), ArrayCriteria(["01", "07"], "cges")]).filter(_records(spark, d))


@query(f"{_R} WHERE sexo IN ('F', 'M', 'I') AND tpfin IN ('050038', '060039')")
def filter_merge_or(spark, d):
    """Criteria on one column merge into the union of their values."""
    c = [StringCriteria("F", "sexo"), ArrayCriteria(["M", "F"], "sexo"), StringCriteria("050038", "tpfin"), StringCriteria("I", "sexo"), StringCriteria("060039", "tpfin")]
    return CriteriaSet.set(c).filter(_records(spark, d))


@query(f"SELECT count(*) AS n FROM ({_R} WHERE sexo = 'F' AND sexo = 'M')")
def filter_unmerged_conflict(spark, d):
    """Loaded criteria do not merge and contradict each other."""
    objects = [{"type": "string", "prop": "sexo", "value": "F"}, {"type": "string", "prop": "sexo", "value": "M"}]
    return CriteriaSet.from_dict(objects).filter(_records(spark, d)).agg(F.count(F.lit(1)).alias("n"))


def _counted(**counts: DataFrame) -> DataFrame:
    """One line with the number of rows of each DataFrame."""
    one = [df.agg(F.count(F.lit(1)).alias(k)) for k, df in counts.items()]
    return reduce(lambda x, y: x.crossJoin(y), one)


@query("SELECT count(*) FILTER (sexo = 'F') AS present, CAST(0 AS BIGINT) AS absent FROM sia_records")
def filter_missing_column(spark, d):
    """A column of another case is another column: on one that is not there nothing matches."""
    on = lambda prop: CriteriaSet.set([StringCriteria("F", prop)]).filter(_records(spark, d))
    return _counted(present=on("sexo"), absent=on("SEXO"))


@query("SELECT count(*) FILTER (CAST(qt_aprov AS VARCHAR) = '1') AS as_text, CAST(0 AS BIGINT) AS as_number FROM sia_records")
def filter_non_string(spark, d):
    """A number never equals a text; the same values as text do."""
    c, r = CriteriaSet.set([StringCriteria("1", "qt_aprov")]), _records(spark, d)
    return _counted(as_text=c.filter(r.withColumn("qt_aprov", F.col("qt_aprov").cast("string"))), as_number=c.filter(r))


@query("SELECT count(*) FILTER (sexo IN ('F')) AS one_value, CAST(0 AS BIGINT) AS no_value FROM sia_records")
def filter_empty_array(spark, d):
    within = lambda values: CriteriaSet([ArrayCriteria(values, "sexo")]).filter(_records(spark, d))
    return _counted(one_value=within(["F"]), no_value=within([]))


@query(f"{_R} WHERE sexo = 'F' AND cges IN ('03', '12')")
def criteria_roundtrip(spark, d):
    c = CriteriaSet.set([StringCriteria("F", "sexo"), ArrayCriteria(["03", "12"], "cges")])
    return CriteriaSet.from_dict(c.to_dict()).filter(_records(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def filter_lineitem(spark, d):
    c = CriteriaSet.set([StringCriteria("A", "l_returnflag"), StringCriteria("F", "l_linestatus")])
    return c.filter(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity")


# Parsers


@query("SELECT rec_id, lower(sexo) AS sexo, substr(cges, 1, 1) AS cges FROM sia_records")
def parse_dictionary(spark, d):
    """Functions per field; a field that is not there is not made."""
    p = parsing.dictionary({"sexo": F.lower, "cges": lambda c: F.substring(c, 1, 1), "absent": F.upper})
    return p(table(spark, d, "sia_records", "rec_id", "sexo", "cges"))


@query("SELECT o_orderkey, coalesce(o_orderstatus, '') || coalesce(o_orderpriority, '') AS o_orderstatus FROM orders")
def parse_concat_drop(spark, d):
    return parsing.concat_and_drop("o_orderstatus", "o_orderpriority")(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("SELECT rec_id AS id, coduni AS unidade, ufmun AS municipio FROM sia_records")
def parse_rename(spark, d):
    return parsing.rename({"rec_id": "id", "coduni": "unidade", "ufmun": "municipio"})(table(spark, d, "sia_records"))


@query("SELECT r_regionkey, r_name, true AS parsed FROM region")
def parse_constant(spark, d):
    return parsing.constant("parsed", True)(table(spark, d, "region"))


@query("SELECT cohort_id, lower(hex(encode(nome))) AS nome FROM cohort_people GROUP BY ALL")
def parse_hex(spark, d):
    return parsing.dictionary({"nome": parsing.hex_text})(table(spark, d, "cohort_people", "cohort_id", "nome")).distinct()


@query("SELECT rec_id, 'f' AS sexo FROM sia_records WHERE sexo = 'F'")
def filter_then_parse(spark, d):
    """The filter sees the raw value, the parser runs after it."""
    kept = CriteriaSet.set([StringCriteria("F", "sexo")]).filter(table(spark, d, "sia_records", "rec_id", "sexo"))
    return parsing.dictionary({"sexo": F.lower})(kept)


# Summaries


_SUMMARY = "SELECT file, count(*) AS total, count(*) FILTER (sexo = 'F') AS founds, CAST(0 AS BIGINT) AS errors FROM sia_records GROUP BY file"


@query(_SUMMARY)
def job_summary(spark, d):
    """Per file: records, records that pass, errors."""
    return _summaries(spark, d).drop("filters")


def _summaries(spark, d):
    return pipeline.file_summary(table(spark, d, "sia_records", "file", "sexo"), CriteriaSet.set([StringCriteria("F", "sexo")]))


@query("SELECT file, total, founds, unnest(['string', 'array']) AS type, unnest(['sexo', 'cges']) AS prop, unnest(['F', '01,07']) AS value FROM (SELECT file, count(*) AS total, count(*) FILTER (sexo = 'F' AND cges IN ('01', '07')) AS founds FROM sia_records GROUP BY file)")
def job_summary_filters(spark, d):
    """The criteria of a run stand in its summaries as structs: one line per file and criterion."""
    criteria = CriteriaSet.set([StringCriteria("F", "sexo"), ArrayCriteria(["01", "07"], "cges")])
    s = pipeline.file_summary(table(spark, d, "sia_records", "file", "sexo", "cges"), criteria)
    return s.select("file", "total", "founds", F.inline("filters")).withColumn("value", F.array_join("value", ","))


@query(f"SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(founds) AS BIGINT) AS founds, CAST(sum(errors) AS BIGINT) AS errors FROM ({_SUMMARY})")
def global_summary(spark, d):
    return pipeline.global_summary(job_summary(spark, d))


@query("SELECT t.file AS file, f.type AS type, f.prop AS prop, count(*) AS runs FROM (SELECT file, unnest(filters) AS f FROM job_summary) t GROUP BY ALL")
def summary_filters(spark, d):
    """How often each file was run with a criterion of each kind on each field."""
    return table(spark, d, "job_summary", "file", "filters").select("file", F.explode("filters").alias("f")).groupBy("file", "f.type", "f.prop").agg(F.count(F.lit(1)).alias("runs"))


# Catalogue


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """(name, pos) of all records' files, by their place in file order."""
    name = F.regexp_extract("file", r"([^/]+)\z", 1)
    return table(spark, d, "sia_records", "rec_id", "file").where("file is not null").groupBy(name.alias("name"), "file").agg(F.min("rec_id").alias("pos"))


_CATALOGUE = "(SELECT regexp_extract(file, '([^/]+)$', 1) AS name, file, min(rec_id) AS pos FROM sia_records WHERE file IS NOT NULL GROUP BY ALL)"
_SUBSET = {"src": "PA", "states": ["SP", "RJ"], "period": {"start": {"year": 2022, "month": "11"}, "end": {"year": 2023, "month": "02"}}}
_PREFIXES = ("PASP2211", "PARJ2211", "PASP2212", "PARJ2212", "PASP2301", "PARJ2301", "PASP2302", "PARJ2302")
_VALUES = ", ".join(f"('{p}', {i})" for i, p in enumerate(_PREFIXES))


@query(f"SELECT file, name, pos, n AS prefix_no FROM {_CATALOGUE} JOIN (VALUES {_VALUES}) v(p, n) ON starts_with(name, p)")
def catalog_state_period(spark, d):
    return catalog.select(_catalogue(spark, d), StatePeriod().prefixes(_SUBSET)).select("file", "name", "pos", "prefix_no")


@query(f"SELECT file, name, pos FROM {_CATALOGUE} WHERE starts_with(name, 'AMAM') OR starts_with(name, 'AMBA')")
def catalog_state(spark, d):
    """Without a period all months of the states are meant."""
    return catalog.select(_catalogue(spark, d), StatePeriod().prefixes({"src": "AM", "states": ["AM", "BA"]})).select("file", "name", "pos")


@query(f"SELECT count(*) AS n FROM {_CATALOGUE} WHERE starts_with(name, 'BI')")
def catalog_source(spark, d):
    """A source alone selects all names that start with it."""
    chosen = [s.prefixes({"src": "BI"}) for s in (StatePeriod(), StateYear(), CountryYear())]
    assert chosen == [["BI"]] * 3
    return catalog.select(_catalogue(spark, d), chosen[0]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trim(file) AS name, min(run_id) AS pos FROM job_summary WHERE file IS NOT NULL GROUP BY ALL")
def catalog_dedup(spark, d):
    """Files of the runs, each at its first run."""
    listing = table(spark, d, "job_summary", "file", "run_id").where("file is not null").select(F.trim("file").alias("name"), F.col("run_id").alias("pos"))
    return catalog.distinct_files(listing)


@query(f"SELECT name, file, CAST((row_number() OVER (ORDER BY pos, name) - 1) // 3 AS BIGINT) AS chunk FROM {_CATALOGUE}")
def catalog_chunks(spark, d):
    return catalog.numbered_chunks(_catalogue(spark, d), 3).select("name", "file", "chunk")


_AM_YEARS = ("AMAM2301", "AMAM2302", "AMBA2301", "AMBA2302")


@query(f"SELECT file, name, n AS prefix_no FROM {_CATALOGUE} JOIN (VALUES {', '.join(f'({chr(39)}{p}{chr(39)}, {i})' for i, p in enumerate(_AM_YEARS))}) v(p, n) ON starts_with(name, p)")
def catalog_state_year(spark, d):
    """States outermost, then years of four digits (which pick months of these names)."""
    chosen = StateYear().prefixes({"src": "AM", "states": ["AM", "BA"], "year": [2301, 2302]})
    return catalog.select(_catalogue(spark, d), chosen).select("file", "name", "prefix_no")


@query(f"SELECT file, name, n AS prefix_no FROM (SELECT file, substr(name, 1, 2) || 'BR' || substr(name, 5) AS name FROM {_CATALOGUE}) JOIN (VALUES ('BIBR22', 0), ('BIBR23', 1)) v(p, n) ON starts_with(name, p)")
def catalog_country_year(spark, d):
    """Years of two digits over the same files under nationwide names."""
    nationwide = _catalogue(spark, d).withColumn("name", F.concat(F.substring("name", 1, 2), F.lit("BR"), F.substring("name", 5, 100)))
    return catalog.select(nationwide, CountryYear().prefixes({"src": "BI", "year": [2022, 2023]})).select("file", "name", "prefix_no")


# Files: a test table is written as DBC and read back


def _as_dbc(df: DataFrame, name: str, files: int | None = None) -> str:
    """The folder that holds ``df`` as DBC files."""
    register(df.sparkSession)
    folder = new_folder(df.sparkSession, f"dbc-{name}")
    (df.coalesce(files) if files else df).write.format("dbc").mode("append").save(folder)
    return folder


def _dbc(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("dbc").options(**options).load(folder)


def _order_files(spark: SparkSession, d: str):
    """A remote folder with one file of orders per status, and a client to it."""
    remote = new_folder(spark, "remote").removeprefix("file://")
    Path(remote).mkdir(parents=True)
    for state, status in (("SP", "O"), ("RJ", "F"), ("MG", "P")):
        folder = _as_dbc(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").toDF("ORDERKEY", "CUSTKEY", "STATUS").where(F.col("STATUS") == status), state, 1).removeprefix("file://")
        next(Path(folder).glob("*.dbc")).rename(f"{remote}/DO{state}2021.dbc")
    return FolderClient(remote), remote


@query("SELECT p_partkey AS PARTKEY, p_name AS NAME, p_brand AS BRAND, p_type AS TYPE, p_size AS SIZE, p_retailprice AS PRICE FROM part")
def dbc_scan(spark, d):
    """Every record of every file, through the sink and back."""
    return _dbc(spark, _as_dbc(_part_fields(spark, d), "part"))


def _part_fields(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").toDF("PARTKEY", "NAME", "BRAND", "TYPE", "SIZE", "PRICE")


@query("SELECT p_partkey AS PARTKEY, p_size AS SIZE FROM part")
def dbc_columns(spark, d):
    """Only the named columns are decoded."""
    return _dbc(spark, _as_dbc(_part_fields(spark, d), "part"), columns="PARTKEY,SIZE")


@query("SELECT p_partkey AS PARTKEY FROM part WHERE p_type = 'STANDARD' OR p_type IN ('PROMO', 'SMALL')")
def dbc_criteria(spark, d):
    """Criteria are applied while decoding, on fields that need not be selected."""
    criteria = CriteriaSet.set([ArrayCriteria(["STANDARD", "PROMO"], "TYPE"), StringCriteria("SMALL", "TYPE")])
    return _dbc(spark, _as_dbc(_part_fields(spark, d), "part"), columns="PARTKEY", criteria=json.dumps(criteria.to_dict()))


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_totalprice > 100000 AS dear FROM orders")
def dbc_types(spark, d):
    """Whole numbers, dates and logical values come back as they went."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice").select(F.col("o_orderkey").alias("KEY"), F.col("o_orderdate").cast("date").alias("DAY"), (F.col("o_totalprice") > 100000).alias("DEAR"))
    return _dbc(spark, _as_dbc(o, "orders")).toDF("o_orderkey", "o_orderdate", "dear")


@query("SELECT name, type, size, (SELECT count(*) FROM customer) AS records FROM (VALUES ('CUSTKEY', 'N', 18), ('NAME', 'C', 40), ('NATION', 'N', 9), ('BALANCE', 'B', 8)) v(name, type, size)")
def dbc_metadata(spark, d):
    """Fields and number of records from a file's header."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal").toDF("CUSTKEY", "NAME", "NATION", "BALANCE")
    register(spark)
    folder = new_folder(spark, "dbc-customer")
    c.coalesce(1).write.format("dbc").option("sizes", "NAME:40").mode("append").save(folder)
    r = dbc.DbcReader(files_of(folder)[0])
    return spark.createDataFrame([(f.name, f.type, f.size, r.size) for f in r.fields], "name string, type string, size int, records bigint")


@query("SELECT r_regionkey AS REGIONKEY, r_name AS NAME, CAST(r_regionkey // 2 AS INTEGER) AS batch FROM region")
def read_batch(spark, d):
    """A reader's batches of two records, to the end of the file."""
    folder = _as_dbc(table(spark, d, "region", "r_regionkey", "r_name").toDF("REGIONKEY", "NAME").orderBy("REGIONKEY"), "region", 1)
    reader, rows = dbc.DbcReader(files_of(folder)[0]), []
    while batch := reader.read_batch(2):
        rows.append(batch)
    return spark.createDataFrame([(r["REGIONKEY"], r["NAME"], i) for i, b in enumerate(rows) for r in b], "REGIONKEY int, NAME string, batch int")


@query("SELECT n_nationkey AS KEY, n_name AS NAME FROM nation")
def dbc_writer(spark, d):
    """A writer given single records and lists of records; its errors carry what they could not write."""
    path = new_folder(spark, "dbc-nation").removeprefix("file://") + ".dbc"
    rows = [r.asDict() for r in table(spark, d, "nation").select(F.col("n_nationkey").alias("KEY"), F.col("n_name").alias("NAME")).collect()]
    w = dbc.DbcWriter(path, [dbf.Field("KEY", "N", 9), dbf.Field("NAME", "C", 25)])
    w.write(rows[0])
    w.write(rows[1:])
    w.close()
    return _dbc(spark, path)


@query("SELECT o_orderkey AS ORDERKEY, o_orderstatus AS STATUS FROM orders WHERE o_orderstatus IN ('O', 'F')")
def run_files(spark, d):
    """A run: list and select a remote folder, land the files, scan, filter, parse."""
    o, _ = _run(spark, d, ["SP", "RJ", "SP", "XX"])
    return o.exec(parsing.rename({"ORDERKEY": "ORDERKEY", "STATUS": "STATUS"}))


def _run(spark, d, states_, **options):
    client, remote = _order_files(spark, d)
    config = pipeline.RunConfig(data_path=new_folder(spark, "landed").removeprefix("file://"), filters=CriteriaSet.set([ArrayCriteria(["F", "O"], "STATUS")]), **options)
    Path(config.data_path).mkdir(parents=True)
    return pipeline.Orchestrator(spark, Gateway(client, remote + "/", StateYear()), config).subset({"src": "DO", "states": states_, "year": [2021]}), remote


@query("""SELECT 'DO' || CASE o_orderstatus WHEN 'O' THEN 'SP' WHEN 'F' THEN 'RJ' ELSE 'MG' END || '2021.dbc' AS file, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS founds, CAST(0 AS BIGINT) AS errors,
  'array' AS type, 'STATUS' AS prop, 'F,O' AS value FROM orders GROUP BY o_orderstatus""")
def run_summary(spark, d):
    """Summaries of a run, appended to a folder and read back."""
    o, _ = _run(spark, d, ["SP", "RJ", "MG"])
    folder = new_folder(spark, "summary")
    o.write_summary(folder)
    s = spark.read.schema(f"file string, total bigint, founds bigint, errors bigint, filters {pipeline.FILTERS}").json(folder)
    return s.select("file", "total", "founds", "errors", F.inline("filters")).withColumn("value", F.array_join("value", ","))


@query("""SELECT 2 AS done, 'DORJ2021.dbc' AS failed, count(*) AS records FROM orders WHERE o_orderstatus = 'O'""")
def run_with_failure(spark, d):
    """A chunk whose file is broken is handed over with its files; the other chunks go through."""
    o, remote = _run(spark, d, ["SP", "RJ", "MG"], concurrency=1)
    Path(f"{remote}/DORJ2021.dbc").write_bytes(b"broken")
    sink, failed = new_folder(spark, "run"), []
    done = o.run(lambda df: df.write.mode("append").parquet(sink), on_error=lambda e, chunk: failed.extend(chunk))
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("records")).select(F.lit(done).alias("done"), F.lit(",".join(failed)).alias("failed"), "records")


@query("SELECT c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey")
def link_dbc_provider(spark, d):
    """Files of records as the cohort of a linkage; the subset a file cannot have is passed over with a warning."""
    folder = _as_dbc(table(spark, d, "customer", "c_custkey", "c_name").toDF("CUSTKEY", "NAME"), "customer")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        m = LinkageStrategy("files").cohort(pipeline.DbcProvider(spark, folder), CohortConfig("c", {"src": "PA"})).link(_orders(spark, d), _det("s", {"CUSTKEY": "o_custkey"})).exec()
    assert any("no subsets" in str(w.message) for w in said)
    return m.select(F.col("cohort.CUSTKEY").alias("c"), F.col("target.o_orderkey").alias("t"))


@query("SELECT * FROM (VALUES (0, 'array', 'sexo', 'F,M', false), (1, 'string', 'cges', '01', false)) v(no, type, prop, value, set_is_empty)")
def criteria_values(spark, d):
    """The criteria of a set, one by one, and whether the set is empty."""
    c = CriteriaSet.set([StringCriteria("F", "sexo"), StringCriteria("01", "cges"), StringCriteria("M", "sexo"), StringCriteria("F", "sexo")])
    assert CriteriaSet().is_empty() and not CriteriaSet().values()
    rows = [(i, x["type"], x["prop"], ",".join(x["value"]) if x["type"] == "array" else x["value"], c.is_empty()) for i, x in enumerate(v.to_dict() for v in c.values())]
    return spark.createDataFrame(rows, "no int, type string, prop string, value string, set_is_empty boolean")


@query(f"{_R} WHERE qt_aprov > 2 AND sexo = 'F'")
def filter_custom(spark, d):
    """A predicate of the caller's own beside a plain criterion."""
    return CriteriaSet.set([CustomCriteria(lambda df: F.col("qt_aprov") > 2), StringCriteria("F", "sexo")]).filter(_records(spark, d))


@query("SELECT total, processed, CAST(processed * 100 // total AS INTEGER) AS progress FROM (SELECT (SELECT count(*) FROM part) AS total, CAST(unnest(range(1, (SELECT count(*) + 1 FROM part))) AS BIGINT) AS processed) QUALIFY row_number() OVER (PARTITION BY progress ORDER BY processed) = 1")
def run_progress(spark, d):
    """The whole per cents a run over the parts reports, each at the record it changes with."""
    n = table(spark, d, "part").count()
    rows, before = [], None
    for i in range(1, n + 1):
        p = formats.progress(i, n)
        if p != before:
            rows.append((n, i, p))
        before = p
    assert [p for *_, p in rows] == [p for p in formats.progress_events(n) if p or rows[0][2] == 0]
    return spark.createDataFrame(rows, "total bigint, processed bigint, progress int")


@query("SELECT DISTINCT s.uf AS uf, s.code AS code FROM (VALUES ('SP', '35'), ('RJ', '33'), ('MG', '31'), ('BA', '29'), ('DF', '53'), ('AC', '12'), ('AL', '27'), ('AM', '13'), ('AP', '16'), ('CE', '23'), ('ES', '32'), ('GO', '52'), ('MA', '21'), ('MS', '50'), ('MT', '51'), ('PA', '15'), ('PB', '25'), ('PE', '26'), ('PI', '22'), ('PR', '41'), ('RN', '24'), ('RO', '11'), ('RR', '14'), ('RS', '43'), ('SC', '42'), ('SE', '28'), ('TO', '17')) s(uf, code) JOIN sia_records r ON substr(r.ufmun, 1, 2) = s.code")
def state_codes(spark, d):
    """States that records come from."""
    codes = table(spark, d, "sia_records", "ufmun").select(F.substring("ufmun", 1, 2).alias("code")).distinct()
    return F.broadcast(states(spark)).join(codes, "code", "left_semi").select("uf", "code")


@query("""SELECT * FROM (VALUES ('sia', '/dissemin/publicos/SIASUS/200801_/Dados/', 13, 6, 'PA_CODUNI=2270196'), ('sih', '/dissemin/publicos/SIHSUS/200801_/Dados/', 4, 4, 'CNES=2270196'),
  ('sim', '/dissemin/publicos/SIM/CID10/DORES/', 6, 4, ''), ('sinan', '/dissemin/publicos/SINAN/DADOS/PRELIM/', 58, 4, 'SG_UF_NOT=33')) v(name, path, sources, concurrency, criteria)""")
def system_registry(spark, d):
    """The systems with their folders, file families and criteria."""
    rows = [(s.name, s.path, len(s.sources), s.concurrency, ",".join(f"{c['prop']}={c['value']}" for c in s.criteria.to_dict())) for s in SYSTEMS.values()]
    return spark.createDataFrame(rows, "name string, path string, sources int, concurrency int, criteria string")


@query("""SELECT c_custkey, replace(format('{:,}', c_custkey * 7919), ',', '.') AS number, CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h ' ELSE '' END
  || CASE WHEN s // 60 % 60 > 0 OR s // 3600 % 24 > 0 THEN (s // 60 % 60) || 'm ' ELSE '' END || (s % 60) || 's' AS duration FROM (SELECT c_custkey, c_custkey * 61 AS s FROM customer)""")
def run_texts(spark, d):
    """Durations and numbers as a run reports them."""
    keys = [r[0] for r in table(spark, d, "customer", "c_custkey").collect()]
    return spark.createDataFrame([(k, formats.brazilian(k * 7919), formats.duration(k * 61_000)) for k in keys], "c_custkey bigint, number string, duration string")


# Index


@query("SELECT p_brand || '_' || p_size AS key, count(*) AS n FROM part GROUP BY ALL")
def index_build(spark, d):
    return index.entries(index.build(table(spark, d, "part", "p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"]))


@query("SELECT CAST(l.k AS VARCHAR) AS key, c_name FROM customer JOIN (SELECT DISTINCT o_custkey AS k FROM orders) l ON c_custkey = l.k")
def index_get(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    return index.get(index.build(table(spark, d, "customer", "c_custkey", "c_name"), ["c_custkey"]), asked).select("key", "value.c_name")


@query("SELECT k AS key, k IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders) AS found FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer)")
def index_has(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return index.has(index.build(table(spark, d, "orders", "o_custkey"), ["o_custkey"]), asked)


# Linkage


def _strategy(cohort: DataFrame, *steps: tuple[DataFrame, LinkageConfig], **options) -> LinkageStrategy:
    s = LinkageStrategy("queries", **options).cohort(cohort, CohortConfig("cohort"))
    for target, config in steps:
        s.link(target, config)
    return s


def _link(cohort: DataFrame, *steps: tuple[DataFrame, LinkageConfig], **options) -> DataFrame:
    return _strategy(cohort, *steps, **options).exec()


def _det(name: str, on: dict, blocking: dict | None = None) -> LinkageConfig:
    return LinkageConfig(name, "deterministic", on, blocking)


def _prob(strategy: str, on: dict, blocking: dict, weights: dict | None = None, threshold: float | None = None) -> LinkageConfig:
    return LinkageConfig("p", "probabilistic", on, blocking, strategy, weights or {}, threshold)


def _customers(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _orders(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey")
def link_deterministic(spark, d):
    m = _link(_customers(spark, d), (_orders(spark, d), _det("s", {"c_custkey": "o_custkey"}, {"c_custkey": "o_custkey"})))
    return m.select(F.col("cohort.c_custkey").alias("c"), F.col("target.o_orderkey").alias("t"))


@query("SELECT c_custkey AS c, o_orderkey AS t, CAST(NULL AS DOUBLE) AS score FROM customer JOIN orders ON c_custkey = o_custkey")
def link_default_blocking(spark, d):
    """Without blocking the compared fields are the blocks; a deterministic match has no score."""
    m = _link(_customers(spark, d), (_orders(spark, d), _det("s", {"c_custkey": "o_custkey"})))
    return m.select(F.col("cohort.c_custkey").alias("c"), F.col("target.o_orderkey").alias("t"), "score")


@query("SELECT c_custkey AS c, s_suppkey AS t FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def link_cross_field(spark, d):
    m = _link(_customers(spark, d), (table(spark, d, "supplier", "s_suppkey", "s_nationkey"), _det("s", {"c_nationkey": "s_nationkey"})))
    return m.select(F.col("cohort.c_custkey").alias("c"), F.col("target.s_suppkey").alias("t"))


def _parts(spark, d):
    return table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size")


def _self_link(spark, d, config: LinkageConfig, **options) -> DataFrame:
    m = _link(_parts(spark, d), (_parts(spark, d), config), **options)
    return m.select(F.col("cohort.p_partkey").alias("c"), F.col("target.p_partkey").alias("t"), F.round("score", 6).alias("score"))


_PAIRS = "SELECT a.p_partkey AS c, b.p_partkey AS t, round({score}, 6) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE {where}"
_TYPE, _SIZE = "a.p_type = b.p_type", "a.p_size = b.p_size"
_BRAND = {"p_brand": "p_brand"}
_ON = {"p_type": "p_type", "p_size": "p_size"}


def _case(test: str, yes: float, no: float) -> str:
    return f"CASE WHEN {test} THEN CAST({yes!r} AS DOUBLE) ELSE CAST({no!r} AS DOUBLE) END"


_SIMPLE = f"({_case(_TYPE, 1.0, 0.0)} + {_case(_SIZE, 1.0, 0.0)}) / 2"


@query(_PAIRS.format(score=_SIMPLE, where=f"{_SIMPLE} >= 0.5"))
def link_simple(spark, d):
    return _self_link(spark, d, _prob("simple", _ON, _BRAND, threshold=0.5))


_WEIGHED = f"({_case(_TYPE, 1.0, 0.0)} + {_case(_SIZE, 3.0, 0.0)}) / 4"


@query(_PAIRS.format(score=_WEIGHED, where=f"{_WEIGHED} >= 0.6"))
def link_simple_weighted(spark, d):
    """A weight that is no number counts 1."""
    return _self_link(spark, d, _prob("simple", _ON, _BRAND, {"p_type": {"m": 0.9, "u": 0.1}, "p_size": 3}, 0.6))


@query(_PAIRS.format(score=_SIMPLE, where=f"{_SIMPLE} >= 0.85"))
def link_simple_zero_threshold(spark, d):
    """A threshold of 0 means the default of 0.85."""
    return _self_link(spark, d, _prob("simple", _ON, _BRAND, threshold=0))


_M = "log2(CAST(0.9 AS DOUBLE) / 0.1)", "log2((1 - CAST(0.9 AS DOUBLE)) / (1 - CAST(0.1 AS DOUBLE)))", "log2(CAST(0.8 AS DOUBLE) / 0.1)", "log2((1 - CAST(0.8 AS DOUBLE)) / (1 - CAST(0.1 AS DOUBLE)))"
_FS = f"(CASE WHEN {_TYPE} THEN {_M[0]} ELSE {_M[1]} END + CASE WHEN {_SIZE} THEN {_M[2]} ELSE {_M[3]} END)"
_MU = {"p_type": {"m": 0.9, "u": 0.1}, "p_size": {"m": 0.8, "u": 0.1}}


@query(_PAIRS.format(score=_FS, where=f"{_FS} >= 2"))
def link_fs_mu(spark, d):
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, _MU, 2))


@query(_PAIRS.format(score=_FS, where=f"{_FS} >= 2"))
def link_fs_sharded(spark, d):
    """For 64 tasks every block is hot; cut into shards by load they give the same pairs."""
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, _MU, 2), tasks=64)


_EXPLICIT = f"({_case(_TYPE, 10.0, -8.0)} + {_case(_SIZE, 5.0, -3.0)})"


@query(_PAIRS.format(score=_EXPLICIT, where=f"{_EXPLICIT} >= 5"))
def link_fs_explicit(spark, d):
    w = {"p_type": {"agreement": 10, "disagreement": -8}, "p_size": {"agreement": 5, "disagreement": -3}}
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, w, 5))


_SIGNS = f"({_case(_TYPE, 1.0, -1.0)} + {_case(_SIZE, 1.0, -1.0)})"


@query(_PAIRS.format(score=_SIGNS, where=f"{_SIGNS} >= 0"))
def link_fs_numeric_weights(spark, d):
    """Numbers are no weights here: every field counts +1 or -1."""
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, {"p_type": 3, "p_size": 7}))


@query("SELECT a.p_partkey AS c, b.p_partkey AS t, CAST('Infinity' AS DOUBLE) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE a.p_size = b.p_size")
def link_fs_degenerate(spark, d):
    """u = 0 agrees without limit, m = 1 disagrees without limit, both together are no score."""
    w = {"p_type": {"m": 0.9, "u": 0}, "p_size": {"m": 1, "u": 0.1}}
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, w, 1))


@query("""SELECT 'orders' AS step, c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT 'suppliers', c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey""")
def link_multi_step(spark, d):
    """The second step probes the keys of the first: its suppliers meet customers by number."""
    first = (table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id")), _det("orders", {"c_custkey": "o_custkey"}))
    second = (table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("id")), _det("suppliers", {"c_nationkey": "s_nationkey"}, {"c_nationkey": "s_suppkey"}))
    m = _link(_customers(spark, d), first, second)
    target = F.get_json_object("target", "$.id").cast("bigint")
    return m.select(F.col("step.name").alias("step"), F.col("cohort.c_custkey").alias("c"), target.alias("t"))


@query("""SELECT 'orders' AS step, c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT 'suppliers', c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey""")
def link_reindexed(spark, d):
    """With an index per step each step blocks on its own fields."""
    first = (table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id")), _det("orders", {"c_custkey": "o_custkey"}))
    second = (table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id")), _det("suppliers", {"c_nationkey": "s_nationkey"}))
    m = _link(_customers(spark, d), first, second, reindex_per_step=True)
    return m.select(F.col("step.name").alias("step"), F.col("cohort.c_custkey").alias("c"), F.get_json_object("target", "$.id").cast("bigint").alias("t"))


def _holed(spark, d):
    """Parts without the size 7 and the brand of the first size."""
    p = _parts(spark, d)
    return p.select("p_partkey", F.expr("nullif(p_size, 7)").alias("p_size"), F.expr("if(p_size = 1, null, p_brand)").alias("p_brand"))


@query("""WITH p AS (SELECT p_partkey, nullif(p_size, 7) AS s, CASE WHEN p_size <> 1 THEN p_brand END AS b FROM part),
  k AS (SELECT *, coalesce(b, '') || '_' || coalesce(CAST(s AS VARCHAR), '') AS k FROM p)
  SELECT a.p_partkey AS c, b.p_partkey AS t FROM k a JOIN k b ON a.k = b.k WHERE a.b IS NOT DISTINCT FROM b.b AND a.s IS NOT DISTINCT FROM b.s""")
def link_null_keys(spark, d):
    """Null parts of a key are empty, null equals null."""
    on = {"p_brand": "p_brand", "p_size": "p_size"}
    m = _link(_holed(spark, d), (_holed(spark, d), _det("s", on)))
    return m.select(F.col("cohort.p_partkey").alias("c"), F.col("target.p_partkey").alias("t"))


@query("SELECT count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE a.p_brand IS NOT NULL")
def link_blank_key(spark, d):
    """A single blank key is left out."""
    blank = _parts(spark, d).withColumn("p_brand", F.lit(None).cast("string"))
    m = _link(_parts(spark, d), (_parts(spark, d).unionByName(blank), _det("s", {}, _BRAND)))
    return m.agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_brand || '_x' AS x, p_type AS y FROM part), q AS (SELECT p_partkey, p_brand AS x, 'x_' || p_type AS y FROM part)
  SELECT count(*) AS n FROM p JOIN q ON p.x || '_' || p.y = q.x || '_' || q.y""")
def link_key_collision(spark, d):
    """(a_x, b) and (a, x_b) share a block; with nothing compared every candidate matches."""
    p = _parts(spark, d)
    left = p.select("p_partkey", F.concat("p_brand", F.lit("_x")).alias("x"), F.col("p_type").alias("y"))
    right = p.select("p_partkey", F.col("p_brand").alias("x"), F.concat(F.lit("x_"), "p_type").alias("y"))
    return _link(left, (right, _det("s", {}, {"x": "x", "y": "y"}))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM part a JOIN part b USING (p_size)) AS one_type, CAST(0 AS BIGINT) AS two_types")
def link_type_mismatch(spark, d):
    """A number and its text share a block and are never equal."""
    text = _parts(spark, d).withColumn("p_size", F.col("p_size").cast("string"))
    on = lambda target: _link(_parts(spark, d), (target, _det("s", {"p_size": "p_size"})))
    return _counted(one_type=on(_parts(spark, d)), two_types=on(text))


@query("SELECT (SELECT count(*) FROM part a JOIN part b USING (p_brand)) AS known, CAST(0 AS BIGINT) AS unknown")
def link_unknown_type(spark, d):
    """A type that is not known matches nothing, the same step of a known type matches; counted without making the pairs."""
    n = lambda kind, name: _strategy(_parts(spark, d), (_parts(spark, d), LinkageConfig("s", kind, _BRAND))).count().withColumnRenamed("n", name)
    return n("deterministic", "known").crossJoin(n("fuzzy", "unknown"))


@query("SELECT count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = 7")
def link_no_overlap(spark, d):
    """Targets of brands that the cohort lacks match nothing; the others all do."""
    other = _parts(spark, d).withColumn("p_brand", F.when(F.col("p_size") == 7, F.col("p_brand")).otherwise(F.concat(F.lit("no "), "p_brand")))
    return _link(_parts(spark, d), (other, _det("s", _BRAND))).agg(F.count(F.lit(1)).alias("n"))


@query(_PAIRS.format(score=_FS, where=f"{_FS} >= 2"))
def link_sort_merge_equiv(spark, d):
    """The sorted index gives the same pairs as the hashed one."""
    return _self_link(spark, d, _prob("fellegi-sunter", _ON, _BRAND, _MU, 2), index="sort-merge")


@query("SELECT c_custkey AS c, c_name, o_orderkey AS t, o_orderstatus, 'det' AS name, 'deterministic' AS type, CAST(NULL AS VARCHAR) AS score_strategy, CAST(NULL AS DOUBLE) AS score FROM customer JOIN orders ON c_custkey = o_custkey")
def match_document(spark, d):
    """A match carries both whole rows, its step and its score."""
    m = _link(_customers(spark, d), (_orders(spark, d), _det("det", {"c_custkey": "o_custkey"})))
    return m.select(F.col("cohort.c_custkey").alias("c"), "cohort.c_name", F.col("target.o_orderkey").alias("t"), "target.o_orderstatus", "step.name", "step.type", "step.score_strategy", "score")


@query("""WITH c AS (SELECT DISTINCT cohort_id, nome, nome_mae, sexo FROM cohort_people WHERE nome <> '' AND nome_mae <> ''), t AS (SELECT DISTINCT target_id, nome_paciente, mae, sexo FROM target_people)
  SELECT cohort_id, target_id FROM c JOIN t ON nome = nome_paciente AND nome_mae = mae AND c.sexo = t.sexo""")
def link_people(spark, d):
    """Persons whose name, mother and sex agree to the letter."""
    c = table(spark, d, "cohort_people", "cohort_id", "nome", "nome_mae", "sexo").where("nome <> '' and nome_mae <> ''").distinct()
    t = table(spark, d, "target_people", "target_id", "nome_paciente", "mae", "sexo").distinct()
    m = _link(c, (t, _det("people", {"nome": "nome_paciente", "nome_mae": "mae", "sexo": "sexo"})))
    return m.where("cohort.sexo is not null").select("cohort.cohort_id", "target.target_id")


@query("SELECT c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey")
def link_external_index(spark, d):
    """The cohort as a bucketed table outside the run."""
    m = _link(_customers(spark, d), (_orders(spark, d), _det("s", {"c_custkey": "o_custkey"})), index=index.ExternalIndex(f"cohort_{uuid.uuid4().hex}", 8, new_folder(spark, "index")))
    return m.select(F.col("cohort.c_custkey").alias("c"), F.col("target.o_orderkey").alias("t"))


@query("SELECT CAST(count(*) // 25 AS INTEGER) AS chunks, (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS matches FROM customer")
def link_chunked_index(spark, d):
    """A sorted index that tells of every full chunk of 25 records."""
    told = []
    m = _link(_customers(spark, d), (_orders(spark, d), _det("s", {"c_custkey": "o_custkey"})), index=index.ChunkedIndex(25, lambda i, n: told.append(i)))
    return m.agg(F.count(F.lit(1)).alias("matches")).select(F.lit(len(told)).alias("chunks"), "matches")


@query("SELECT c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey")
def match_repository(spark, d):
    """Matches saved to a repository, cleared, saved again and read back."""
    kept, stored = matches.MatchRepository(), matches.StoredMatchRepository(spark, new_folder(spark, "matches"))
    m = _link(_customers(spark, d), (_orders(spark, d), _det("s", {"c_custkey": "o_custkey"})), repository=kept)
    kept.clear()
    assert kept.all() is None
    kept.save(m)
    stored.save(kept.all())
    stored.clear()
    stored.save(kept.all())
    return stored.all().select(F.get_json_object("cohort", "$.c_custkey").cast("bigint").alias("c"), F.get_json_object("target", "$.o_orderkey").cast("bigint").alias("t"))


class _Segments:
    """A linkage service with subsets: customers of one segment."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def subset(self, subset: dict) -> None:
        self.rows = self.rows.where(F.col("c_mktsegment") == subset["segment"])

    def exec(self) -> DataFrame:
        return self.rows


@query("SELECT c_custkey AS c, o_orderkey AS t FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def link_subset(spark, d):
    """The subset of the cohort's configuration reaches a service that has subsets."""
    m = LinkageStrategy("s").cohort(_Segments(_customers(spark, d)), CohortConfig("c", {"segment": "BUILDING"})).link(_orders(spark, d), _det("s", {"c_custkey": "o_custkey"})).exec()
    return m.select(F.col("cohort.c_custkey").alias("c"), F.col("target.o_orderkey").alias("t"))


# Indicators


_CODES = "(SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS codestab, chr(CAST(65 + l_partkey % 26 AS INTEGER)) || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0') || '.' || l_linenumber AS causabas FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, causabas FROM {_CODES} WHERE codestab IN ('1', '2', '3', '5', '7') AND (causabas LIKE 'J%' OR replace(causabas, '.', '') IN ('U071', 'U072'))")
def indicator_cid(spark, d):
    """Rows of five facilities with a respiratory cause, over codes made from order lines."""
    return indicators.deaths(_causes(spark, d), ["1", "2", "3", "5", "7"], "codestab", "causabas", ()).select("l_orderkey", "l_linenumber", "causabas")


def _causes(spark, d):
    code = "concat(chr(65 + l_partkey % 26), lpad(l_orderkey % 100, 2, '0'), '.', l_linenumber)"
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("codestab"), F.expr(code).alias("causabas"))


@query(f"SELECT count(*) AS deaths, count(*) * 100000.0 / 250000 AS rate FROM {_CODES} WHERE codestab IN ('1', '2', '3', '5', '7') AND (causabas LIKE 'J%' OR replace(causabas, '.', '') IN ('U071', 'U072'))")
def indicator_rate(spark, d):
    return indicators.rate(indicators.deaths(_causes(spark, d), ["1", "2", "3", "5", "7"], "codestab", "causabas", ()), 250000)
