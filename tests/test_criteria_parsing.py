from pyspark.sql import functions as F

from aroeira.functions import formats, parsing
from aroeira.functions.criteria import ArrayCriteria, CriteriaSet, CustomCriteria, StringCriteria

from .conftest import bag


def rows(spark):
    return spark.createDataFrame([("SP", "A90", 1), ("RJ", "C20", 2), (None, "B10", 3), ("sp", "", None)], "STATE string, DISEASE string, n int")


def n(df):
    return [r.n for r in df.orderBy("DISEASE").collect()]


def test_equality_membership_and_conjunction(spark):
    df = rows(spark)
    assert n(CriteriaSet.set([StringCriteria("SP", "STATE")]).filter(df)) == [1]
    assert sorted(n(CriteriaSet.set([ArrayCriteria(["SP", "RJ"], "STATE")]).filter(df))) == [1, 2]
    both = CriteriaSet.from_dict([{"type": "string", "prop": "STATE", "value": "SP"}, {"type": "array", "prop": "DISEASE", "value": ["A90", "B10"]}])
    assert n(both.filter(df)) == [1]
    assert CriteriaSet().is_empty() and CriteriaSet().filter(df).count() == 4


def test_absent_case_other_type_and_empty_list_match_nothing(spark):
    df = rows(spark)
    for c in (StringCriteria("SP", "state"), StringCriteria("SP", "CITY"), StringCriteria("1", "n"), ArrayCriteria([], "STATE"), ArrayCriteria(["1"], "n")):
        assert CriteriaSet([c]).filter(df).count() == 0


def test_set_merges_and_loading_does_not(spark):
    merged = CriteriaSet.set([StringCriteria("SP", "STATE"), StringCriteria("RJ", "STATE"), StringCriteria("A90", "DISEASE"), StringCriteria("SP", "STATE")])
    assert merged.to_dict() == [{"type": "array", "prop": "STATE", "value": ["SP", "RJ"]}, {"type": "string", "prop": "DISEASE", "value": "A90"}]
    assert CriteriaSet.from_dict(merged.to_dict()).to_dict() == merged.to_dict()
    loaded = CriteriaSet.from_dict([{"type": "string", "prop": "STATE", "value": v} for v in ("SP", "RJ")])
    assert len(loaded.values()) == 2 and loaded.filter(rows(spark)).count() == 0


def test_custom_criteria_come_last_and_degrade(spark):
    c = CriteriaSet.set([CustomCriteria(lambda d: F.col("n") > 1, "BIG_FILTER"), StringCriteria("RJ", "STATE")])
    assert n(c.filter(rows(spark))) == [2]
    assert c.to_dict()[-1] == {"type": "string", "prop": "BIG", "value": None}


def test_parsers(spark):
    df = spark.createDataFrame([("0", "1", "x"), (None, "2", None)], "TPFIN string, SUBFIN string, k string")
    assert bag(parsing.outpatient(df)) == [("01", "x"), ("2", None)]
    assert parsing.outpatient(df.drop("SUBFIN")).columns == ["TPFIN", "k"]
    upper = parsing.dictionary({"k": lambda c: F.coalesce(F.upper(c), F.lit("none")), "absent": F.upper})
    assert bag(upper(df).select("k")) == [("X",), ("none",)]
    assert bag(parsing.dictionary({"k": parsing.hex_text})(df).select("k")) == [("78",), (None,)]
    assert parsing.rename({"k": "key"})(df).columns == ["key"]
    assert bag(parsing.constant("p", True)(df).select("p")) == [(True,), (True,)]
    assert upper(df.limit(0)).count() == 0


def test_formats():
    assert formats.progress_events(0) == [] and formats.progress_events(3) == [0, 33, 66, 100]
    assert (formats.duration(3_723_000), formats.duration(5000), formats.duration(65_000)) == ("1h 2m 3s", "5s", "1m 5s")
    assert formats.brazilian(1234567) == "1.234.567"
