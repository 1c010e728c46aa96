from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from aroeira.functions.criteria import CriteriaSet, StringCriteria
from aroeira.operators import indicators
from aroeira.streaming import incremental

from .conftest import bag


def test_only_new_files(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    part = lambda lo: spark.range(lo, lo + 10).selectExpr("id", "if(id % 2 = 0, 'F', 'M') sexo").coalesce(1).write.mode("append").parquet(src)
    part(0)
    schema = spark.read.parquet(src).schema
    run = lambda: incremental.ingest(incremental.landed(spark, src, schema), CriteriaSet.set([StringCriteria("F", "sexo")]), lambda d: d.withColumn("sexo", F.lower("sexo")), sink, ck).awaitTermination()
    run()
    assert spark.read.parquet(sink).count() == 5
    part(10)
    run()
    assert bag(spark.read.parquet(sink).groupBy("sexo").count()) == [("f", 10)]


def test_daily_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(datetime(2024, 1, 1, 5), "a"), (datetime(2024, 1, 1, 6), "a"), (datetime(2024, 1, 9), "b")], "ts timestamp, k string").write.parquet(src)
    stream = incremental.landed(spark, src, spark.read.parquet(src).schema)
    q = incremental.daily_counts(stream, "ts", "k").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert bag(spark.table("daily").select("k", "records")) == [("a", 2), ("b", 1)]


def test_indicator(spark):
    df = spark.createDataFrame([("1", "j18.9", None), ("1", " U07.1", None), ("1", "I10", "A16.2"), ("1", None, "a20"), ("2", "J18", None), ("1", "U07.1.", "")], "CODESTAB string, CAUSABAS string, LINHAA string")
    got = indicators.deaths(df, ["1"])
    assert sorted(str(r.CAUSABAS) for r in got.collect()) == [" U07.1", "I10", "j18.9"]
    assert bag(indicators.rate(got, 1000)) == [(3, 300.0)] and bag(indicators.rate(got, 0)) == [(3, None)]


def test_entry(spark, data):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["c", "t", "score"]
