import json
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aroeira.functions.criteria import CriteriaSet, StringCriteria
from aroeira.operators import matches
from aroeira.plans.pipeline import FailToScheduleJob, Orchestrator, RunConfig, global_summary
from aroeira.sources import catalog, dbc, dbf, implode, systems
from aroeira.sources.datasource import register
from aroeira.sources.ftp import CouldNotConnect, FtpClient, Gateway
from aroeira.sources.naming import CountryYear, StatePeriod, StateYear

from .conftest import bag

LISTING = [{"name": n + ".dbc", "size": 1} for n in "PAAC1001 PAAC1002 PAAC1003 PAAM1001 PAAM1002 PASP1001 PASP1002 PARJ1001 BIAC1001".split()]
FIELDS = [dbf.Field("PA_CODUNI", "C", 7), dbf.Field("PA_SEXO", "C", 1), dbf.Field("PA_UFMUN", "C", 6), dbf.Field("QT", "N", 6), dbf.Field("VL", "N", 9, 2), dbf.Field("DT", "D", 8), dbf.Field("OK", "L", 1)]


def period(y0, m0, y1, m1):
    return {"start": {"year": y0, "month": m0}, "end": {"year": y1, "month": m1}}


def test_prefixes():
    sp = StatePeriod()
    assert sp.prefixes({"src": "SIA/", "states": ["SP", "RJ"], "period": period(2024, "01", 2024, "02")}) == ["SIA/SP2401", "SIA/RJ2401", "SIA/SP2402", "SIA/RJ2402"]
    assert sp.prefixes({"src": "PA", "states": ["AC"], "period": period(2023, "11", 2024, "01")}) == ["PAAC2311", "PAAC2312", "PAAC2401"]
    assert sp.prefixes({"src": "PA", "states": ["AC"], "period": period(2024, "05", 2024, "01")}) == []
    for bad in (period(2007, "01", 2010, "01"), period(2024, "13", 2024, "13"), period(2024, "00", 2024, "02"), period(2024, "01", date.today().year + 1, "01")):
        with pytest.raises(ValueError, match="Invalid Period"):
            sp.prefixes({"src": "PA", "states": ["AC"], "period": bad})
    assert sp.prefixes({"src": "PA", "period": period(2024, "01", 2024, "01")}) == ["PA"]
    assert StateYear().prefixes({"src": "SIM/", "states": ["RJ", "SP"], "year": [2021, 2022]}) == ["SIM/RJ2021", "SIM/RJ2022", "SIM/SP2021", "SIM/SP2022"]
    assert StateYear().prefixes({"src": "DO", "states": ["RJ"], "year": 2021}) == ["DORJ"]
    assert CountryYear().prefixes({"src": "SINAN/", "year": [2019, 2021]}) == ["SINAN/BR19", "SINAN/BR21"]
    assert CountryYear().prefixes({"src": "DENG", "year": 2019}) == ["DENG"]


def test_catalogue(spark):
    df = spark.createDataFrame([(e["name"], i) for i, e in enumerate(LISTING)], "name string, pos int")
    assert catalog.select(df, ["PA"]).count() == 8
    got = catalog.select(df, ["PASP1001", "PAAC1001", "PAAC"]).orderBy("prefix_no", "pos").select("name").collect()
    assert [r.name[:8] for r in got] == ["PASP1001", "PAAC1001", "PAAC1001", "PAAC1002", "PAAC1003"]
    assert catalog.select(df, []).count() == 0 and catalog.select(df, ["XX"]).count() == 0
    names = ["a", "b", "a", "c"]
    assert catalog.unique(names) == ["a", "b", "c"]
    assert catalog.chunks(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]] and catalog.chunks([], 3) == []
    with pytest.raises(ValueError):
        catalog.chunks(["a"], 0)
    chunked = catalog.numbered_chunks(df, 4).orderBy("pos").collect()
    assert [r.chunk for r in chunked] == [0, 0, 0, 0, 1, 1, 1, 1, 2]


class Remote:
    def __init__(self, files):
        self.files, self.got = files, []

    def list(self, path="/"):
        return [{"name": n, "size": len(b)} for n, b in self.files.items()]

    def download(self, dest, remote):
        import os

        if not os.path.exists(dest):
            self.got.append(remote)
            open(dest, "wb").write(self.files[remote.rsplit("/", 1)[-1]])

    def close(self):
        pass


def test_gateway_and_connect():
    g = Gateway(Remote({e["name"]: b"" for e in LISTING}), "/x/", StatePeriod())
    assert g.list({"src": "PA", "states": ["AC"], "period": period(2010, "01", 2010, "02")}, "short") == ["PAAC1001.dbc", "PAAC1002.dbc"]
    assert g.list({"src": "PA", "states": ["AC"]})[0] == {"name": "PAAC1001.dbc", "size": 0}

    def broken(host):
        raise OSError("no route")

    with pytest.raises(CouldNotConnect):
        FtpClient.connect("h", factory=broken)
    assert FtpClient.connect("h", lambda e, h: (str(e), h), broken) == ("no route", "h")


def test_explode_published_vector():
    assert implode.explode(bytes([0x00, 0x04, 0x82, 0x24, 0x25, 0x8F, 0x80, 0x7F])) == b"AIAIAIAIAIAIA"
    for bad in (b"", b"\x07\x04\x00", b"\x00\x04\x82"):
        with pytest.raises(implode.BrokenStream):
            implode.explode(bad)


@given(st.binary(max_size=3000))
@settings(max_examples=30, deadline=None)
def test_implode_round_trip(data):
    assert implode.explode(implode.implode(data)) == data


def test_implode_copies():
    for data in (b"", b"a", b"aa", b"aaa", b"a" * 5000, b"abc" * 4000, b" " * 100_000, bytes(range(256)) * 40):
        assert implode.explode(implode.implode(data)) == data
    table = dbf.write_table(FIELDS, records(2000))
    assert len(implode.implode(table)) < len(table) / 3


def records(n=50):
    return [
        {"PA_CODUNI": "2270196", "PA_SEXO": "F" if i % 2 else "M", "PA_UFMUN": "120040" if i % 3 else None, "QT": i, "VL": i / 4, "DT": date(2020, 1, 1 + i % 28), "OK": i % 2 == 0}
        for i in range(n)
    ]


def test_reader_and_writer(tmp_path):
    p = str(tmp_path / "X.dbc")
    w = dbc.DbcWriter(p, FIELDS)
    w.write(records(3))
    w.write({})
    w.close()
    r = dbc.DbcReader(p)
    assert (r.size, [f.name for f in r.fields]) == (4, [f.name for f in FIELDS])
    assert [len(r.read_batch(2)), len(r.read_batch(3)), len(r.read_batch(2))] == [2, 2, 0]
    assert list(r)[:3] == records(3) and set(list(r)[3].values()) == {None}
    assert len(dbc.DbcReader(p).read_batch(0)) == 4
    assert len(list(tmp_path.iterdir())) == 1


def test_writer_errors(tmp_path):
    for bad in (dbf.Field("N" * 11, "C", 5), dbf.Field("A", "Z", 5), dbf.Field("A", "C", -1)):
        with pytest.raises(dbc.InitializationError):
            dbc.DbcWriter(str(tmp_path / "b.dbc"), [bad])
    assert dbc.DbcWriter(str(tmp_path / "b.dbc"), [dbf.Field("A", "Z", 1)], on_init_error=lambda e: "fallback").fallback == "fallback"
    lost = []
    w = dbc.DbcWriter(str(tmp_path / "c.dbc"), [dbf.Field("A", "N", 2)], on_flush_error=lambda e, chunk: lost.extend(e.records))
    w.write([{"A": 12345}])
    w.close()
    assert lost == [{"A": 12345}] and dbc.DbcReader(str(tmp_path / "c.dbc")).size == 0
    w = dbc.DbcWriter(str(tmp_path / "d.dbc"), [dbf.Field("A", "N", 2)])
    w.write([{"A": 12345}])
    with pytest.raises(dbc.FlushError):
        w.close()


def test_deleted_blank_and_broken_values():
    data = bytearray(dbf.write_table([dbf.Field("A", "N", 3), dbf.Field("D", "D", 8)], [{"A": 1, "D": date(2020, 2, 3)}, {"A": 2}, {"A": 3}]))
    h = dbf.read_header(bytes(data))
    data[h.header_size + h.record_size] = ord("*")
    data[h.header_size + 1 : h.header_size + 4] = b"x y"
    got = [r for b in dbf.read_batches(bytes(data)) for r in b.to_pylist()]
    assert got == [{"A": None, "D": date(2020, 2, 3)}, {"A": 3, "D": None}]
    with pytest.raises(dbf.SchemaError):
        dbf.read_header(b"short")


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    for field, value in ((dbf.Field("A", "C", 3), "abcdef"), (dbf.Field("A", "C", 3), "日本"), (dbf.Field("A", "N", 2), 123), (dbf.Field("A", "N", 4, 2), 12.5)):
        with pytest.raises(ValueError):
            dbf.write_table([field], [{"A": value}])
    register(spark)
    with pytest.raises(Exception, match="does not fit"):
        spark.sql("select 'abcdef' A").write.format("dbc").option("sizes", "A:3").mode("append").save(str(tmp_path / "x"))


def test_columns_decode_as_their_cells_do():
    """Odd cells of every type, against reading one cell at a time."""
    fields = [dbf.Field("C", "C", 6), dbf.Field("I", "N", 8), dbf.Field("L", "N", 17), dbf.Field("F", "N", 8, 2), dbf.Field("D", "D", 8), dbf.Field("B", "L", 1)]
    cells = {
        "C": ["abc", " a b", "", "é", "x\0", "\0"], "I": ["12", "-7", "+5", "x", "3.9", ""], "L": ["90071992547409931", "1e3", "-2.5", "", "12a", "."],
        "F": ["1.25", ".5", "5.", "nan", "1,5", "-1e2"], "D": ["20240229", "20230229", "", "2024-1-1", "00000000", "19991231"], "B": ["T", "y", "F", "n", "?", ""],
    }
    body = b"".join(b" " + b"".join(cells[f.name][i].encode("latin-1").ljust(f.size) for f in fields) for i in range(6))
    data = bytearray(dbf.write_table(fields, [{}] * 6))
    h = dbf.read_header(bytes(data))
    data[h.header_size : h.header_size + len(body)] = body
    got = {f.name: [r for b in dbf.read_batches(bytes(data), rows=4) for r in b.to_pydict()[f.name]] for f in fields}
    assert got == {
        "C": ["abc", " a b", None, "é", "x", None], "I": [12, -7, 5, None, 3, None], "L": [90071992547409931, 1000, -2, None, None, None],
        "F": [1.25, 0.5, 5.0, None, None, -100.0], "D": [date(2024, 2, 29), None, None, None, None, date(1999, 12, 31)], "B": [True, True, False, False, None, None],
    }
    assert [len(b) for b in dbf.read_batches(dbf.write_table(fields, []))] == []


def test_failed_chunks_and_landing_once(spark, tmp_path):
    (tmp_path / "remote").mkdir(), (tmp_path / "land").mkdir()
    landed(tmp_path / "remote")
    (tmp_path / "remote" / "PAAC1003.dbc").write_bytes(b"broken")
    remote = Remote({p.name: p.read_bytes() for p in (tmp_path / "remote").iterdir()})
    o = Orchestrator(spark, Gateway(remote, "/d/", StatePeriod()), RunConfig(data_path=str(tmp_path / "land"), concurrency=1)).subset({"src": "PA", "states": ["AC"]})
    rows, failed = [], []
    assert o.run(lambda df: rows.append(df.count()), on_error=lambda e, chunk: failed.append((e.chunk, chunk))) == 2
    assert rows == [2500, 10] and failed == [(["PAAC1003.dbc"], ["PAAC1003.dbc"])]
    with pytest.raises(FailToScheduleJob, match="PAAC1003"):
        o.run(lambda df: df.count())
    assert sorted(remote.got) == ["/d/PAAC1001.dbc", "/d/PAAC1002.dbc", "/d/PAAC1003.dbc"]


def test_match_repositories_and_callback(spark, tmp_path):
    m = spark.sql("select struct(1 as id, 'a' as n) cohort, struct(2 as id) target, cast(null as double) score")
    kept, stored = matches.MatchRepository(), matches.StoredMatchRepository(spark, str(tmp_path / "m"))
    assert kept.all() is None
    for _ in range(2):
        kept.save(m), stored.save(m)
    assert kept.all().count() == stored.all().count() == 2 and stored.all().first().cohort == '{"id":1,"n":"a"}'
    kept.clear(), stored.clear()
    assert kept.all() is None and stored.all().count() == 0
    seen = spark.sparkContext.accumulator(0)
    matches.for_each(spark.range(10), lambda r: seen.add(r.id))
    assert seen.value == 45
    with pytest.raises(Exception, match="no record"):
        matches.for_each(spark.range(1), fail)


def fail(_):
    raise ValueError("no record")


def landed(tmp_path, names=("PAAC1001", "PAAC1002")):
    for k, n in enumerate(names):
        w = dbc.DbcWriter(str(tmp_path / f"{n}.dbc"), FIELDS[: 7 - k])
        w.write([{f: v for f, v in r.items() if k == 0 or f != "OK"} for r in records(2500 if k == 0 else 10)])
        w.close()
    return str(tmp_path)


def test_data_source_reads_prunes_pushes_and_writes(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    folder = landed(tmp_path / "in")
    df = spark.read.format("dbc").option("file_column", "file").load(folder)
    assert df.count() == 2510 and df.rdd.getNumPartitions() == 2
    assert df.where("PA_SEXO = 'F'").count() == 1255
    assert df.where("PA_SEXO = 'F' and PA_UFMUN in ('120040', 'x') and QT > 2").count() == sum(1 for n in (2500, 10) for r in records(n) if r["PA_SEXO"] == "F" and r["PA_UFMUN"] and r["QT"] > 2)
    assert bag(df.groupBy("file").count()) == [("PAAC1001.dbc", 2500), ("PAAC1002.dbc", 10)]
    assert df.where("OK is null").count() == 10
    criteria = json.dumps(CriteriaSet.set([StringCriteria("F", "PA_SEXO"), StringCriteria("120040", "PA_UFMUN")]).to_dict())
    early = spark.read.format("dbc").option("criteria", criteria).option("columns", "QT").load(folder)
    assert early.count() == df.where("PA_SEXO = 'F' and PA_UFMUN = '120040'").count() > 0
    assert spark.read.format("dbc").option("criteria", '[{"type": "string", "prop": "QT", "value": "1"}]').load(folder).count() == 0
    assert spark.read.format("dbc").option("columns", "QT").load(folder).columns == ["QT"]
    out = str(tmp_path / "out")
    df.select("PA_CODUNI", "QT", "VL", "DT", "OK").coalesce(1).write.format("dbc").option("sizes", "PA_CODUNI:7").mode("append").save(out)
    back = spark.read.format("dbc").load(out)
    assert bag(back) == bag(df.select("PA_CODUNI", "QT", "VL", "DT", "OK"))


def test_orchestrator(spark, tmp_path):
    (tmp_path / "remote").mkdir(), (tmp_path / "land").mkdir()
    landed(tmp_path / "remote")
    remote = Remote({p.name: p.read_bytes() for p in (tmp_path / "remote").iterdir()})
    config = RunConfig(data_path=str(tmp_path / "land"), filters=CriteriaSet.set([StringCriteria("F", "PA_SEXO")]))
    o = Orchestrator(spark, Gateway(remote, "/d/", StatePeriod()), config).subset({"src": "PA", "states": ["AC", "AC"]})
    assert o.files == ["PAAC1001.dbc", "PAAC1002.dbc"] and o.chunks == [o.files]
    assert o.exec().count() == 1255 and o.exec(lambda d: d.select("QT")).columns == ["QT"]
    assert bag(o.summary().drop("filters")) == [("PAAC1001.dbc", 2500, 1250, 0), ("PAAC1002.dbc", 10, 5, 0)]
    assert bag(global_summary(o.summary())) == [(2, 2510, 1255, 0)]
    assert sorted(remote.got) == ["/d/PAAC1001.dbc", "/d/PAAC1002.dbc"]
    assert all([tuple(f) for f in r.filters] == [("string", "PA_SEXO", ["F"])] for r in o.summary().collect())
    o.write_summary(str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 2
    empty = Orchestrator(spark, Gateway(remote, "/d/", StatePeriod()), config).subset({"src": "PA", "states": ["XX"]})
    assert empty.exec().count() == 0 and empty.summary().count() == 0 and bag(global_summary(empty.summary())) == [(0, 0, 0, 0)]


def test_systems():
    assert len(systems.STATES) == 27 and len(systems.CBO) == 23 and len(systems.SINAN_SOURCES) == 58
    sia = systems.SYSTEMS["sia"]
    assert sia.criteria.to_dict() == [{"type": "string", "prop": "PA_CODUNI", "value": "2270196"}] and sia.concurrency == 6
