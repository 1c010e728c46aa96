"""Quality profile, drifting schemas, skewed keys: small cases, brute force, edge cases."""

import json
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from aroeira.operators import drift, quality, skew
from aroeira.plans import core_queries

from .conftest import bag

T0 = datetime(2024, 1, 1)
SCHEMA = "rec_id bigint, file string, sexo string, cges string, tpfin string, extra string, loaded_at timestamp"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", T0) for r in rows], SCHEMA)


def fill(first_id, file, n, sexo="F", cges="01", tpfin="060000"):
    return [(first_id + i, file, sexo, cges, tpfin) for i in range(n)]


def test_found_pattern_edges(spark):
    odd = ["M", "F ", "f", "M\n", " ", "", "  ", None, "Ｍ"]
    df = records(spark, [(i, "n0/PASP2301.dbc", s, c, t) for i, (s, c, t) in enumerate(zip(odd, ["00", "01", "99", "1", "01\n", "٠١", None, "", "100"], ["060000", "06000", "0600000", "06000a", "", None, "060000\n", "６00000", " "]))])
    got = {(r.column_name, r.rec_id) for r in quality.found(df.unionByName(df)).collect()}
    assert got == {("sexo", i) for i in (1, 2, 3, 4, 8)} | {("cges", i) for i in (0, 3, 4, 5, 8)} | {("tpfin", i) for i in (1, 2, 3, 6, 7)}
    assert quality.found(df.unionByName(df)).count() == 15


def test_jump_and_shift_at_their_limits(spark):
    a, b, c, d = ("n0/PASP2212.dbc", "n0/PASP2302.dbc", "n0/PASP2303.dbc", "n0/PARJ2303.dbc")
    rows = fill(0, a, 250) + fill(1000, b, 200) + fill(2000, b, 50, sexo=None) + fill(3000, c, 122) + fill(4000, c, 127, sexo=" ") + fill(5000, d, 400, sexo=None)
    got = bag(quality.found(records(spark, rows)).select("case_kind", "file", "column_name", "rec_id"))
    # exactly 0.2 is no jump; 127 of 249 against 50 of 250 is one; another series has no file before it
    assert got == [("missing_jump", c, "sexo", -1)]
    rows = fill(0, a, 500) + fill(1000, b, 300) + fill(2000, b, 200, sexo="M") + fill(3000, c, 199, sexo="M")
    assert quality.found(records(spark, rows)).count() == 0  # a shift of exactly 0.4, then too few values
    rows += fill(4000, c, 1, sexo="M")
    assert bag(quality.found(records(spark, rows)).select("case_kind", "file", "column_name")) == [("shift", c, "sexo")]


def test_empty_nulls_and_keyless_rows(spark):
    assert quality.found(records(spark, [])).count() == 0 and quality.profile(records(spark, []), rules=quality.RECORD_RULES[:3]).count() == 0
    df = records(spark, [(None, None, "x", "01", "060000")] * 2 + [(1, None, "x", "01", "060000")] * 2)
    assert quality.once(df, "rec_id", ["sexo"]).count() == 3
    assert bag(quality.found(df).select("file", "rec_id")).count((None, 1)) == 1


def test_states_merge_to_the_whole(spark):
    df = spark.range(1000).selectExpr("id rec_id", "concat('f', id % 3) file", "if(id % 7 = 0, null, cast(id % 5 as string)) sexo", "cast(id as double) v")
    rules = [quality.ColumnRule("sexo", allowed=("1", "2")), quality.ColumnRule("v", low=10)]
    whole = quality.states(df, "file", rules).drop("sketch")
    parts = [quality.states(df.where(f"rec_id % 4 = {i}"), "file", rules) for i in range(4)]
    merged = quality.merge_states(*parts, load="file", numeric=("v",))
    assert bag(merged.drop("sketch").select(*sorted(whole.columns))) == bag(whole.select(*sorted(whole.columns)))
    est = merged.where("column_name = 'v'").select(F.hll_sketch_estimate("sketch")).collect()
    assert all(abs(r[0] - 333) < 20 for r in est)


def test_distinct_values_of_each_load(spark, data):
    rows = [("a", "M", 1.5), ("a", "M", 1.5), ("a", "m", -0.0), ("a", " ", 0.0), ("a", None, None), ("b", None, 2.0), (None, "F", 2.0)]
    df = spark.createDataFrame(rows, "file string, sexo string, v double")
    got = bag(quality.distinct_values(df, columns=["sexo", "v"]))
    assert got == sorted([("a", "sexo", 2), ("a", "v", 2), ("b", "sexo", 0), ("b", "v", 1), (None, "sexo", 1), (None, "v", 1)], key=repr)
    exact = {(r.file, r.column_name): r.distinct_values for r in core_queries.p1_load_distinct(spark, data).collect()}
    merged = {(r.file, r.column_name): (r.distinct_values, r.sketch_is_close) for r in core_queries.p1_incremental_distinct(spark, data).collect()}
    assert {c for _, c in exact} == {r.name for r in quality.RECORD_RULES} and merged == {k: (n, True) for k, n in exact.items()}


def test_found_from_batches_of_stored_states(spark, tmp_path):
    """States of two batches that share loads, stored apart and added up, give what the whole gives."""
    a, b = "n0/PASP2301.dbc", "n0/PASP2302.dbc"
    rows = fill(0, a, 300) + fill(1000, b, 150) + fill(2000, b, 150, sexo="M") + fill(3000, b, 100, sexo=None, cges="x") + [(None, b, "?", "01", "060000")] * 3
    df, rules = records(spark, rows), [r for r in quality.RECORD_RULES if r.name in quality.FOUND_COLUMNS]
    for i in range(2):
        half = quality.once(df, "rec_id", ["file", *quality.FOUND_COLUMNS]).where(f"pmod(coalesce(rec_id, 0), 2) = {i}")
        quality.append_states(quality.value_states(half, "file", "rec_id", rules), str(tmp_path), str(i))
        quality.append_states(quality.value_states(half, "file", "rec_id", rules), str(tmp_path), str(i))  # a batch written again is replaced
    states = quality.stored_states(spark, str(tmp_path))
    assert states.groupBy("file", "column_name", "value", "broken", "record").count().where("count > 1").count() > 0, "the halves share lines"
    want = bag(quality.found(df).select("case_kind", "file", "column_name", "rec_id"))
    for s in (states, quality.merge_value_states(states)):
        assert bag(quality.found_in_states(s, "file", "rec_id").select("case_kind", "file", "column_name", "rec_id")) == want
    assert len(want) == 100 + 3 + 2 and ("shift", b, "sexo", -1) in want


def test_control_limits(spark):
    rows = [(f"n0/PASP23{m:02d}.dbc", "sexo", 0.05 if m != 9 else 0.5) for m in range(1, 12)]
    m = spark.createDataFrame(rows, "file string, column_name string, share double")
    assert bag(quality.control_limits(m, "file", "share").select("file", "history")) == [("n0/PASP2309.dbc", 8)]


def test_every_column_is_tested_against_the_loads_before(spark):
    names = [r.name for r in quality.RECORD_RULES]
    good = {"sexo": "F", "cges": "01", "tpfin": "060000", "ufmun": "290030", "cboprof": "225125", "qt_aprov": 1}
    bad = {"coduni": "x", "ufmun": "x", "cboprof": "?", "cns_pac": "x", "competencia": "x", "dt_atend": "x", "idade": -5, "qt_aprov": -1, "vl_aprov": -1.0, "sexo": "x", "cges": "x", "tpfin": "x"}
    moved = {"coduni": "5000000", "ufmun": "350030", "cboprof": "515105", "cns_pac": "1" * 15, "competencia": "201901", "dt_atend": "20190101", "idade": 90, "qt_aprov": 9, "vl_aprov": 900.0, "sexo": "M", "cges": "02", "tpfin": "070000"}

    def month(m, change=None):
        for i in range(300):
            r = good | {"coduni": f"{9100000 + i}", "cns_pac": f"7{m:04d}{i:010d}", "competencia": f"2023{m:02d}", "dt_atend": f"2023{m:02d}{1 + i % 28:02d}", "idade": 20 + i % 9, "vl_aprov": 10 + i / 100}
            yield (1000 * m + i, f"n0/PASP23{m:02d}.dbc", *((change or r)[c] for c in names))

    kinds = ", ".join(f"{c} {'int' if c in ('idade', 'qt_aprov') else 'double' if c == 'vl_aprov' else 'string'}" for c in names)
    for change, case, metric in ((dict.fromkeys(names), "missing_jump", "missing_share"), (bad, "broken_jump", "broken_share"), (moved, "shift", "distinct_values")):
        rows = [r for m in range(1, 6) for r in month(m)] + list(month(6, change))
        df = spark.createDataFrame(rows, f"rec_id bigint, file string, {kinds}")
        found = bag(quality.departures(df.unionByName(df)).where(f"case_kind = '{case}'").select("file", "column_name"))
        assert found == sorted([("n0/PASP2306.dbc", c) for c in names], key=repr), case
        assert not quality.departures(df).where("file != 'n0/PASP2306.dbc'").count(), "months of one kind do not depart"
        outside = {(r.file, r.column_name) for r in quality.limits_of_states(df).where(f"metric = '{metric}'").collect()}
        varied = {"coduni", "cns_pac", "dt_atend", "idade", "vl_aprov"}
        assert outside == {("n0/PASP2306.dbc", c) for c in names if metric != "distinct_values" or c in varied}, metric


def lists(spark, rows):
    f = "array<struct<name:string,type:string,size:int>>"
    return spark.createDataFrame([(a, None if b is None else [(*x, 1) for x in b], c) for a, b, c in rows], f"file string, fields {f}, loaded_at timestamp")


def raws(spark, files):
    return spark.createDataFrame([(f, i, json.dumps(p) if isinstance(p, dict) else p) for f, ps in files.items() for i, p in enumerate(ps)], "file string, line_no int, payload string")


def test_drift(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    f = [f"n0/PASP23{m:02d}.dbc" for m in range(1, 6)]
    meta = lists(spark, [
        (f[0], [("SEX", "C"), ("WEIGHT", "N"), ("OBS", "C")], t[0]),
        (f[1], [("X", "C")], t[0]),
        (f[1], [("obs", "c"), (" gender ", "C"), ("WEIGHT", "C"), ("", "C")], t[1]),
        (f[2], None, t[2]),
        (f[3], [("GENDER", "N"), ("HEIGHT", "N"), ("OBS", "C")], t[3]),
        (f[4], [("OBS", "C"), ("HEIGHT", "N"), ("SEX", "C")], t[4]),
        ("odd name", [("A", "C")], t[0]), (None, [("A", "C")], t[0]),
    ])
    ps = lambda sex, **kw: [{sex: "MF"[i % 2], "OBS": "seen", **{k: v + i % 9 for k, v in kw.items()}} for i in range(30)]
    raw = raws(spark, {f[0]: ps("SEX", WEIGHT=70.5), f[1]: ps("gender", WEIGHT=70.5) + ["{broken", None, "[]"], f[3]: ps("GENDER", HEIGHT=160), f[4]: ps("SEX", HEIGHT=160)})
    got = bag(drift.changes(meta, raw))
    assert got == sorted([
        (f[1], "renamed", "SEX", "GENDER"), (f[1], "retyped", "WEIGHT", "WEIGHT"), (f[3], "removed", "WEIGHT", ""), (f[3], "added", "", "HEIGHT"),
        (f[3], "retyped", "GENDER", "GENDER"), (f[4], "renamed", "GENDER", "SEX"), (f[4], "retyped", "GENDER", "SEX"),
    ], key=repr)
    whole = drift.consistent(raw.unionByName(raw), meta)
    assert whole.count() == 123 and whole.where("readable").count() == 120
    assert whole.where("GENDER is not null").count() == 120 and whole.where("HEIGHT > 159.5").count() == 60
    assert drift.versions(drift.current_lists(meta)).count() == 5


def test_one_table_keeps_every_value(spark):
    """Retyped values come out cast by their file's letter; what fits no cast is kept beside."""
    f = [f"n0/PASP23{m:02d}.dbc" for m in range(1, 8)]
    letters = lambda d, n, c, e="L": [("DAY", d), ("VALUE", n), ("CODE", c), ("FLAG", e)]
    meta = lists(spark, [(x, None if x == f[6] else letters("C", "C", "N", "C") if x == f[4] else letters("D", "N", "C"), T0) for x in f])
    plain = {"DAY": "2023-01-31", "VALUE": 25.02, "CODE": "0071", "FLAG": True}
    raw = raws(spark, {
        **{x: [plain] * 3 for x in f[:4]},
        f[4]: [{"DAY": "31/01/2023", "VALUE": "25,02", "CODE": 71, "FLAG": "T"}, {"DAY": "20230131", "VALUE": "0000025.02", "CODE": "71", "FLAG": "t"}],
        f[5]: [{"DAY": "31/02/2023", "VALUE": "1.025,02", "CODE": "A1", " other ": "kept"}, {"DAY": "soon", "VALUE": "12 kg", "CODE": " ", "code": "0071", "FLAG": "maybe"}, '{"DAY": "20'],
        f[6]: [{"CODE": 71, "DAY": None, "VALUE": ""}],
    })
    rows = drift.consistent(raw, meta).collect()
    got = {(r.file, r.line_no): (r.DAY and str(r.DAY), r.VALUE, r.CODE, r.FLAG, [tuple(x) for x in r.rejects]) for r in rows}
    whole = ("2023-01-31", 25.02, "0071", True, [])
    assert all(got[x, i] == whole for x in f[:4] for i in range(3)) and got[f[4], 0] == got[f[4], 1] == whole
    assert got[f[5], 0][:4] == (None, 1025.02, "A1", None) and sorted(got[f[5], 0][4]) == [("DAY", "31/02/2023"), ("OTHER", "kept")]
    assert got[f[5], 1][:4] == (None, None, "0071", None) and sorted(got[f[5], 1][4]) == [("DAY", "soon"), ("FLAG", "maybe"), ("VALUE", "12 kg")]
    assert got[f[5], 2] == (None, None, None, None, [("", '{"DAY": "20')]) and got[f[6], 0] == (None, None, "0071", None, [])


def test_names_that_meet_keep_their_columns(spark):
    """A becomes B in one series and B becomes C in another; a third file holds both A and C: no value is lost."""
    f = {x: f"n0/{x}.dbc" for x in ("PASP2301", "PASP2302", "PARJ2301", "PARJ2302", "PAMG2301", "PAMG2302")}
    meta = lists(spark, [(f["PASP2301"], [("A", "C")], T0), (f["PASP2302"], [("B", "C")], T0), (f["PARJ2301"], [("B", "C")], T0), (f["PARJ2302"], [("C", "C")], T0)] + [(f[x], [("A", "C"), ("C", "C")], T0) for x in ("PAMG2301", "PAMG2302")])
    same = lambda *names: [{n: f"v{i % 7}" for n in names} for i in range(20)]
    raw = raws(spark, {f["PASP2301"]: same("A"), f["PASP2302"]: same("B"), f["PARJ2301"]: same("B"), f["PARJ2302"]: same("C"), f["PAMG2301"]: same("A", "C"), f["PAMG2302"]: same("A", "C")})
    assert bag(drift.changes(meta, raw)) == [(f["PARJ2302"], "renamed", "B", "C"), (f["PASP2302"], "renamed", "A", "B")]
    whole = drift.consistent(raw, meta)
    assert whole.columns == ["file", "line_no", "readable", "A", "C", "rejects"] and whole.where("size(rejects) > 0").count() == 0
    got = {r.file: (r.a, r.c) for r in whole.groupBy("file").agg(F.count("A").alias("a"), F.count("C").alias("c")).collect()}
    assert got == {f["PASP2301"]: (20, 0), f["PASP2302"]: (20, 0), f["PARJ2301"]: (0, 20), f["PARJ2302"]: (0, 20), f["PAMG2301"]: (20, 20), f["PAMG2302"]: (20, 20)}
    assert {r.kept_values for r in drift.kept_values(whole).collect()} == {20, 40}
    s = drift.steps(drift.current_lists(meta), raw).collect()
    assert len({(r.from_fingerprint, r.to_fingerprint) for r in s}) == 2 and all(r.from_fingerprint != r.to_fingerprint for r in s)


def test_drift_of_nothing(spark):
    empty, none = lists(spark, []), raws(spark, {})
    assert drift.changes(empty, none).count() == 0
    one = lists(spark, [("n0/PASP2301.dbc", [("A", "C")], T0), ("n0/PASP2302.dbc", [("B", "C")], T0)])
    assert bag(drift.changes(one, none)) == [("n0/PASP2302.dbc", "added", "", "B"), ("n0/PASP2302.dbc", "removed", "A", "")]


def test_packing_is_balanced():
    placed = skew.pack([(i, 1 + i % 7) for i in range(200)], 8)
    loads = Counter()
    for i, t in placed.items():
        loads[t] += 1 + i % 7
    assert max(loads.values()) - min(loads.values()) <= 7


def test_skewed_keys_against_brute_force(spark):
    rows = [(i % 5000, "F" if i % 10 < 6 else (None if i % 10 == 6 else f"k{i % 500}"), i % 3, 0) for i in range(6000)]
    rows = [(a, k if a >= 1000 else rows[a][1], q if a >= 1000 else rows[a][2], z) for a, k, q, z in rows] + [(None, "F", 1, 0)] * 3
    df = spark.createDataFrame(rows, "rec_id bigint, sexo string, q int, task int").withColumn("cges", F.lit("same"))
    expected = defaultdict(dict)
    for n, (a, k, q, _) in enumerate(rows):
        expected[k][(a, n if a is None else 0)] = q
    got = {r.key_value: (r.records, r.q) for r in skew.per_key(df, ["sexo", "cges"], "rec_id", ["q"], tasks=7).where("column_name = 'sexo'").collect()}
    assert got == {k: (len(v), sum(v.values())) for k, v in expected.items()}
    plan = skew.plan_shards(skew.long_keys(df, ["sexo"], []), "column_name", "key_value", 7)
    assert any(len(t) > 1 for _, _, t in plan.heavy)
    placed = skew.to_tasks(skew.long_keys(df, ["sexo", "cges"], ["rec_id"]), skew.plan_shards(skew.long_keys(df, ["sexo", "cges"], []), "column_name", "key_value", 7), "column_name", "key_value", F.col("rec_id"))
    sizes = [n for n in placed.rdd.glom().map(len).collect()]
    assert max(sizes) < 1.6 * sum(sizes) / 7
    assert set(bag(skew.dominant(df, ["sexo", "cges"], "rec_id"))) == {("sexo", "F"), ("cges", "same")}


def test_skew_join(spark):
    left = spark.range(3000).selectExpr("id r", "case when id % 3 > 0 then 'hot' when id % 5 = 0 then null else concat('k', id % 40) end k", "id v", "id shard")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "k string, v int")
    got = skew.skew_join(left, right, "k", "r", tasks=6)
    want = left.join(right.withColumnRenamed("v", "right_v"), "k")
    cols = ["r", "k", "v", "right_v"]
    assert bag(got.select(*cols)) == bag(want.select(*cols))
    assert skew.skew_join(left.limit(0), right, "k", "r").count() == 0


def test_skew_join_moves_each_side_once_and_merges(spark, data):
    """The sharded side is never broadcast, whatever run-time statistics say."""
    df = core_queries.p3_join(spark, data)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("SortMergeJoin [task") == 1 and "SinglePartition" not in plan.split("SortMergeJoin [task")[1].split("BroadcastHashJoin")[0]


def test_extra_columns_do_not_clash(spark, data):
    df = spark.read.parquet(f"{data}/sia_records.parquet")
    more = df.withColumns({c: F.lit(1) for c in ("task", "bad", "s", "prev", "records", "p", "h_key")})
    assert bag(quality.found(more)) == bag(quality.found(df))
    assert bag(skew.dominant(more, ["sexo", "cges"], "rec_id")) == bag(skew.dominant(df, ["sexo", "cges"], "rec_id"))


def test_queries_run(spark, data):
    for name, q in core_queries.QUERIES.items():
        df = q(spark, data)
        assert df.columns and df.count() >= 0, name
