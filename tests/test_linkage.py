import math
import random
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from aroeira.functions.scoring import fellegi_sunter_weights, log2_ratio
from aroeira.operators import index, linkage
from aroeira.operators.linkage import CohortConfig, LinkageConfig, LinkageStrategy
from aroeira.plans import reference_queries

from .conftest import bag


def frame(spark, names, rows, kinds=None):
    schema = ", ".join(f"{n} {k}" for n, k in zip(names.split(), (kinds or "string " * 20).split()))
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def link(cohort, *steps, **options):
    s = LinkageStrategy("t", **options).cohort(cohort, CohortConfig("c"))
    for target, config in steps:
        s.link(target, config)
    return s.exec()


def pairs(m, c="ID", t="ID"):
    return sorted((r.cohort[c], r.target[t], None if r.score is None else round(r.score, 3)) for r in m.collect())


def det(on, blocking=None):
    return LinkageConfig("d", "deterministic", on, blocking)


def prob(strategy, on, blocking=None, weights=None, threshold=None):
    return LinkageConfig("p", "probabilistic", on, blocking, strategy, weights or {}, threshold)


def same(*fields):
    return {f: f for f in fields}


def test_deterministic_and_document(spark):
    c = frame(spark, "ID UF SEXO NOME", [("1", "AC", "M", "Joao"), ("2", "AC", "F", "Maria"), ("3", "AM", "M", "Pedro")])
    t = frame(spark, "ID UF SEXO NOME", [("10", "AC", "M", "Joao"), ("20", "AC", "F", "Maria"), ("30", "RR", "M", "Lucas")])
    m = link(c, (t, det(same("UF", "SEXO"))))
    assert pairs(m) == [("1", "10", None), ("2", "20", None)]
    r = m.where("cohort.ID = '1'").first()
    assert (r.cohort.NOME, r.target.NOME, r.step.name, r.step.type) == ("Joao", "Joao", "d", "deterministic") and r.matched_at is not None
    for i in ("sort-merge", "hash", index.ExternalIndex("cohort_of_tests", 4)):
        assert pairs(link(c, (t, det(same("UF", "SEXO"))), index=i)) == pairs(m)


def test_simple_scores(spark):
    c = frame(spark, "ID UF CIDADE IDADE", [("1", "AC", "RioBranco", "30"), ("2", "AM", "Manaus", "45")])
    t = frame(spark, "ID UF CIDADE IDADE", [("10", "AC", "RioBranco", "30"), ("20", "AC", "Macapa", "50"), ("30", "AM", "Belem", "25")])
    three = same("UF", "CIDADE", "IDADE")
    assert pairs(link(c, (t, prob("simple", three, same("UF"), threshold=0.5)))) == [("1", "10", 1.0)]
    w = {"UF": 3, "CIDADE": 2, "IDADE": 1}
    t2 = frame(spark, "ID UF CIDADE IDADE", [("10", "AC", "RioBranco", "99"), ("20", "AC", "Macapa", "50")])
    assert pairs(link(c, (t2, prob("simple", three, same("UF"), w, 0.6)))) == [("1", "10", 0.833)]
    for zero in (0, None, math.nan):
        assert pairs(link(c, (t2, prob("simple", three, same("UF"), w, zero)))) == []
    assert pairs(link(c, (t, prob("simple", three, same("UF"), {"UF": 0, "CIDADE": 0, "IDADE": 0}, 0.1)))) == []
    assert len(pairs(link(c, (t, prob("simple", three, same("UF"), {"UF": -1, "CIDADE": 0.5, "IDADE": 0}, -1))))) == 3


def test_fellegi_sunter_scores(spark):
    c = frame(spark, "ID UF SEXO", [("1", "AC", "M"), ("2", "AM", "F")])
    t = frame(spark, "ID UF SEXO", [("10", "AC", "M"), ("20", "AC", "F"), ("30", "AM", "M")])
    mu = {"UF": {"m": 0.9, "u": 0.1}, "SEXO": {"m": 0.8, "u": 0.2}}
    assert pairs(link(c, (t, prob("fellegi-sunter", same("UF", "SEXO"), same("UF"), mu, 1)))) == [("1", "10", 5.17), ("1", "20", 1.17), ("2", "30", 1.17)]
    c2 = frame(spark, "ID UF CIDADE", [("1", "AC", "RioBranco")])
    t2 = frame(spark, "ID UF CIDADE", [("10", "AC", "RioBranco"), ("20", "AC", "Macapa"), ("30", "AM", "Belem")])
    w = {"UF": {"agreement": 10, "disagreement": -8}, "CIDADE": {"agreement": 5, "disagreement": -3}}
    assert pairs(link(c2, (t2, prob("fellegi-sunter", same("UF", "CIDADE"), same("UF"), w, 5)))) == [("1", "10", 15.0), ("1", "20", 7.0)]
    assert pairs(link(c, (t, prob("fellegi-sunter", {}, same("UF"))))) == [("1", "10", 0.0), ("1", "20", 0.0), ("2", "30", 0.0)]
    assert pairs(link(c, (t, prob("simple", {}, same("UF"))))) == []
    assert len(pairs(link(c, (t, det({}, same("UF")))))) == 3


def test_weight_kinds_and_extremes():
    got = fellegi_sunter_weights(same("a", "b", "c", "d", "e"), {"a": 7, "b": {"m": 0.5, "u": 0.25}, "c": {"x": 1}, "d": {"m": 0.9, "u": 0.1, "agreement": 1, "disagreement": 0}})
    assert got["a"] == got["e"] == (1.0, -1.0) and got["c"] == (0.0, 0.0)
    assert got["b"][0] == 1.0 and round(got["d"][0], 2) == 3.17
    assert log2_ratio(1, 0) == math.inf and log2_ratio(0, 1) == -math.inf and math.isnan(log2_ratio(0, 0))


def test_infinite_and_missing_scores(spark):
    c = frame(spark, "ID K A B", [("1", "k", "x", "y"), ("2", "k", "x", "z"), ("3", "k", "w", "y")])
    w = {"A": {"m": 0.9, "u": 0}, "B": {"m": 1, "u": 0.1}}
    m = pairs(link(c, (c, prob("fellegi-sunter", same("A", "B"), same("K"), w))))
    assert {(a, b) for a, b, _ in m} == {("1", "1"), ("2", "2"), ("3", "3")} and all(s == math.inf for *_, s in m)


def test_nulls_blanks_types_absent_and_case(spark):
    c = frame(spark, "ID A B", [("1", None, "x"), ("2", "a", None), ("3", None, None)])
    assert pairs(link(c, (c, det(same("A", "B"))))) == [("1", "1", None), ("2", "2", None), ("3", "3", None)]
    assert pairs(link(c, (c, det(same("A"))))) == [("2", "2", None)]
    one = frame(spark, "ID A", [("1", 7)], "string int")
    text = frame(spark, "ID A", [("2", "7")])
    whole = frame(spark, "ID A", [("3", 7.0), ("4", 7.5)], "string double")
    assert pairs(link(one, (text, det(same("A"))))) == []
    assert pairs(link(one, (text, det({}, same("A"))))) == [("1", "2", None)]
    assert pairs(link(one, (whole, det(same("A"))))) == [("1", "3", None)]
    assert pairs(link(one, (text, det({"ID": "ID", "a": "a"}, same("A"))))) == []
    assert pairs(link(one, (text, det({"x": "y"}, same("A"))))) == [("1", "2", None)]
    assert pairs(link(one, (text, det({}, {})))) == []
    nan = frame(spark, "ID A K", [("1", math.nan, "k"), ("2", None, "k")], "string double string")
    assert len(pairs(link(nan, (nan, det(same("A"), same("K")))))) == 4


def test_collision_steps_and_errors(spark):
    c = frame(spark, "ID A B", [("1", "a_b", "c")])
    t = frame(spark, "ID A B", [("2", "a", "b_c")])
    assert pairs(link(c, (t, det({}, same("A", "B"))))) == [("1", "2", None)]
    a, b = frame(spark, "ID UF SEXO", [("T1", "AC", "M")]), frame(spark, "ID UF SEXO", [("T2", "AC", "M")])
    people = frame(spark, "ID UF SEXO", [("1", "AC", "M")])
    m = link(people, (a, LinkageConfig("x", "deterministic", same("UF"))), (b, LinkageConfig("y", "deterministic", same("UF", "SEXO"))))
    assert sorted((r.target.ID, r.step.name) for r in m.collect()) == [("T1", "x")]
    m = link(people, (a, LinkageConfig("x", "deterministic", same("UF"))), (b, LinkageConfig("y", "deterministic", same("UF", "SEXO"))), reindex_per_step=True)
    assert sorted(r.step.name for r in m.collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="Cohort not defined"):
        LinkageStrategy("t").exec()
    with pytest.raises(ValueError, match="No linkage defined"):
        LinkageStrategy("t").cohort(people, CohortConfig("c")).exec()
    for config in (LinkageConfig("z", "other", same("UF")), prob("other", same("UF"))):
        assert link(people, (a, config)).count() == 0
    assert link(people.limit(0), (a, det(same("UF")))).count() == 0 == link(people, (a.limit(0), det(same("UF")))).count()


def test_providers_and_cohort_parser(spark):
    class Service:
        asked = None

        def subset(self, s):
            self.asked = s

        def exec(self):
            return frame(spark, "ID UF", [("1", "ac")])

    s = Service()
    m = LinkageStrategy("t").cohort(s, CohortConfig("c", {"src": "PA"}, lambda d: d.selectExpr("ID", "upper(UF) UF"))).link(frame(spark, "ID UF", [("2", "AC")]), det(same("UF"))).exec()
    assert pairs(m) == [("1", "2", None)] and s.asked == {"src": "PA"}


def test_large_blocks(spark):
    c = spark.range(2000).selectExpr("id ID", "'M' SEXO", "cast(id % 3 as string) UF", "cast(id as string) COD")
    t = spark.range(500).selectExpr("id ID", "'M' SEXO", "cast(id % 3 as string) UF", "cast(id as string) COD")
    assert link(c, (t, det(same("COD"), same("SEXO")))).count() == 500
    config = prob("fellegi-sunter", same("UF"), same("SEXO"), {"UF": {"m": 0.8, "u": 0.1}}, 0)
    assert link(c, (t, config), tasks=8).count() == link(c, (t, config)).count() == 333_334
    c = spark.range(1000).selectExpr("id ID", "cast(id % 2 as string) SEXO", "cast(id % 5 as string) UF", "cast(id % 10 as string) CIDADE")
    assert link(c, (c.where("ID < 500"), prob("simple", same("UF", "CIDADE"), same("SEXO"), threshold=0.8))).count() == 50_000


def model(cohort, target, config):
    """The definition as loops over rows."""
    out = []
    block = config.on if config.blocking is None else config.blocking
    for c in cohort:
        for t in target:
            key = "_".join(c[f] or "" for f in block)
            if key and key == "_".join(t[f] or "" for f in block.values()):
                eq = {a: c[a] == t[b] for a, b in config.on.items()}
                if config.type == "deterministic":
                    if all(eq.values()):
                        out.append((c["ID"], t["ID"], None))
                else:
                    score = sum((config.weights.get(f, 1) if e else 0) for f, e in eq.items()) / sum(config.weights.get(f, 1) for f in eq)
                    if score >= (config.threshold or 0.85):
                        out.append((c["ID"], t["ID"], round(score, 3)))
    return sorted(out)


value = st.sampled_from([None, "", "a", "b", "_"])


@given(st.lists(st.tuples(value, value), max_size=6), st.lists(st.tuples(value, value), max_size=6), st.booleans(), st.sampled_from([0.5, 0.9]))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_against_row_loops(spark, left, right, deterministic, threshold):
    rows = [[{"ID": str(i), "A": a, "B": b} for i, (a, b) in enumerate(side)] for side in (left, right)]
    config = det(same("A", "B")) if deterministic else prob("simple", same("A", "B"), same("A", "B") if threshold > 0.6 else same("A"), {"A": 2}, threshold)
    c, t = (frame(spark, "ID A B", [(r["ID"], r["A"], r["B"]) for r in side]) for side in rows)
    assert pairs(link(c, (t, config))) == model(*rows, config)


def test_index(spark):
    df = frame(spark, "k id", [("key1", "1"), ("key1", "2"), ("", "3"), (None, "4"), ("key2", "5")])
    ix = index.build(df, ["k"])
    assert bag(index.entries(ix)) == [("key1", 2), ("key2", 1)]
    asked = frame(spark, "key x", [("key1", ""), ("key1", ""), ("none", ""), (None, "")])
    assert sorted(r.value.id for r in index.get(ix, asked).collect()) == ["1", "2"]
    assert bag(index.has(ix, asked)) == [("key1", True), ("none", False), (None, False)]
    assert [index.full_chunks(n, 25) for n in (0, 24, 500, 501)] == [0, 0, 20, 20]
    with pytest.raises(ValueError):
        index.full_chunks(3, 0)
    index.persist(ix, "people_index", 2)
    index.persist(ix, "people_index", 2)
    assert spark.table("people_index").count() == 3
    spark.sql("drop table people_index")


def test_hot_blocks_are_cut_by_load(spark):
    """One block with nearly all pairs, cut on its larger side; pairs stay the same."""
    c = spark.range(300).selectExpr("cast(id as string) ID", "if(id < 250, 'hot', concat('k', id)) K", "id % 3 A")
    t = spark.range(900).selectExpr("cast(id as string) ID", "if(id < 800, 'hot', concat('k', id % 300)) K", "id % 3 A")
    config = prob("simple", {"A": "A"}, {"K": "K"}, threshold=1)
    keyed = lambda df, name: linkage._keyed(df, ["K"], name).select("block_key")
    (key, shards, divided), = linkage.hot_blocks(keyed(c, "cohort"), keyed(t, "target"), 8)
    assert (key, divided) == ("hot", True) and shards == 16
    want = sorted((a.ID, b.ID) for a in c.collect() for b in t.collect() if a.K == b.K and a.A == b.A)
    for left, right, turn in ((c, t, False), (t, c, True)):
        got = [(r.cohort.ID, r.target.ID) for r in link(left, (right, config), tasks=8).collect()]
        assert sorted((b, a) if turn else (a, b) for a, b in got) == want
    cut = linkage._sharded(linkage._keyed(t, ["K"], "target"), "target", [("hot", 16, True)])
    sizes = [r["count"] for r in cut.where("block_key = 'hot'").groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 100


def test_counts_are_those_of_the_pairs(spark, tmp_path):
    """Nulls, not-a-number, blanks, types, fields that are not there, repeated rows, hot blocks and several steps."""
    rnd = random.Random(7)
    some = lambda n, **values: [(str(i), *(rnd.choice(v) for v in values.values())) for i in range(n)]
    values = {"K": ["k", "k", "k", "l", "", None], "A": ["a", "k", "", None], "N": [0.0, -0.0, 1.0, 2.5, math.nan, None]}
    c = frame(spark, "ID K A N", some(60, **values), "string string string double")
    t = frame(spark, "ID K A N I", some(80, **values, I=[0, 1, 2, None]), "string string string double int")
    k, wants = same("K"), []
    configs = [
        det(same("K", "A", "N")), det({"N": "I"}, k), det(same("N")), det({"A": "I", "K": "K"}), det({}, k), det({"A": "y"}, k), det({"A": "K", "K": "K"}, k),
        prob("simple", same("A", "N"), k, {"A": 2}, 0.5), prob("fellegi-sunter", same("A", "N"), k, {"A": {"m": 0.9, "u": 0}}, 0.5), LinkageConfig("z", "fuzzy", k),
    ]
    for config in configs:
        s = LinkageStrategy("t", tasks=8).cohort(c, CohortConfig("c")).link(t, config)
        wants.append(s.exec().count())
        assert bag(s.count()) == [(wants[-1],)], config
    assert [c for c, n in zip(configs, wants) if not n] == [configs[5], configs[9]]
    outside, told = index.ExternalIndex("counted_cohort", 4, str(tmp_path / "index")), []
    s = LinkageStrategy("t", index=outside).cohort(c, CohortConfig("c")).link(t, det(k))
    assert bag(s.count()) == [(s.exec().count(),)]
    outside.drop(spark)
    s = LinkageStrategy("t", index=index.ChunkedIndex(25, lambda i, n: told.append(n)), reindex_per_step=True).cohort(c, CohortConfig("c")).link(t, det(k)).link(c, configs[0])
    assert bag(s.count()) == [(s.exec().count(),)] and told[: len(told) // 2] == told[len(told) // 2 :] != []
    with pytest.raises(ValueError, match="No linkage defined"):
        LinkageStrategy("t").cohort(c, CohortConfig("c")).count()


def test_unknown_type_beside_a_large_block(spark, tmp_path):
    """A million parts of one brand are 10^12 pairs, which nobody has to make to count them."""
    spark.range(10**6).selectExpr("id p_partkey", "'Brand#11' p_brand", "'type' p_type", "cast(id % 50 as int) p_size").write.parquet(str(tmp_path / "part.parquet"))
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert bag(reference_queries.QUERIES["link_unknown_type"](spark, str(tmp_path))) == [(10**12, 0)]
    finally:
        late.cancel()
