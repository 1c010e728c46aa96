"""Components, mixing and entity matching against brute force and on edge cases."""

import itertools
import math
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from aroeira.llm import components, entities, mixing, subjects
from aroeira.session import durable

T0 = datetime(2024, 1, 1)


def closed(pairs):
    root = {}

    def top(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {(a, top(a)) for a in root}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("v", F.lit(1)).withColumn("m", F.lit(2))
    return {tuple(r) for r in components.components(components.edges_of(df, "a", "b")).collect()}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 260)]
    star = [(1000, 2000 + i) for i in range(150)]
    noise = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(150)]
    pairs = chain + star + noise + [(b, a) for a, b in noise] + [(7, 7)]
    rng.shuffle(pairs)
    assert groups(spark, pairs + [(None, 3), (4, None)]) == closed((a, b) for a, b in pairs if a != b)
    assert groups(spark, []) == set() and groups(spark, [(1, 1)]) == set()
    assert groups(spark, [(-5, 3), (3, 9)]) == {(-5, -5), (3, -5), (9, -5)}


def test_matches_that_count(spark):
    nan, rows = math.nan, []
    for i, (kind, score, t) in enumerate([("deterministic", None, None), ("probabilistic", 0.8, 0.8), ("probabilistic", 0.79, 0.8), ("probabilistic", nan, 0.1), ("probabilistic", None, 0.1), ("probabilistic", 1.0, None), (None, 0.9, 0.8)]):
        rows.append(((2 * i,), (2 * i + 1,), kind, t, score))
    rows += [(None, (1,), "deterministic", None, None), ((1,), (None,), "deterministic", None, None), ((50,), (50,), "deterministic", None, None)]
    df = spark.createDataFrame(rows, "cohort struct<rec_id:bigint>, target struct<rec_id:bigint>, link_type string, threshold double, score double")
    assert {tuple(r) for r in components.match_groups(df).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (12, 12), (13, 12)}


def test_fit_meets_sources_and_caps():
    rng = np.random.default_rng(1)
    n = 60
    size, source, lang, topic = rng.integers(1, 1000, n).astype(float), np.arange(n) % 4, rng.integers(0, 3, n), rng.integers(0, 5, n)
    cap = np.array([1.0, 2, 3, 4])
    share = np.array([0.1, 0.2, 0.3, 0.4])
    total = (cap * np.bincount(source, size) / share).min() * 0.8
    one_hot = lambda x: np.eye(x.max() + 1)[x]
    raked = mixing.fit(size, source, [one_hot(lang), (one_hot(topic) + one_hot((topic + 1) % 5)) / 2], share * total, cap)
    w = raked.weights
    assert 1 < raked.rounds <= mixing.ROUNDS and raked.residual < 0.05
    assert np.allclose(np.bincount(source, w * size), share * total) and (w <= cap[source] + 1e-9).all() and (w > 0).all()
    got, want = np.bincount(lang, w * size) / total, np.bincount(lang, size) / size.sum()
    assert np.abs(got - want).max() < 0.05


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices(["a", "b", "c", None, "other"], [60, 30, 4, 3, 3])[0], rng.choice(["pt", "en", None]), rng.choice([0, 5, 80, 300, 2000])) for i in range(4000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint").withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "x"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 3), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    got = {r.source: r for r in mixing.report(mixed, targets).collect()}
    for s, share, cap in (("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 3)):
        assert abs(got[s].reached_share - share / 0.9) < 0.01 and got[s].most_uses <= cap
    assert got["gone"].reached_share == 0 and got["c"].most_uses == 3
    assert mixed.where("tokens = 0 or source not in ('a', 'b', 'c')").count() == 0 and mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    assert sorted(mixed.collect()) == sorted(mixing.mix(sizes, targets).collect())
    small = mixing.mix(sizes, targets, total_tokens=20000)
    assert abs(small.agg(F.sum(F.col("tokens") * F.col("uses"))).first()[0] - 20000) < 6000
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0
    assert mixing.report(mixing.mix(sizes.limit(0), targets), targets).count() == 4


def test_assignment_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        w = np.round(rng.random((n, m)) * (rng.random((n, m)) > 0.3), 3)
        got = sum(w[a, b] for a, b in entities.best_assignment(w))
        k = min(n, m)
        best = max(sum(w[a, b] for a, b in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9


def brute_total(edges):
    """Greatest total weight of a one-to-one assignment, by trying all."""
    def go(rest):
        if not rest:
            return 0
        (c, t, w), *more = rest
        return max(go(more), w + go([e for e in more if e[0] != c and e[1] != t]))

    return go(edges)


def test_one_to_one(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.95), (2, 2, 0.9), (5, 7, 0.5), (5, 7, 0.2), (9, 9, 0.0)], "c bigint, t bigint, confidence double")
    rng = random.Random(8)
    noisy = list({(rng.randrange(7), rng.randrange(6)): rng.random() for _ in range(16)}.items())
    wide = spark.createDataFrame([(c, t, w) for (c, t), w in noisy], "c bigint, t bigint, confidence double")
    best = brute_total([(c, t, w) for (c, t), w in noisy])
    for limit in (1000, 0):  # in a task, by the auction
        monkeypatch.setattr(entities, "GROUP_LINKS", limit)
        assert sorted(map(tuple, entities.one_to_one(df).collect())) == [(1, 1), (2, 2), (5, 7)]
        got = [tuple(r) for r in entities.one_to_one(wide).collect()]
        assert len({c for c, _ in got}) == len({t for _, t in got}) == len(got)
        assert abs(sum(dict(noisy)[p] for p in got) - best) < 1e-6
        assert entities.one_to_one(df.limit(0)).count() == 0


def test_normal_forms(spark):
    names = {"SRA Márcio  de Babente": "marcio babente", "Babente, MÁRCIO": "marcio babente", "JoséMárcioSertagos": "jose marcio sertagos", "IGNORADA": "", "RN Ana Lima": "ana lima", "VÃ\x82NIA": "vania", "Dr": "dr", "Dr 12": "dr", "": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "name string, want string")
    rows = entities.name_tokens(df, ["name"]).collect()
    assert len(rows) == len(names) and all(" ".join(r.name) == r.want for r in rows), rows
    births = [("19801203", False, (1980, 12, 3)), ("03121980", True, (1980, 12, 3)), ("3-dez-1980", True, (1980, 12, 3)), ("1980-12-03", True, (1980, 12, 3)), ("3/12/80", True, (80, 12, 3)), ("1980", False, (1980, None, None))]
    births += [(x, False, (None, None, None)) for x in ("", None, "00000000", "x", "99999999")]
    for day_first in (True, False):
        mine = [(b, w) for b, f, w in births if f == day_first]
        got = entities.with_birth(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(mine)], "i int, birth string"), day_first)
        assert [(r.y, r.m, r.d) for r in got.orderBy("i").collect()] == [w for _, w in mine]


def people(spark, rows, names, extra):
    schema = ", ".join(f"{n} {'bigint' if i == 0 else 'string'}" for i, n in enumerate(names)) + ", " + extra
    return spark.createDataFrame(rows, schema)


def two_sources(spark, c_rows, t_rows):
    c = people(spark, [(*r, T0) for r in c_rows], ["cohort_id", "nome", "nome_mae", "dt_nasc", "sexo", "uf", "cidade", "endereco"], "loaded_at timestamp")
    t = people(spark, [(*r, None, T0, 1) for r in t_rows], ["target_id", "nome_paciente", "mae", "dt_nascto", "sexo", "uf_res", "munic_res", "endereco"], "idade int, loaded_at timestamp, id int")
    return c, t


def test_match_people(spark):
    c, t = two_sources(
        spark,
        [
            (1, "Ana Belmar Corlores", "Rosa Zamloção Belmar", "19800305", "F", "SP", "Lussaga", "Rua Um, 10"),
            (1, "Ana Belmar Corlores", "Rosa Zamloção Belmar", "19800305", "F", "SP", "Lussaga", "Rua Um, 10"),
            (2, "ANA BELMAR CORLORES", "ROSA BELMAR", "05/03/1980", "F", "RJ", "Outra", None),
            (3, "Paulo Belmar Corlores", "Rosa Zamloção Belmar", "19800305", "M", "SP", "Lussaga", "Rua Um, 10"),
            (4, "Caio Dutanes Hopa", None, "19500101", "M", "BA", "Vila", "Rua Dois, 2"),
            (None, "Sem Numero Algum", "Mae De Alguem", "19500101", "M", "BA", "Vila", "Rua Dois, 2"),
            (6, None, None, None, None, None, None, None), (7, "", "", "", "", "", "", ""),
        ],
        [
            (500, "Corlores, Ana Belmar", "ROSA ZAMLOCAO BELMAR", "5-mar-1980", "3", "SP", "LUSSAGA", "R. Um, 10"),
            (501, "Paulo Belmar Corlores", "Rosa Zamloção Belmar", "05031980", "1", "SP", "Lussaga", "R. Um"),
            (502, "Caio Dutanes Hopa", "Outra Mae Dutanes", "1915-07-20", "1", "BA", "Vila", "Rua Dois, 2"),
            (503, None, None, None, None, None, None, None),
        ],
    )
    got = entities.match_people(c, t)
    assert {(r.cohort_id, r.target_id) for r in got.collect()} == {(1, 500), (2, 500), (3, 501)}
    assert all(0 < r.confidence <= 1 for r in got.collect()) and got.columns == ["cohort_id", "target_id", "confidence"]
    assert entities.match_people(c.limit(0), t).count() == 0 == entities.match_people(c, t.limit(0)).count()


def brute_neighbours(rows, window):
    """Pairs within ``window`` places of the order of any key, by sorting each."""
    out = set()
    for k in range(len(rows[0]) - 1):
        order = [r[0] for r in sorted((r for r in rows if r[k + 1] is not None), key=lambda r: (r[k + 1], r[0]))]
        out |= {tuple(sorted((order[p], order[q]))) for p in range(len(order)) for q in range(p + 1, min(p + window + 1, len(order)))}
    return out


def test_blocks_lose_no_neighbours(spark):
    """Hot keys, keys of one row, missing keys; blocks shorter than a run of one key, and shorter than the window."""
    rng = random.Random(6)
    rows = [(i, f"k{i:04d}" if i < 1000 else "m" if i == 1000 else "n", None if i % 5 == 0 else f"s{rng.randrange(40)}") for i in range(2001)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, given string, last string")
    keys = {"given": F.col("given"), "last": F.col("last")}
    want = brute_neighbours(rows, 8)
    for block in (10_000, 50, 3):
        pairs = entities.neighbours(df, keys, 8, block).select("a.id", "b.id").collect()
        got = [tuple(sorted(p)) for p in pairs]
        assert len(got) == len(set(got)), "each pair once"
        assert set(got) == want
    assert entities.neighbours(df.limit(0), keys).count() == 0


def test_scores_and_confidences_by_hand(spark):
    """Sums of the parts of a comparison worked out by hand, and the confidence that follows."""
    ana = ("Ana Belmar Corlores", "Rosa Lima Belmar", "1980-03-05", "F", "SP", "Lussaga", "Rua Um, 10")
    others = {
        2: (ana, 8.5 + 6.5 + 7.0 + 0.5 + 1.5 + 3.5),
        3: (("Ana B. Corlores", None, "1980-05-03", "M", "RJ", "Outra", "Rua Nove, 7"), 6.0 + 0.0 + 4.5 - 1.5 - 0.5 - 0.3),  # last name, swapped day and month
        4: (("Ana Belmar", "Rosa Lima Belmar", "1980", None, None, None, None), 5.0 + 6.5 + 2.0),  # part of the name, year alone
        5: (("Ana Souza Prado", "Clara Souza", "1955-11-20", "F", "SP", "Lussaga", "Rua Um, 99"), -4.0 - 7.0 - 8.0 + 0.5 + 1.5 + 2.0),  # another person of the house
        6: (("Ana Belmar Corlores", "Rosa Lima Belmar", "1981-03-05", "F", "SP", "Lussaga", "Rua Um"), 8.5 + 6.5 + 4.5 + 0.5 + 1.5 + 2.0),  # year off by one
    }
    c, _ = two_sources(spark, [(1, *ana)] + [(i, *r) for i, (r, _) in others.items()], [])
    people = entities.with_known_names(entities.normalised(c, entities.COHORT, "c"))
    pairs = spark.createDataFrame([(1, i) for i in others], "x bigint, y bigint")
    scored = entities.score_pairs(entities.compared(people, pairs))
    got = {r.y: (r.score, r.p) for r in scored.withColumn("p", entities.confidence(F.col("score"))).collect()}
    for i, (_, score) in others.items():
        assert abs(got[i][0] - score) < 1e-9, (i, got[i], score)
        assert abs(got[i][1] - 1 / (1 + math.exp(10 - score))) < 1e-12
    for least in (7.5, 20.0):
        assert {r.y for r in entities.score_pairs(entities.compared(people, pairs), least).collect()} == {i for i, (_, s) in others.items() if s >= least}


def test_known_and_unknown_given_names(spark):
    rows = [(i, n, "Rosa Lima Belmar", "1980-01-01", "F", "SP", "X", "Rua Um, 1") for i, n in enumerate(["Maria Belmar Costa"] * 4 + ["Mariana Belmar Costa"] * 4 + ["Marya Belmar Costa"])]
    c, t = two_sources(spark, [], rows)
    p = entities.with_known_names(entities.normalised(t, entities.TARGET, "t"))
    assert {r.given: r.known for r in p.collect()} == {"maria": True, "mariana": True, "marya": False}
    pairs = {(r.x, r.y) for r in entities.links(p).collect()}
    assert not any((a < 4) != (b < 4) for a, b in pairs if 8 not in (a, b)) and (0, 8) in pairs


def test_every_row_comes_from_the_assignment(spark):
    """Each pair that comes out belongs to two persons that the assignment joined, and to each person only one."""
    s01 = "/root/testdata/sf0.01"
    cohort, target = spark.read.parquet(f"{s01}/cohort_people.parquet"), spark.read.parquet(f"{s01}/target_people.parquet")
    both = entities.normalised(cohort, entities.COHORT, "c").unionByName(entities.normalised(target, entities.TARGET, "t"))
    people = durable(entities.with_known_names(both.withColumn("id", 2 * F.col("id") + F.when(F.col("side") == "t", 1).otherwise(0))))
    person, same = entities.assigned(people, durable(entities.links(people)))
    of, joined = {r.id: r.person for r in person.collect()}, {tuple(r) for r in same.collect()}
    assert len({c for c, _ in joined}) == len({t for _, t in joined}) == len(joined)
    members = {}
    for i, p in of.items():
        members.setdefault(p, []).append(i)
    assert all(len({i % 2 for i in m}) == 1 for m in members.values()), "persons are of one source"
    want = {(i // 2, j // 2) for c, t in joined for i in members[c] for j in members[t]}
    rows = entities.match_people(cohort, target).collect()
    assert {(r.cohort_id, r.target_id) for r in rows} == want and len(rows) == len(want) > 600


def test_a_person_several_times_in_one_source(spark):
    """Two records without a strong link of their own are one person by a common partner; twins are not."""
    ana, bia = "Ana Belmar Corlores", "Bianca Belmar Corlores"
    c, t = two_sources(
        spark,
        [(1, ana, "Rosa Zamgado Belmar", "19800305", "F", "SP", "Lussaga", "Rua Um, 10"), (2, bia, "Rosa Zamgado Belmar", "19800305", "F", "SP", "Lussaga", "Rua Um, 10")],
        [(500, ana, None, "1980-03-05", "3", "SP", "Lussaga", None), (501, ana, "Rosa Zamgado Belmar", None, "3", "SP", "Lussaga", "Rua Um, 10"), (502, bia, "Rosa Zamgado Belmar", "1980-03-05", "3", "SP", "Lussaga", "Rua Um, 10")],
    )
    assert {(r.cohort_id, r.target_id) for r in entities.match_people(c, t).collect()} == {(1, 500), (1, 501), (2, 502)}


def test_sizes_and_marginals(spark):
    """Every message gets its tokens and subjects; languages and topics keep their shares, a message of two topics halved."""
    law, sport = "The judge of the court spoke.", "The coach of the team spoke."
    text = {"law": f"{law} {law} {law}", "sport": f"{sport} {sport} {sport}", "both": f"{law} {law} {law} {sport} {sport} {sport}", "": "Nothing here."}
    model = subjects.SubjectModel(["law", "sport"], {"judge": 0, "court": 1, "coach": 2, "team": 3}, np.array([[0.4, 0, 1e-6], [0.4, 0, 1e-6], [0, 0.4, 1e-6], [0, 0.4, 1e-6]]), {"judge", "court", "coach", "team"})
    rows = [(i, "ab"[i % 5 == 0], ["pt", "en", None][i % 3], text[["law", "sport", "both", ""][i % 7 % 4]]) for i in range(900)] + [(2000, "a", "pt", None), (2001, "a", "pt", ""), (2002, None, "pt", law)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").withColumn("topic", F.lit(1)), model)
    got = {r.doc_id: (r.tokens, r.topic) for r in sizes.collect()}
    assert len(got) == 903 and got[2000] == got[2001] == (0, None) and got[0][1] == "law" and got[1][1] == "sport" and got[2][1] == "law|sport" and got[3][1] is None
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    mixed, raked = mixing.drawn(sizes, targets)
    m = {(r.marginal, r.label): r for r in mixing.marginals(mixed, sizes, raked).collect()}
    assert set(m) == {("lang", "pt"), ("lang", "en"), ("lang", None), ("topic", "law"), ("topic", "sport"), ("topic", None)}
    assert all(abs(r.wanted_share - r.reached_share) < 0.02 and r.residual < 0.001 for r in m.values())
    assert all(abs(sum(r.wanted_share for k, r in m.items() if k[0] == x) - 1) < 1e-5 for x in ("lang", "topic"))
    assert mixing.marginals(mixed.limit(0), sizes.limit(0), None).count() == 0
