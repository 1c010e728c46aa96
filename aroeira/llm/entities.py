"""Matching entities across sources without keys.

Both sources are brought to one writing of names, dates, codes and places.  Sorted
neighbourhood: the records of both are sorted by several composite keys, and each
record is compared with those in a window of places before it.  A comparison adds
weighted similarities of name, mother, birth, sex and place.  Strong links inside one
source make its records *persons of that source*; links between the sources make pairs
of persons, and a one-to-one assignment that maximises the total confidence settles
which person of one source is which of the other.  The records of two assigned persons
come out pair by pair.

All sort orders are laid out by one sort of (key number, key, id); every record then
carries its place in each order.  Places are dense, so an order falls into blocks of
equal size however often a key value occurs, the rows before a block go to it as well,
and no neighbour is lost.  A pair that is near in several orders is scored in the first
of them only.

Defined results: of a repeated id the latest row counts; a record without id, or with
neither name nor any other field of a key, takes part in no comparison on that key;
missing fields neither agree nor disagree; extra columns are ignored; an empty source
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, kept, release, scratch, ship
from .components import components, edges_of

WINDOW = 8
ROWS_PER_BLOCK = 4_000
#: Score from which a link inside a source joins two records into one person of it.
STRONG = 9.0
#: Score from which a link between the sources is a candidate.
WEAK = 7.5
#: Two records of one source with a strong link to one record of the other are one person from this score on.
SHARED = 2.0
#: A given name is known, not a misspelling, if it makes up this share of the records.
KNOWN_SHARE = 0.0005


@dataclass(frozen=True)
class Source:
    """Field names of one source; ``day_first``: eight digits are ddmmyyyy."""

    key: str
    name: str
    mother: str
    birth: str
    sex: str
    state: str
    city: str
    address: str
    loaded: str
    age: str | None = None
    day_first: bool = False


COHORT = Source("cohort_id", "nome", "nome_mae", "dt_nasc", "sexo", "uf", "cidade", "endereco", "loaded_at")
TARGET = Source("target_id", "nome_paciente", "mae", "dt_nascto", "sexo", "uf_res", "munic_res", "endereco", "loaded_at", "idade", True)

# Titles, particles, placeholders, month names, sex codes, street kinds, accented letters.
TITLES = ("sr", "sra", "dr", "dra", "d", "dona", "prof", "profa", "rn")
PARTICLES = ("de", "da", "do", "das", "dos", "e")
UNKNOWN = ("", "ignorada", "ignorado", "nao informado", "nao informada", "desconhecida", "desconhecido", "sem informacao", "nan", "null", "none")
MONTHS = "jan fev mar abr mai jun jul ago set out nov dez"
SEXES = {"M": "M", "F": "F", "1": "M", "3": "F"}
YEARS = (1850, 2100)
STREETS = {"r": "rua", "av": "avenida", "trav": "travessa", "tv": "travessa", "est": "estrada", "estr": "estrada"}
ACCENTS = ("áàâãäåăāéèêëēíìîïīóòôõöōúùûüūçñýÿªº", "aaaaaaaaeeeeeiiiiioooooouuuuucnyyao")


def _staged(df: DataFrame, columns: list[str], *steps) -> DataFrame:
    """Each step in turn over the columns: a projection of its own, so no step is worked out twice."""
    for step in steps:
        df = df.withColumns({c: step(F.col(c)) for c in columns})
    return df


def _untwisted(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 turned back."""
    back = F.encode(text, "ISO-8859-1").cast("string")
    return F.when(text.rlike("[ÃÂ]"), F.when(~text.rlike(r"[^\x00-\xff]"), F.when(F.is_valid_utf8(back), back).otherwise(text)).otherwise(text)).otherwise(text)


def _split_run_on(text: Column) -> Column:
    return F.when((F.length(text) > 12) & ~F.trim(text).contains(" "), F.regexp_replace(text, "(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ")).otherwise(text)


def _bare(text: Column) -> Column:
    """Lower-case letters and digits without accents, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *ACCENTS), "[^a-z0-9,]+", " "))


def plain(df: DataFrame, columns: list[str]) -> DataFrame:
    return _staged(df, columns, _untwisted, lambda c: F.when(c.rlike(r"\p{M}"), F.regexp_replace(c, r"\p{M}+", "")).otherwise(c), _bare)


def name_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tokens of names, given name first, without titles and particles."""
    known = lambda p: F.when(~p.isin(*UNKNOWN), p).otherwise("")
    turned = lambda p: F.when(p.contains(","), F.regexp_replace(p, r"\A([^,]*),(.*)\z", "$2 $1")).otherwise(p)
    words = lambda p: F.filter(F.split(F.translate(p, ",", " "), " "), lambda t: (t != "") & ~t.isin(*PARTICLES) & t.rlike("[a-z]"))
    first = lambda p: F.array_position(F.transform(p, lambda t: t.isin(*TITLES)), F.lit(False))
    untitled = lambda p: F.when(F.get(p, F.lit(0)).isin(*TITLES), F.when(first(p) > 0, F.slice(p, first(p).cast("int"), F.size(p))).otherwise(F.slice(p, -1, 1))).otherwise(p)
    rest = _staged(plain(_staged(df, columns, _split_run_on), columns), columns, known, turned, words, untitled)
    return rest.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in columns})


def with_birth(df: DataFrame, day_first: bool) -> DataFrame:
    """Adds ``y``, ``m``, ``d`` of ``birth`` as far as written; a year of two digits stays below 100."""
    eight = r"\A([0-9]{2})([0-9]{2})([0-9]{4})\z" if day_first else r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z"
    iso, local = r"\A([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\z", r"\A([0-9]{1,2})[-/. ]([0-9]{1,2}|[a-z]{3})[a-z]*[-/. ]([0-9]{4}|[0-9]{2})\z"
    s = F.col("birth")
    pieces = F.when(s.rlike(eight), F.regexp_replace(s, eight, "$3-$2-$1" if day_first else "$1-$2-$3")).when(s.rlike(iso), F.regexp_replace(s, iso, "$1-$2-$3")).when(s.rlike(local), F.regexp_replace(s, local, "$3-$2-$1"))
    df = df.withColumn("birth", F.lower(F.trim("birth"))).withColumn("ymd", F.split(pieces, "-"))
    month = F.coalesce(F.get("ymd", F.lit(1)).try_cast("int"), F.floor((F.instr(F.lit(MONTHS), F.get("ymd", F.lit(1))) + 3) / 4).cast("int"))
    df = df.withColumns({"y": F.get("ymd", F.lit(0)).cast("int"), "m": month, "d": F.get("ymd", F.lit(2)).cast("int"), "alone": F.when(F.length(s) == 4, s.try_cast("int"))})
    df = df.withColumn("whole", F.col("m").between(1, 12) & F.col("d").between(1, 31) & ((F.length(F.get("ymd", F.lit(0))) < 4) | F.col("y").between(*YEARS)))
    kept = F.when(F.col("whole"), F.col("y")).otherwise(F.coalesce(F.when(F.col("y").between(*YEARS), F.col("y")), F.when(F.col("alone").between(*YEARS), F.col("alone"))))
    return df.withColumns({"y": kept, "m": F.when(F.col("whole"), F.col("m")), "d": F.when(F.col("whole"), F.col("d"))}).drop("ymd", "alone", "whole")


def normalised(df: DataFrame, source: Source, side: str) -> DataFrame:
    """One row per id with the fields that comparisons use."""
    cols = [source.key, source.name, source.mother, source.birth, source.sex, source.state, source.city, source.address]
    slim = df.where(F.col(source.key).isNotNull()).select(
        *(F.col(c).cast("bigint" if c == source.key else "string") for c in cols),
        (F.col(source.age).cast("int") if source.age else F.lit(None).cast("int")).alias("age"),
        F.col(source.loaded).alias("loaded"),
    )
    slim = slim.toDF("id", "name", "mother", "birth", "sex", "uf", "city", "address", "age", "loaded")
    body = F.struct("name", "mother", "birth", "sex", "uf", "city", "address", "age", F.year("loaded").alias("year"))
    latest = slim.groupBy("id").agg(F.max_by(body, F.struct(F.col("loaded"), F.xxhash64(body).alias("tie"))).alias("b")).select("id", "b.*")

    filled = lambda c: F.when(c != "", c)
    latest = with_birth(name_tokens(plain(latest, ["city", "address"]), ["name", "mother"]), source.day_first)
    words = F.filter(F.split(F.translate("address", ",", " "), " "), lambda w: w != "")
    code = F.upper(F.trim("sex"))
    parsed = latest.select(
        "id", F.col("name").alias("t"), F.col("mother").alias("mt"), "y", "m", "d", words.alias("a"),
        reduce(lambda c, x: c.when(code == x[0], x[1]), list(SEXES.items())[1:], F.when(code == "M", "M")).alias("sex"),
        filled(F.upper(F.trim("uf"))).alias("uf"), filled(F.translate("city", " ", "")).alias("city"),
        F.when(F.col("age").between(0, 120), F.col("year") - F.col("age")).alias("by_age"),
    )
    numbered = (F.size("a") > 1) & F.element_at("a", -1).rlike(r"\A[0-9]+\z")
    kinds = F.create_map(*(F.lit(x) for k in STREETS.items() for x in k))
    named = F.when(numbered, F.slice("a", 1, F.size("a") - 1)).otherwise(F.col("a"))
    street = F.transform(named, lambda w, i: F.when(i == 0, F.coalesce(kinds[w], w)).otherwise(w))
    last = lambda c: F.when(F.size(c) > 1, F.element_at(c, -1))
    return parsed.select(
        F.lit(side).alias("side"), "id", F.get("t", F.lit(0)).alias("given"), last("t").alias("last"), filled(F.array_join("t", "")).alias("compact"), F.col("t").alias("tokens"),
        F.get("mt", F.lit(0)).alias("m_given"), last("mt").alias("m_last"), filled(F.array_join("mt", "")).alias("m_compact"), F.col("mt").alias("m_tokens"),
        "y", (F.col("y") % 100).alias("y2"), "m", "d", "sex", "uf", "city", filled(F.array_join(street, "")).alias("street"), F.when(numbered, F.element_at("a", -1)).alias("number"), "by_age",
    )


def with_known_names(people: DataFrame) -> DataFrame:
    """Adds ``known``: whether the given name is too frequent to be a misspelling.

    At most 1 / ``KNOWN_SHARE`` names can be known, so they are broadcast.
    """
    counts = people.where("given is not null").groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    total = people.agg(F.count(F.lit(1)).alias("total"))
    known = counts.crossJoin(F.broadcast(total)).where((F.col("n") >= KNOWN_SHARE * F.col("total")) & (F.col("n") >= 3)).select("given", F.lit(True).alias("known"))
    return people.join(F.broadcast(known), "given", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def sort_keys() -> dict[str, Column]:
    """The composite keys; a record whose leading field is missing has no key."""
    birth = F.concat(F.lpad(F.col("y2").cast("string"), 2, "0"), F.lpad(F.coalesce("m", F.lit(0)).cast("string"), 2, "0"), F.lpad(F.coalesce("d", F.lit(0)).cast("string"), 2, "0"))
    some = lambda *cs: F.concat_ws("|", *(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in cs))
    return {
        "name": F.when(F.col("compact").isNotNull(), some("compact", birth)),
        "surname": F.when(F.col("last").isNotNull(), some("last", "given", birth)),
        "birth": F.when(F.col("m").isNotNull() & F.col("given").isNotNull(), some(birth, "given", "last")),
        "mother": F.when(F.col("m_compact").isNotNull() & F.col("given").isNotNull(), some("m_compact", "given", birth)),
        "place": F.when(F.col("street").isNotNull() & F.col("given").isNotNull(), some("uf", "street", "given", "number")),
    }


def places(people: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(id, at): each record's dense place in the order of every key, null where it has no key.

    One sort by (key number, key, id): the range partitioner cuts on all three, so rows
    of one key value spread too.  A place is the partition's first place plus the row's number in it.
    """
    spark = people.sparkSession
    named = F.array(*(F.struct(F.lit(i).alias("k"), c.alias("key")) for i, c in enumerate(keys.values())))
    entries = people.select("id", F.inline(named)).where("key is not null")
    ordered = durable(entries.orderBy("k", "key", "id").select("id", "k", F.monotonically_increasing_id().alias("row")))
    part, row = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one line per partition
    before = np.concatenate([[0], np.cumsum([r["n"] for r in counts])]).tolist()
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(counts, before)], "part bigint, start bigint")
    placed = ordered.select("id", "k", part.alias("part"), row.alias("row")).join(F.broadcast(starts), "part").select("id", "k", (F.col("start") + F.col("row")).alias("place"))
    return placed.groupBy("id").agg(F.array(*(F.max(F.when(F.col("k") == i, F.col("place"))) for i in range(len(keys)))).alias("at"))


def neighbours(people: DataFrame, keys: dict[str, Column], window: int = WINDOW, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(a, b): record structs at most ``window`` places apart in the order of a key, each pair once.

    An order falls into blocks of ``rows_per_block`` places; the ``window`` rows before a
    block are sent to it too, to be met but not to meet.  A pair near in an earlier order
    is left out of the later ones, so pairs are neither stored nor made distinct.
    """
    block = max(rows_per_block, window)
    rows = people.join(places(people, keys), "id")
    p = F.struct(*people.columns, "at")
    k = F.filter(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda i: F.get("at", i).isNotNull())
    rows = rows.select(p.alias("p"), F.explode(k).alias("k")).withColumn("place", F.get("p.at", F.col("k")))
    own, over = F.floor(F.col("place") / block), F.col("place") % block >= block - window
    homes = F.array_compact(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.when(over, F.struct((own + 1).alias("block"), F.lit(False).alias("own")))))
    rows = rows.select("p", "k", "place", F.inline(homes))
    order = Window.partitionBy("block").orderBy("place")
    met = F.collect_list(F.struct("k", "p")).over(order.rowsBetween(-window, -1))
    pairs = rows.withColumn("met", met).where("own").select("k", F.col("p").alias("b"), F.explode("met").alias("m")).select("k", F.col("m.k").alias("mk"), F.col("m.p").alias("a"), "b")
    near = lambda i: F.coalesce(F.abs(F.get("a.at", F.lit(i)) - F.get("b.at", F.lit(i))) <= window, F.lit(False))
    seen = reduce(lambda x, i: x | ((F.col("k") > i) & near(i)), range(len(keys) - 1), F.lit(False))
    return pairs.where((F.col("k") == F.col("mk")) & ~seen).select("a", "b")


def similar(a: Column, b: Column) -> Column:
    """1 for equal texts, falling with the edit distance; null if one is missing."""
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _both(field: str) -> Column:
    return F.col(f"a.{field}").isNotNull() & F.col(f"b.{field}").isNotNull()


def _equal(field: str) -> Column:
    return F.coalesce(F.col(f"a.{field}") == F.col(f"b.{field}"), F.lit(False))


def same_given() -> Column:
    """Whether the given names of a and b may be one name; two known names that differ are not."""
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    initial = ((F.length(A("given")) == 1) | (F.length(B("given")) == 1)) & (F.substring(A("given"), 1, 1) == F.substring(B("given"), 1, 1))
    letters = lambda x: F.array_sort(F.split(x("given"), ""))
    misspelt = (similar(A("given"), B("given")) >= 0.66) | ((F.length(A("given")) == F.length(B("given"))) & (letters(A) == letters(B)))
    near = (A("given") == B("given")) | initial | (~(A("known") & B("known")) & misspelt)
    run_together = A("compact").startswith(B("given")) | B("compact").startswith(A("given"))
    return F.coalesce(near, F.lit(False)) | (F.coalesce(run_together, F.lit(False)) & (A("last").isNull() | B("last").isNull()))


def _birth_parts() -> dict[str, Column]:
    """What two births have in common.

    Columns of their own for :func:`_birth_score`: one expression of all would be a
    method too long for the JVM to compile, ten times slower.
    """
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    two_digits = (A("y") < 100) | (B("y") < 100)
    gap = F.abs(A("y2") - B("y2"))
    age = lambda x: F.coalesce(F.when(x("y") >= 100, x("y")), x("by_age"))
    first = lambda x: (x("m") == 1) & (x("d") == 1)
    return {
        "dated": _both("y"), "full": _both("m"), "same_m": _equal("m"), "same_d": _equal("d"), "years": F.abs(age(A) - age(B)), "near_year": gap.isin(1, 10, 90, 99),
        "same_year": F.when(two_digits, A("y2") == B("y2")).otherwise(A("y") == B("y")),
        "apart": F.when(two_digits, F.least(gap, 100 - gap)).otherwise(F.abs(A("y") - B("y"))) >= 15,  # a parent of the same name
        "swapped": (A("m") == B("d")) & (A("d") == B("m")), "near_day": F.abs(A("d") - B("d")).isin(1, 10), "default_day": first(A) | first(B),
    }


def _birth_score() -> Column:
    same_year, near_year, apart, m, d = (F.col(c) for c in ("same_year", "near_year", "apart", "same_m", "same_d"))
    swapped, near_day, years = F.col("swapped"), F.col("near_day"), F.col("years")
    by_age = F.when(years.isNull(), 0.0).when(years <= 2, 0.7).when(years.between(9, 11), 0.0).when(years >= 15, -8.0).otherwise(-4.0)
    return (
        F.when(~F.col("dated"), by_age)
        .when(~F.col("full"), F.when(same_year, 2.0).when(near_year, 0.0).when(apart, -8.0).otherwise(-5.0))
        .when(same_year & m & d, 7.0)
        .when(same_year & (swapped | (m & near_day) | F.col("default_day")) | (near_year & m & d), 4.5)
        .when(same_year & (m | d), 2.5).when(near_year & (swapped | (m & near_day)), 2.5).when(m & d & ~apart, 0.0).when(same_year, -2.0).when(apart, -8.0).otherwise(-5.0)
    )


def _place_score() -> Column:
    same = lambda f, least: _equal(f) | (similar(F.col(f"a.{f}"), F.col(f"b.{f}")) >= least)
    sex = F.when(~_both("sex"), 0.0).when(_equal("sex"), 0.5).otherwise(-1.5)
    city = F.when(~_both("city"), 0.0).when(same("city", 0.8), 1.5).when(_equal("uf"), 0.0).otherwise(-0.5)
    street = F.when(~_both("street"), 0.0).when(same("street", 0.85), F.when(_equal("number"), 3.5).otherwise(2.0)).otherwise(-0.3)
    return sex + city + street


def _mother_score() -> Column:
    """Of ``m_whole``, the similarity of the whole names."""
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    shared, least = F.size(F.array_intersect(A("m_tokens"), B("m_tokens"))), F.least(F.size(A("m_tokens")), F.size(B("m_tokens")))
    given, last = (F.coalesce(similar(A(f), B(f)) >= 0.75, F.lit(False)) for f in ("m_given", "m_last"))
    m = F.col("m_whole")
    return (
        F.when(~_both("m_compact"), 0.0).when(m == 1, 6.5).when(m >= 0.88, 6.0)
        .when((shared == least) & (least >= 2), 4.5).when(given & last, 4.5).when(given & (shared >= 2), 3.5)
        .when(given & (least <= 2), 2.0).when(m >= 0.75, 3.0).when(given, -3.0).otherwise(-7.0)
    )


def _name_score() -> Column:
    """Of ``whole``, the similarity of the whole names."""
    A, B = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    rest = lambda x: F.array_remove(x("tokens"), x("given"))
    shared = F.size(F.array_intersect(rest(A), rest(B)))
    subset = (F.size(F.array_except(rest(A), rest(B))) == 0) | (F.size(F.array_except(rest(B), rest(A))) == 0)
    # a field may have cut the name off
    cut_off = (F.least(F.length(A("compact")), F.length(B("compact"))) >= 12) & (A("compact").startswith(B("compact")) | B("compact").startswith(A("compact")))
    last = F.coalesce(similar(A("last"), B("last")) >= 0.75, F.lit(False))
    w = F.col("whole")
    return F.when(w == 1, 8.5).when(w >= 0.88, 8.0).when(cut_off, 7.0).when(last, 6.0).when(subset & (shared > 0), 5.0).when(shared >= 2, 3.0).when(w >= 0.75, 4.0).when(shared >= 1, 1.0).otherwise(-4.0)


def _kept(df: DataFrame, columns: dict[str, Column], test: Column | None = None) -> DataFrame:
    """``df`` with ``columns``, each worked out once: a filter is not pushed below a generator."""
    out = df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return out if test is None else out.where(test)


def score_pairs(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """(x, y, score) with x < y of record structs (a, b), of those that reach ``least``.

    The cheap parts come first; names are compared only where the sum can still reach ``least``.
    """
    reach = lambda rest: None if least is None else F.col("score") + F.lit(rest) >= F.lit(least)
    p = _kept(pairs.select("a", "b"), _birth_parts()).select("a", "b", _birth_score().alias("birth"))
    p = _kept(p, {"score": F.col("birth") + _place_score()}, reach(8.5 + 6.5)).drop("birth")
    p = _kept(p, {"m_whole": similar(F.col("a.m_compact"), F.col("b.m_compact"))})
    p = _kept(p.withColumnRenamed("score", "s0"), {"score": F.col("s0") + _mother_score()}, reach(8.5)).drop("s0")
    p = _kept(p, {"whole": similar(F.col("a.compact"), F.col("b.compact"))})
    return _kept(p.withColumnRenamed("score", "s0"), {"x": F.least("a.id", "b.id"), "y": F.greatest("a.id", "b.id"), "score": F.col("s0") + _name_score()}, reach(0.0)).select("x", "y", "score")


def links(people: DataFrame, window: int = WINDOW, least: float = WEAK) -> DataFrame:
    """(x, y, score): scored pairs of records from all sort keys, each pair once."""
    return score_pairs(neighbours(people, sort_keys(), window).where(same_given()), least)


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of rows to columns with the greatest total weight (Hungarian method).

    Pairs of weight zero are not assigned.
    """
    flipped = weights.shape[0] > weights.shape[1]
    w = weights.T if flipped else weights
    n, m = w.shape
    cost = w.max() - w if w.size else w
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        slack, back, done, j = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool), 0
        while owner[j]:
            done[j] = True
            row = owner[j]
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row - 1, open_ - 1] - u[row] - v[open_]
            better = reduced < slack[open_]
            slack[open_[better]], back[open_[better]] = reduced[better], j
            nxt = open_[np.argmin(slack[open_])]
            delta = slack[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            slack[open_] -= delta
            j = nxt
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs if w[a, b] > 0)


def auction(edges: DataFrame) -> DataFrame:
    """(c, t) of a one-to-one assignment of ``edges`` (c, t, weight > 0, whole) with the greatest total weight.

    The auction algorithm with falling increments, every round a few joins, so a
    connected group of any size is settled exactly without gathering it.  To let anyone
    stay alone the graph is doubled: c and t each get a mirror that they may take for
    nothing, and mirrors may pair as their originals do.  Weights times the number of
    bidders plus one and a last increment of 1 make the result exact.
    """
    spark = edges.sparkSession
    bidders = edges.select(F.countDistinct("c") + F.countDistinct("t")).first()[0]
    if not bidders:
        return edges.select("c", "t")
    c, t = F.col("c"), F.col("t")
    node = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("id"))
    worth = (F.col("weight") * (bidders + 1)).cast("bigint")
    option = lambda p, o, v: F.struct(p.alias("p"), o.alias("o"), v.cast("bigint").alias("v"))
    ways = F.array(option(node(0, c), node(0, t), worth), option(node(1, t), node(1, c), worth), option(node(0, c), node(1, c), F.lit(0)), option(node(1, t), node(0, t), F.lit(0)))
    options = durable(edges.select(F.inline(ways)).groupBy("p", "o").agg(F.max("v").alias("v")))
    # state of each object: its price and who has it
    state = durable(options.select("o").distinct().select("o", F.lit(0).cast("bigint").alias("price"), F.lit(None).cast("struct<kind:int,id:bigint>").alias("owner")))
    step = max(1, options.agg(F.max("v")).first()[0] // 4)
    while True:
        taken = state.where("owner is not null").select(F.col("owner").alias("p"))
        free = durable(options.join(taken, "p", "left_anti"))
        if free.isEmpty():
            if step == 1:
                break
            step = max(1, step // 64)  # a round costs jobs, whatever its bids: few phases
            after = durable(state.withColumn("owner", F.lit(None).cast("struct<kind:int,id:bigint>")))
        else:
            gain = free.join(state.select("o", "price"), "o").withColumn("gain", F.col("v") - F.col("price"))
            ranked = gain.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("gain"), "o"))).where("n <= 2")
            best = ranked.groupBy("p").agg(F.min_by(F.struct("o", "price"), "n").alias("b"), (F.max("gain") - F.min("gain")).alias("lead"))
            bids = best.select("b.o", "p", (F.col("b.price") + F.col("lead") + step).alias("bid"))
            won = bids.groupBy("o").agg(F.max(F.struct("bid", "p")).alias("w")).select("o", F.col("w.bid").alias("bid"), F.col("w.p").alias("winner"))
            after = durable(state.join(won, "o", "left").select("o", F.coalesce("bid", "price").alias("price"), F.coalesce("winner", "owner").alias("owner")))
        release(state)
        release(free)
        state = after
    return state.where("owner.kind = 0 and o.kind = 0").select(F.col("owner.id").alias("c"), F.col("o.id").alias("t"))


#: Links of a connected group up to which one task settles it; larger groups go to the auction, which is as exact.
GROUP_LINKS = 1000
#: Confidences are compared to this precision.
PRECISION = 1_000_000_000


def one_to_one(candidates: DataFrame) -> DataFrame:
    """(c, t) of a one-to-one assignment with the greatest total confidence.

    Candidates (c, t, confidence), ids not negative, fall into connected groups, each
    settled exactly on its own: a link alone at both ends at once, a group of at most
    ``GROUP_LINKS`` links by the Hungarian method in a task, any other by :func:`auction`.
    """
    e = candidates.groupBy("c", "t").agg(F.round(F.max("confidence") * PRECISION).cast("bigint").alias("weight")).where("weight > 0")
    count = F.count(F.lit(1))
    e = durable(e.join(e.groupBy("c").agg(count.alias("dc")), "c").join(e.groupBy("t").agg(count.alias("dt")), "t"))
    single, tied = e.where("dc = 1 and dt = 1").select("c", "t"), e.where("dc > 1 or dt > 1").select("c", "t", "weight")
    # node numbers: c and t ids may clash, so t ids become negative
    groups = components(edges_of(tied.withColumn("n", -F.col("t") - 1), "c", "n"))
    tied = tied.join(groups.withColumnRenamed("node", "c"), "c")
    tied = durable(tied.join(tied.groupBy("group_id").agg(count.alias("links")), "group_id"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        cs, ts = sorted(group["c"].unique()), sorted(group["t"].unique())
        w = np.zeros((len(cs), len(ts)))
        w[np.searchsorted(cs, group["c"]), np.searchsorted(ts, group["t"])] = group["weight"]
        pairs = best_assignment(w)
        return pd.DataFrame({"c": [cs[a] for a, _ in pairs], "t": [ts[b] for _, b in pairs]}, dtype="int64")

    ship(candidates.sparkSession)
    settled = single.unionByName(tied.where(F.col("links") <= GROUP_LINKS).select("group_id", "c", "t", "weight").groupBy("group_id").applyInPandas(solve, "c bigint, t bigint"))
    return settled.unionByName(auction(tied.where(F.col("links") > GROUP_LINKS).select("c", "t", "weight")))


def confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(F.lit(STRONG + 1) - score))


def compared(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the records of the id pairs (x, y)."""
    record = lambda i, name: people.select(F.col("id").alias(i), F.struct(*people.columns).alias(name))
    return pairs.join(record("x", "a"), "x").join(record("y", "b"), "y").select("a", "b")


def source_persons(people: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, person): records of one source that are one person, as components of links inside the source.

    Linked are two records with a strong link, and a record with the best partner among
    those that share one of its partners in the other source, one by one and so never
    all pairs of a group: if the two agree well enough themselves.
    """
    inside = F.pmod("x", F.lit(2)) == F.pmod("y", F.lit(2))
    direct = scored.where(inside & (F.col("score") >= STRONG)).select("x", "y")
    ways = F.array(F.struct(F.col("x").alias("r"), F.col("y").alias("o")), F.struct(F.col("y").alias("r"), F.col("x").alias("o")))
    across = scored.where(~inside).select(F.inline(ways), "score")
    best = across.groupBy("r").agg(F.max(F.struct("score", -F.col("o"))).alias("m"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("m.score") >= STRONG))
    shared = across.join(best.select("r", (-F.col("m.col2")).alias("best")), "r").where("o <> best").select(F.least("o", "best").alias("x"), F.greatest("o", "best").alias("y"), "score")
    shared = durable(shared.groupBy("x", "y").agg(F.max("score").alias("by")).join(direct, ["x", "y"], "left_anti"))
    own = score_pairs(compared(people, shared).where(same_given()), SHARED).join(shared, ["x", "y"]).where((F.col("by") >= STRONG) | (F.col("score") >= WEAK))
    groups = components(edges_of(direct.unionByName(own.select("x", "y")), "x", "y"))
    return durable(people.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("group_id", "id").alias("person")))


def assigned(people: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, person), (c, t)): the persons of both sources, and which is which by the one-to-one assignment."""
    person = source_persons(people, scored)
    across = scored.where("pmod(x, 2) <> pmod(y, 2)").select(F.when(F.pmod("x", F.lit(2)) == 0, F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"))).alias("p"), "score").select("p.*", "score")
    of = lambda i, name: person.select(F.col("id").alias(i), F.col("person").alias(name))
    candidates = across.join(of("x", "c"), "x").join(of("y", "t"), "y").groupBy("c", "t").agg(F.max("score").alias("score"))
    return person, durable(one_to_one(candidates.select("c", "t", confidence(F.col("score")).alias("confidence"))))


def match_people(cohort: DataFrame, target: DataFrame, cohort_source: Source = COHORT, target_source: Source = TARGET, window: int = WINDOW) -> DataFrame:
    """(cohort_id, target_id, confidence): every pair of records that is one person.

    The confidence is that of the pair's own comparison, also where the pair is joined
    by other records of the two persons and its own is low.
    """
    both = normalised(cohort, cohort_source, "c").unionByName(normalised(target, target_source, "t"))
    # ids of the two sources may clash: even numbers for one, odd for the other
    with scratch():
        people = durable(both.withColumn("id", 2 * F.col("id") + F.when(F.col("side") == "t", 1).otherwise(0)))
        people = kept(durable(with_known_names(people)))
        scored = kept(durable(links(people, window)))
    with scratch():
        person, same = map(kept, assigned(people, scored))
    c = person.select(F.col("person").alias("c"), F.col("id").alias("i"))
    t = person.select(F.col("person").alias("t"), F.col("id").alias("j"))
    pairs = same.join(c, "c").join(t, "t").select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    pairs = durable(pairs.join(scored, ["x", "y"], "left"))
    rest = score_pairs(compared(people, pairs.where("score is null").select("x", "y")))
    own = pairs.where("score is not null").unionByName(rest)
    even = F.pmod("x", F.lit(2)) == 0
    ends = F.shiftright(F.when(even, F.col("x")).otherwise(F.col("y")), 1), F.shiftright(F.when(even, F.col("y")).otherwise(F.col("x")), 1)
    return own.select(ends[0].alias("cohort_id"), ends[1].alias("target_id"), F.round(confidence(F.col("score")), 6).alias("confidence"))
