"""Schemas that drift between files.

The field list of every file has a fingerprint that does not depend on its order.  Along
a series a file whose fingerprint differs from that of the file before it starts a new
version, and the differences are explicit migration steps: added, removed, renamed,
retyped, each with both fingerprints.  A rename is told from a removal and an addition by
*content*: the values of both fields, as the raw records show them, must have the same
profile, and the two names must not stand side by side in the corpus.

Raw records are routed file by file.  The steps of a series, chained, give each field its
line of descent; lines of different series that share a name fall into one column, unless
that would put two fields of one file into it.  A value then passes the rename to its
column, the default (null) where the file lacks the field, and the cast from the file's
own letter to the column's; what has no place in a column is kept beside.

Defined results: a file whose latest list is null is passed over and the next file
is compared with the last one that has a list; blank field names are dropped; of two
deliveries with the same time the one with the larger list text counts; payloads that
are not JSON objects contribute nothing to profiles and come out with null fields.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, ship
from .quality import with_previous

#: Levels of a value profile: its shape, and its first 1, 2 and 4 characters.
LEVELS = (0, 1, 2, 4)
WEIGHTS = (2.0, 1.0, 1.0, 1.0)
LEAST_SIMILARITY = 0.77
#: How many values of a series weigh as much as the whole corpus when two names are compared.
CORPUS_VALUES = 2.0


def canonical_file(c: Column) -> Column:
    """``./data/n1/ABCD2301.DBC `` and ``n1/ABCD2301.dbc`` name the same file."""
    m = r"(?i)([^/\s]+)/([A-Z]{4}[0-9]{4})\.dbc\s*\z"
    return F.when(c.rlike(m), F.concat(F.lower(F.regexp_extract(c, m, 1)), F.lit("/"), F.upper(F.regexp_extract(c, m, 2)), F.lit(".dbc"))).otherwise(F.trim(c))


def current_lists(metadata: DataFrame) -> DataFrame:
    """(file, names, kinds, fields, fingerprint): the latest list of each file as a map name -> type letter."""
    order = F.struct(F.col("loaded_at"), F.to_json("fields").alias("text"))
    latest = metadata.where(F.col("file").isNotNull()).groupBy(canonical_file(F.col("file")).alias("file")).agg(F.max_by(F.struct("fields"), order).alias("l"))
    clean = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform("l.fields", lambda x: F.struct(F.upper(F.trim(x["name"])).alias("name"), F.upper(F.trim(x["type"])).alias("kind"))),
                lambda x: x["name"] != "",
            )
        )
    )
    listed = latest.where("l.fields is not null").select("file", clean.alias("f"))
    # a name listed twice counts once, with the first of its letters
    firsts = F.filter("f", lambda x, i: (i == 0) | (F.get(F.col("f"), i - 1)["name"] != x["name"]))
    named = listed.select("file", F.map_from_entries(firsts).alias("kinds")).select("file", F.map_keys("kinds").alias("names"), "kinds")
    text = F.array_join(F.transform("names", lambda n: F.concat(n, F.lit(":"), F.coalesce(F.element_at("kinds", n), F.lit("")))), ",")
    return named.withColumn("fields", text).withColumn("fingerprint", F.sha2("fields", 256))


def versions(lists: DataFrame) -> DataFrame:
    """(fingerprint, fields, files, first_file, last_file): each distinct schema once."""
    return lists.groupBy("fingerprint", "fields").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


def transitions(lists: DataFrame) -> DataFrame:
    """(series, file, from/to fingerprint, gone, come, …) of each file whose fingerprint is not that of the file before it."""
    order = with_previous(lists.select("file"), "file").where("prev is not null")
    before = lists.select(F.col("file").alias("prev"), F.col("names").alias("p_names"), F.col("kinds").alias("p_kinds"), F.col("fingerprint").alias("from_fingerprint"))
    return order.join(lists.withColumnRenamed("fingerprint", "to_fingerprint"), "file").join(before, "prev").where("from_fingerprint <> to_fingerprint").select(
        "series", "file", "from_fingerprint", "to_fingerprint", "names", "p_names", "kinds", "p_kinds",
        F.array_except("p_names", "names").alias("gone"), F.array_except("names", "p_names").alias("come"),
    )


def payload_values(raw: DataFrame) -> DataFrame:
    """(file, line_no, name, value): every field of every readable raw record once."""
    parsed = F.from_json("payload", "map<string,string>")
    return (
        raw.where(F.col("file").isNotNull())
        .select(canonical_file(F.col("file")).alias("file"), "line_no", "payload")
        .dropDuplicates()
        .select("file", "line_no", F.explode(parsed).alias("name", "value"))
        .select("file", "line_no", F.upper(F.trim("name")).alias("name"), "value")
    )


def profile_feature(value: Column, level: int) -> Column:
    """What ``level`` of a profile sees of a value; writing styles are levelled first."""
    v = F.upper(value)
    v = F.when(v == "TRUE", "T").when(v == "FALSE", "F").otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, r"[^A-Z0-9.:]", ""), r"\A0+(?=[A-Z0-9])", "")
    if level == 0:
        return F.translate(v, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "A" * 26)
    return F.substring(v, 1, level)


def feature_counts(values: DataFrame, scope: str) -> DataFrame:
    """(scope, name, level, feature, c): how often each name's values show a feature.

    Equal values are counted before their features are made.
    """
    counted = values.where("trim(value) != ''").groupBy(scope, "name", "value").agg(F.count(F.lit(1)).alias("c"))
    features = F.array(*(F.struct(F.lit(i).alias("level"), profile_feature(F.col("value"), k).alias("feature")) for i, k in enumerate(LEVELS)))
    return counted.select(scope, "name", "c", F.explode(features).alias("f")).groupBy(scope, "name", "f.level", "f.feature").agg(F.sum("c").alias("c"))


def profiles(counts: DataFrame, scope: str) -> DataFrame:
    """(scope, name, level, feature, share, n, k): shares, number of values and of features."""
    w = Window.partitionBy(scope, "name", "level")
    return counts.withColumn("n", F.sum("c").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("share", F.col("c") / F.col("n"))


def similarity(pairs: DataFrame, prof: DataFrame, scope: str, out: str) -> DataFrame:
    """Profile similarity of distinct (scope, a, b): weighted mean over the levels of the Bhattacharyya
    coefficient, raised by the amount two samples of these sizes fall short of 1 by chance
    (at most 0.25), with ``least``, the smaller of the two numbers of values."""
    pa = prof.select(scope, F.col("name").alias("a"), "level", "feature", F.col("share").alias("sa"))
    pb = prof.select(scope, F.col("name").alias("b"), "level", "feature", F.col("share").alias("sb"))
    size = prof.groupBy(scope, "name", "level").agg(F.max("n").alias("n"), F.max("k").alias("k"))
    na = size.select(scope, F.col("name").alias("a"), "level", F.col("n").alias("na"), F.col("k").alias("ka"))
    nb = size.select(scope, F.col("name").alias("b"), "level", F.col("n").alias("nb"), F.col("k").alias("kb"))
    common = (
        pairs.join(pa, [scope, "a"]).join(pb, [scope, "b", "level", "feature"])
        .groupBy(scope, "a", "b", "level").agg(F.sum(F.sqrt(F.col("sa") * F.col("sb"))).alias("bc"), F.count(F.lit(1)).alias("kc"))
    )
    chance = F.least(F.lit(0.25), (F.col("ka") + F.col("kb") - F.coalesce("kc", F.lit(0)) - 1) / 8 * (1 / F.col("na") + 1 / F.col("nb")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("level") + 1)
    level = F.least(F.lit(1.0), F.coalesce("bc", F.lit(0.0)) + chance)
    return (
        pairs.join(na, [scope, "a"]).join(nb, [scope, "b", "level"]).join(common, [scope, "a", "b", "level"], "left")
        .groupBy(scope, "a", "b").agg((F.sum(level * weight) / F.sum(weight)).alias(out), F.min(F.least("na", "nb")).alias(f"{out}_least"))
    )


def side_by_side(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of ``pairs`` that stand together in some list."""
    schemas = lists.select("names").distinct().select(F.xxhash64("names").alias("s"), F.explode("names").alias("name"))
    a = pairs.join(schemas.withColumnRenamed("name", "a"), "a")
    return a.join(schemas.withColumnRenamed("name", "b"), ["s", "b"]).select("a", "b").distinct()


def renames(lists: DataFrame, diff: DataFrame, raw: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(file, a, b): field ``a`` of the file before is field ``b`` of this file.

    Two profiles are compared within the series and over the whole corpus.  The series'
    agreement counts by the number of its values against ``CORPUS_VALUES`` values' worth
    of the corpus' agreement, and never lowers it.  Within a file each name takes part in
    one rename at most; the most similar pairs are taken first.
    """
    pairs = diff.where((F.size("gone") > 0) & (F.size("come") > 0)).select("series", "file", F.explode("gone").alias("a"), "come").select("series", "file", "a", F.explode("come").alias("b"))
    kinds = pairs.select("a", "b").distinct()
    apart = kinds.join(side_by_side(lists, kinds), ["a", "b"], "left_anti")
    pairs = durable(pairs.join(apart, ["a", "b"]))
    series = with_previous(lists.select("file"), "file").select("file", "series")
    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    values = payload_values(raw).join(named, "name").join(series, "file").select("series", "name", "value")
    counts = durable(feature_counts(values, "series"))
    local = similarity(pairs.select("series", "a", "b").distinct(), profiles(counts, "series"), "series", "near")
    summed = counts.groupBy(F.lit(1).alias("all"), "name", "level", "feature").agg(F.sum("c").alias("c"))
    world = similarity(pairs.select(F.lit(1).alias("all"), "a", "b").distinct(), profiles(summed, "all"), "all", "far").drop("all")
    n = F.col("near_least")
    score = F.coalesce(F.greatest(F.col("far"), (n * F.col("near") + CORPUS_VALUES * F.col("far")) / (n + CORPUS_VALUES)), F.col("near"))
    alike = F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    scored = (
        pairs.join(local, ["series", "a", "b"], "left").join(world, ["a", "b"], "left")
        .withColumn("score", score).where(F.col("score") >= least).select("file", "a", "b", (F.col("score") - F.lit(0.02) * alike).alias("score"))
    )
    ranked = scored.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("score", "a", "b")), asc=False).alias("c"))
    chosen = F.aggregate(
        "c",
        F.expr("cast(array() as array<struct<score:double,a:string,b:string>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ranked.select("file", F.explode(chosen).alias("r")).select("file", "r.a", "r.b")


def steps(lists: DataFrame, raw: DataFrame) -> DataFrame:
    """(series, file, from_fingerprint, to_fingerprint, change_kind, old_name, new_name): every migration step."""
    diff = transitions(lists)
    moved = renames(lists, diff, raw).groupBy("file").agg(F.collect_list(F.struct("a", "b")).alias("moved"))
    d = diff.join(moved, "file", "left").withColumn("moved", F.coalesce("moved", F.expr("cast(array() as array<struct<a:string,b:string>>)")))

    def row(kind: str, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), old.alias("old_name"), new.alias("new_name"))

    differs = lambda a, b: ~F.element_at("p_kinds", a).eqNullSafe(F.element_at("kinds", b))
    rows = F.concat(
        F.transform(F.array_except("come", F.transform("moved", lambda m: m["b"])), lambda n: row("added", F.lit(""), n)),
        F.transform(F.array_except("gone", F.transform("moved", lambda m: m["a"])), lambda n: row("removed", n, F.lit(""))),
        F.transform("moved", lambda m: row("renamed", m["a"], m["b"])),
        F.transform(F.filter("moved", lambda m: differs(m["a"], m["b"])), lambda m: row("retyped", m["a"], m["b"])),
        F.transform(F.filter(F.array_intersect("names", "p_names"), lambda n: differs(n, n)), lambda n: row("retyped", n, n)),
    )
    return d.select("series", "file", "from_fingerprint", "to_fingerprint", F.inline(rows))


def changes(metadata: DataFrame, raw: DataFrame) -> DataFrame:
    """(file, change_kind, old_name, new_name): every change of a file against the file before it."""
    lists = durable(current_lists(metadata))  # one row per file, read by every later step
    return steps(lists, raw).select("file", "change_kind", "old_name", "new_name")


def lines_of_descent(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(file, name, line): the field that a name stands for in a file, followed through the renames of its series.

    A series has at most one file a month of its four digits, so it fits one task.
    """
    moved = found.where("change_kind = 'renamed'").groupBy("file").agg(F.collect_list(F.struct("new_name", "old_name")).alias("moved"))
    order = with_previous(lists.select("file"), "file").select("file", "series", "yymm")
    whole = lists.select("file", "names").join(order, "file", "left").join(moved, "file", "left").withColumn("series", F.coalesce("series", "file"))

    def walk(files: pd.DataFrame) -> pd.DataFrame:
        out, now, made = [], {}, 0
        for f in files.sort_values(["yymm", "file"]).itertuples():
            came_from = {} if f.moved is None else {m["new_name"]: m["old_name"] for m in f.moved}
            after = {}
            for n in f.names:
                line = now.get(came_from.get(n, n))
                if line is None:
                    line, made = f"{f.series}#{made}", made + 1
                after[n] = line
                out.append((f.file, n, line))
            now = after
        return pd.DataFrame(out, columns=["file", "name", "line"])

    ship(lists.sparkSession)
    return whole.select("series", "yymm", "file", "names", "moved").groupBy("series").applyInPandas(walk, "file string, name string, line string")


def columns_of(uses: dict[tuple[str, ...], dict[str, int]], together: set[frozenset]) -> dict[tuple[str, ...], str]:
    """The column of each kind of line.  A kind is the set of names its lines go by, with ``uses``, the files of each name.

    Kinds that share a name become one column, those with most files and fewest other
    names first, unless kinds of both sides stand ``together`` in a file.  A column is called by the name most files
    use; of two columns with the same first name the smaller takes its next.
    """
    group = {k: k for k in uses}
    members = {k: [k] for k in uses}
    by_name: dict[str, list] = {}
    for k in uses:
        for n in k:
            by_name.setdefault(n, []).append(k)
    pairs = {(a, b) for ks in by_name.values() for a in ks for b in ks if a < b}
    strength = {(a, b): sum(min(uses[a].get(n, 0), uses[b].get(n, 0)) for n in set(a) & set(b)) / len(set(a) | set(b)) for a, b in pairs}
    for a, b in sorted(pairs, key=lambda p: (-strength[p], p)):
        x, y = group[a], group[b]
        if x != y and not any(frozenset((i, j)) in together for i in members[x] for j in members[y]):
            for k in members[y]:
                group[k] = x
            members[x] += members.pop(y)
    total = {g: {n: sum(uses[k].get(n, 0) for k in ks) for n in {n for k in ks for n in k}} for g, ks in members.items()}
    names: dict[tuple[str, ...], str] = {}
    for g in sorted(members, key=lambda g: (-sum(total[g].values()), g)):
        wished = sorted(total[g], key=lambda n: (-total[g][n], n))
        free = [n for n in wished if n not in names.values()]
        names[g] = free[0] if free else next(x for i in range(2, len(names) + 3) if (x := f"{wished[0]}_{i}") not in names.values())
    return {k: names[g] for k, g in group.items()}


def routes(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """((file, name, column), name -> column of a file without a list).

    The driver sees the distinct kinds of lines and which of them stand in one file: the
    vocabulary of field names and its variants, which does not grow with the files.
    """
    lines = durable(lines_of_descent(lists, found))
    kinds = lines.groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("kind"))
    lines = durable(lines.join(kinds, "line").select("file", "name", "kind"))
    uses: dict[tuple[str, ...], dict[str, int]] = {}
    for r in lines.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("files")).collect():
        uses.setdefault(tuple(r["kind"].split("\n")), {})[r["name"]] = r["files"]
    met = lines.groupBy("file").agg(F.array_sort(F.collect_list("kind")).alias("kinds")).select("kinds").distinct().collect()
    together = set()
    for r in met:
        ks = [tuple(k.split("\n")) for k in r["kinds"]]
        together |= {frozenset((a, b)) for i, a in enumerate(ks) for b in ks[i + 1 :]}
    column = columns_of(uses, together)
    most: dict[str, tuple[int, str]] = {}
    for k, files in uses.items():
        for n, f in files.items():
            most[n] = max(most.get(n, (0, "")), (f, column[k]))
    of = lookup({"\n".join(k): c for k, c in column.items()}, F.col("kind"))
    return lines.select("file", "name", of.alias("column")), {n: c for n, (_, c) in most.items()}


def lookup(entries: dict, key: Column, kind: str = "string") -> Column:
    """What a small dictionary of the driver has for ``key``, else null."""
    known = [F.lit(x) for k, v in entries.items() if v is not None for x in (k, v)]
    return F.element_at(F.create_map(*known), key) if known else F.lit(None).cast(kind)


def code_widths(raw: DataFrame, own: DataFrame, least: float = 0.9) -> dict[str, int]:
    """Width of the columns whose values in files that call them text are digits of one length.

    A number has no leading zeros, so a code retyped to N gets them back from this.
    """
    lengths = (
        payload_values(raw).where(F.trim("value").rlike(r"\A[0-9]+\z")).join(own.where("kind = 'C'").select("file", "name", "column"), ["file", "name"])
        .groupBy("column", F.length(F.trim("value")).alias("width")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column").agg(F.max_by("width", "n").alias("width"), (F.max("n") / F.sum("n")).alias("share"))
    )
    return {r["column"]: r["width"] for r in lengths.where(F.col("share") >= least).collect()}


def plain(value: Column, own: Column, kind: Column, width: Column) -> Column:
    """``value`` of a file with letter ``own`` as text that the cast of letter ``kind`` takes; null where it fits none.

    N: a decimal point or comma (points may then group thousands).  D: yyyy-MM-dd,
    yyyyMMdd or dd/MM/yyyy.  L: what Spark reads as a boolean.  Text: a code
    that the file calls a number, or of which no letter is known, gets its leading
    zeros back, a logical value its letter.
    """
    number = F.when(value.rlike(r"\A[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?\z"), value).when(
        value.rlike(r"\A[-+]?([0-9]{1,3}([.][0-9]{3})+|[0-9]*),[0-9]+\z"), F.translate(value, ",.", ".")
    )
    form = F.when(value.rlike(r"\A[0-9]{8}\z"), "yyyyMMdd").when(value.rlike(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), "dd/MM/yyyy")
    form = form.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "yyyy-MM-dd")
    day = F.coalesce(*(F.when(form == f, F.try_to_timestamp(value, F.lit(f))) for f in ("yyyyMMdd", "dd/MM/yyyy", "yyyy-MM-dd"))).cast("date").cast("string")
    code = F.when((own.isNull() | (own == "N")) & value.rlike(r"\A[0-9]+\z") & (F.length(value) < width), F.lpad(value, width, "0"))
    code = code.when((own == "L") & value.try_cast("boolean").isNotNull(), F.when(value.try_cast("boolean"), "T").otherwise("F"))
    return F.when(kind == "N", number).when(kind == "D", day).when(kind == "L", F.when(value.try_cast("boolean").isNotNull(), value)).otherwise(F.coalesce(code, value))


def consistent(raw: DataFrame, metadata: DataFrame) -> DataFrame:
    """All raw records in one table: (file, line_no, readable, one column per field, rejects).

    Each file's fields pass the chained rename steps of its series to their column,
    default to null where the file lacks them, and are cast from the file's own letter to
    the letter most files give the column: N double, D date, L boolean, otherwise trimmed text.
    ``rejects`` keeps as (name, value) what has no place in a column: values that fit
    no cast, fields in no list, a second field of the same column, and the whole of
    an unreadable payload (its name is empty).
    """
    lists = durable(current_lists(metadata))
    route, default_of = routes(lists, durable(steps(lists, raw)))
    own = durable(lists.select("file", F.explode("kinds").alias("name", "kind")).join(route, ["file", "name"]))
    letter = own.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind")).orderBy("column").collect()
    kind_of = {r["column"]: r["kind"] for r in letter}
    width_of = code_widths(raw, own)
    rules = own.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("column", "kind")))).alias("rules"))

    lines = raw.select(canonical_file(F.col("file")).alias("file"), "line_no", "payload").dropDuplicates().withColumn("m", F.from_json("payload", "map<string,string>"))
    lines = lines.join(rules, "file", "left")

    # one step after the other, so that nothing is worked out twice
    there = F.filter(F.map_entries("m"), lambda e: F.trim(e["value"]) != "")
    named = F.transform(there, lambda e: F.struct(F.upper(F.trim(e["key"])).alias("name"), F.trim(e["value"]).alias("value")))
    listed = F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), F.element_at("rules", x["name"]).alias("rule")))
    # a file without a list, or a field its list lacks, goes by what most files mean
    placed = F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["rule"]["kind"].alias("own"), x["rule"].isNull().alias("other"), F.coalesce(x["rule"]["column"], lookup(default_of, x["name"])).alias("column")))
    typed = F.transform(placed, lambda x: F.struct(*(x[c].alias(c) for c in ("name", "value", "own", "other", "column")), lookup(kind_of, x["column"]).alias("kind"), lookup(width_of, x["column"], "int").alias("width")))
    cast = F.transform(typed, lambda x: F.struct(*(x[c].alias(c) for c in ("name", "value", "other", "column")), F.when(x["column"].isNotNull(), plain(x["value"], x["own"], x["kind"], x["width"])).alias("fits")))
    field = F.transform(cast, lambda x: F.struct(x["column"].alias("column"), x["fits"].isNull().alias("out"), *(x[c].alias(c) for c in ("other", "name", "fits", "value"))))
    fields = lines.select("file", "line_no", "payload", F.col("m").isNotNull().alias("readable"), F.array_sort(field).alias("fields"))
    # sorted by column, what fits first: the first of each column is its value
    second = F.transform("fields", lambda e, i: F.struct(e.alias("e"), (e["out"] | ((i > 0) & F.get(F.col("fields"), i - 1)["column"].eqNullSafe(e["column"]))).alias("left")))
    split = fields.select("file", "line_no", "payload", "readable", second.alias("s"))
    reject = F.transform(F.filter("s", lambda x: x["left"]), lambda x: F.struct(x["e"]["name"].alias("name"), x["e"]["value"].alias("value")))
    whole = F.array(F.struct(F.lit("").alias("name"), F.col("payload").alias("value")))
    rejects = F.when(~F.col("readable") & (F.trim("payload") != ""), whole).otherwise(F.coalesce(reject, F.expr("cast(array() as array<struct<name:string,value:string>>)")))
    taken = F.map_from_entries(F.transform(F.filter("s", lambda x: ~x["left"]), lambda x: F.struct(x["e"]["column"], x["e"]["fits"])))
    out = split.select("file", "line_no", "readable", taken.alias("taken"), rejects.alias("rejects"))
    types = {"N": "double", "D": "date", "L": "boolean"}
    columns = (F.element_at("taken", r["column"]).cast(types.get(r["kind"], "string")).alias(r["column"]) for r in letter)
    return out.select("file", "line_no", "readable", *columns, "rejects")


def kept_values(table: DataFrame) -> DataFrame:
    """(file, records, kept_values): how many records and values of each file are in the consistent table, rejects included."""
    fields = [c for c in table.columns if c not in ("file", "line_no", "readable", "rejects")]
    filled = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in fields), F.size("rejects"))
    return table.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum(filled).cast("bigint").alias("kept_values"))
