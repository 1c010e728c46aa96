"""Mixing sources to target weights.

Token counts are summed per cell (source, language, set of topics).  Iterative
proportional fitting rakes one weight per cell so that, counted in tokens, sources have
their target shares and languages and topics keep the shares they have in the corpus, as
far as the caps allow; a message with several topics counts for each in equal parts.  A
weight is the expected number of uses of each message of the cell; messages are drawn by
systematic sampling in random order within cells and size classes, so a message is used
the whole number below or above its weight, which never exceeds its cap.

The size of the mix is the largest for which every source with tokens can hold its
share without breaking its cap, unless a size is asked for.  A target source without
tokens cannot be met; the shares of the others are raised in proportion, and the
report shows both the target and the share reached.

Defined results: messages without tokens (null or empty text), without a source or of
a source that is no target are not used; null language and no topic are cells of their
own; a repeated target counts once; with no usable target the mix is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .mail import sentences
from .subjects import LEAST_SENTENCES, SubjectModel
from .tokens import BPE_50K, pieces, token_counts, tokenizer, vocabulary

#: Rounds after which raking stops though weights still move; the report then shows what is left.
ROUNDS = 500
TOLERANCE = 1e-7
#: Rows that are put in order together when messages are drawn.
ROWS_PER_BUCKET = 50_000


@dataclass
class Raking:
    """Weights of the cells, rounds it took, and the largest difference of a marginal from what was wanted, as a share."""

    weights: np.ndarray
    rounds: int
    residual: float


def fit(size: np.ndarray, source: np.ndarray, others: list[np.ndarray], target: np.ndarray, cap: np.ndarray) -> Raking:
    """Raked weight of each cell.

    ``size``: tokens; ``source``: label number of the cell; ``others``: for each further
    marginal a matrix (cells x labels) whose rows add up to 1; ``target``: tokens wanted
    per source; ``cap``: highest weight per source.  Source totals are met exactly (the
    last step), other marginals as far as caps allow.
    """
    w = np.ones(len(size))
    limit = cap[source].astype(float)
    total = target.sum()
    wanted = [o.T @ size / size.sum() * total for o in others]

    def to_sources(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for s in range(len(target)):
            at = np.flatnonzero(source == s)
            if not len(at):
                continue
            # scale the cells of a source, those at the cap staying there, to its total
            order = at[np.argsort(-w[at] / limit[at], kind="stable")]
            full = 0.0
            rest = float((w[order] * size[order]).sum())
            for i, c in enumerate(order):
                scale = (target[s] - full) / rest if rest > 0 else 0.0
                if w[c] * scale <= limit[c] * (1 + 1e-12):
                    w[order[i:]] = np.minimum(w[order[i:]] * scale, limit[order[i:]])
                    break
                full += limit[c] * size[c]
                rest -= w[c] * size[c]
                w[c] = limit[c]
        return w

    w, rounds = to_sources(w), 0
    for rounds in range(1, ROUNDS + 1):  # noqa: B007
        before = w
        for o, t in zip(others, wanted):
            now = o.T @ (w * size)
            w = w * np.exp(o @ np.log(np.divide(t, now, out=np.ones_like(t), where=(now > 0) & (t > 0))))
            w = np.maximum(np.minimum(w, limit), 1e-12)
        w = to_sources(w)
        if np.abs(w - before).max() < TOLERANCE:
            break
    off = [np.abs(o.T @ (w * size) - t).max() / total for o, t in zip(others, wanted)]
    return Raking(w, rounds, float(max(off, default=0.0)))


def cell_weights(cells: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[DataFrame, Raking | None]:
    """(source, lang, topic, weight, buckets) from the token totals of all cells, and how the raking went.

    The cells are sources x languages x sets of topics, a bounded table.
    """
    spark = cells.sparkSession
    schema = "source string, lang string, topic string, weight double, buckets int"
    t = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").orderBy("target_share").collect()}
    rows = [r for r in cells.collect() if r["source"] in t and r["tokens"] > 0]
    if not rows:
        return spark.createDataFrame([], schema), None
    rows.sort(key=lambda r: (r["source"], r["lang"] or "", r["topic"] or "", r["lang"] is None, r["topic"] is None))
    names = sorted({r["source"] for r in rows})
    at = {s: i for i, s in enumerate(names)}
    source = np.array([at[r["source"]] for r in rows])
    size = np.array([float(r["tokens"]) for r in rows])
    share = np.array([t[s][0] for s in names])
    share = share / share.sum()
    cap = np.array([t[s][1] for s in names], dtype=float)
    most = (cap * np.bincount(source, size) / share).min()
    total = min(most, total_tokens) if total_tokens else most

    def marginal(labels: list[list]) -> np.ndarray:
        known = {v: i for i, v in enumerate(sorted({v for vs in labels for v in vs}, key=lambda v: (v is not None, v)))}
        m = np.zeros((len(labels), len(known)))
        for i, vs in enumerate(labels):
            for v in vs:
                m[i, known[v]] += 1 / len(vs)
        return m

    raked = fit(size, source, [marginal([[r["lang"]] for r in rows]), marginal([topics_of(r["topic"]) for r in rows])], share * total, cap)
    lines = [(r["source"], r["lang"], r["topic"], float(x), -(-r["n"] // ROWS_PER_BUCKET)) for r, x in zip(rows, raked.weights)]
    return spark.createDataFrame(lines, schema), raked


def topics_of(topic: str | None) -> list[str | None]:
    return topic.split("|") if topic else [None]


def sized(documents: DataFrame, model: SubjectModel | None = None, path: str = BPE_50K) -> DataFrame:
    """(doc_id, source, lang, tokens, topic) of every message: its size and its subjects in one pass over the text.

    ``topic`` joins the subjects by ``|``; it is null for a message without, and for all without a model.
    """
    if model is None:
        return token_counts(documents, ["doc_id", "source", "lang"], "text", path).withColumn("topic", F.lit(None).cast("string"))
    shared = ship(documents.sparkSession).sparkContext.broadcast((model.subjects, model.terms, model.h, model.known))
    ranks = vocabulary(documents.sparkSession, path)
    slim = documents.select("doc_id", "source", "lang", "text")
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))

    def run(batches):
        m, bpe = SubjectModel(*shared.value), tokenizer(ranks.value)
        for batch in pieces(batches, 3):
            texts = batch.column(3).to_pylist()
            treated = m.counts([sentences(t) for t in texts]) >= LEAST_SENTENCES
            topics = ["|".join(m.subjects[i] for i in np.flatnonzero(r)) or None for r in treated]
            tokens = [bpe.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.int64()), pa.array(topics, pa.string())], names=["doc_id", "source", "lang", "tokens", "topic"])

    return slim.mapInArrow(run, f"{kinds}, tokens bigint, topic string")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, tokens, uses): the messages used, with how often.

    Sampling runs over (cell, size class, bucket) groups of at most about
    ``ROWS_PER_BUCKET`` rows; only group totals pass a per-source running sum, so no task
    holds a source.
    """
    return drawn(sizes, targets, seed, total_tokens)[0].select("doc_id", "source", "tokens", "uses")


def drawn(sizes: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: float | None = None) -> tuple[DataFrame, Raking | None]:
    """The mix with the languages and topics of its messages, and how the raking went."""
    cells = sizes.where("source is not null and tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    weights, raked = cell_weights(cells, targets, total_tokens)
    safe = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    key = [F.col("source"), safe("lang").alias("l"), safe("topic").alias("t")]
    w = weights.select(*key, "weight", "buckets")
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = (
        sizes.where("source is not null and tokens > 0")
        .select("doc_id", "tokens", "lang", "topic", *key)
        .join(F.broadcast(w), ["source", "l", "t"])
        .withColumn("class", (4 * F.log2(F.col("tokens").cast("double"))).cast("int"))
        .withColumn("order", order)
        .withColumn("bucket", F.pmod(F.shiftright("order", 20), F.col("buckets")))
    )
    group = ["source", "l", "t", "class", "bucket"]
    totals = rows.groupBy(*group, "weight").agg((F.count(F.lit(1)) * F.col("weight")).alias("mass"))
    run = Window.partitionBy("source").orderBy("class", "l", "t", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*group, F.coalesce(F.sum("mass").over(run), F.lit(0.0)).alias("start"))
    within = Window.partitionBy(*group).orderBy("order", "doc_id")
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1000)) / 1000.0
    placed = rows.join(start, group).withColumn("k", F.row_number().over(within))
    mark = lambda k: F.floor(F.round(F.col("start") + offset + k * F.col("weight"), 7))
    return placed.withColumn("uses", (mark(F.col("k")) - mark(F.col("k") - 1)).cast("int")).where("uses > 0").select("doc_id", "source", "lang", "topic", "tokens", "uses"), raked


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, share reached, messages, uses, tokens and highest use."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    filled = targets.where("source is not null").dropDuplicates(["source"]).join(got, "source", "left").fillna(0, ["messages", "uses", "tokens", "most_uses"])
    whole = got.agg(F.sum("tokens").alias("whole"))
    return filled.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("whole"), 6), F.lit(0.0)).alias("reached_share"), "messages", "uses", "tokens", "most_uses", "max_repeats"
    )


def marginals(mixed: DataFrame, sizes: DataFrame, raked: Raking | None) -> DataFrame:
    """(marginal, label, wanted_share, reached_share, rounds, residual): languages and topics of the mix.

    Wanted are the shares of the usable corpus; ``residual`` is what raking left open at most,
    whatever the draw of whole messages then adds.  The label of none is null.
    """
    usable = sizes.where("source is not null and tokens > 0")
    if raked is None:
        usable = usable.limit(0)

    def shares(df: DataFrame, amount, out: str) -> DataFrame:
        topics = F.when(F.col("topic").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split("topic", "[|]"))
        entries = F.concat(F.array(F.struct(F.lit("lang").alias("marginal"), F.col("lang").alias("label"), F.lit(1.0).alias("part"))), F.transform(topics, lambda x: F.struct(F.lit("topic").alias("marginal"), x.alias("label"), (1.0 / F.size(topics)).alias("part"))))
        summed = df.select(amount.alias("amount"), F.inline(entries)).groupBy("marginal", "label").agg(F.sum(F.col("amount") * F.col("part")).alias("amount"))
        whole = summed.groupBy("marginal").agg(F.sum("amount").alias("whole"))
        return summed.join(F.broadcast(whole), "marginal").select("marginal", F.coalesce("label", F.lit("")).alias("key"), "label", (F.col("amount") / F.col("whole")).alias(out))

    wanted = shares(usable.join(F.broadcast(mixed.select("source").distinct()), "source", "left_semi"), F.col("tokens").cast("double"), "wanted_share")
    reached = shares(mixed, (F.col("tokens") * F.col("uses")).cast("double"), "reached_share").drop("label")
    return wanted.join(reached, ["marginal", "key"], "left").select(
        "marginal", "label", F.round("wanted_share", 6).alias("wanted_share"), F.round(F.coalesce("reached_share", F.lit(0.0)), 6).alias("reached_share"),
        F.lit(raked.rounds if raked else 0).alias("rounds"), F.lit(raked.residual if raked else 0.0).alias("residual"),
    )
