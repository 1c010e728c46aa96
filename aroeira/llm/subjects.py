"""Subject area of each document.

A document-term matrix (one row per sentence of new text, so that a message may mix
subjects) is factored by non-negative alternating updates under the Kullback-Leibler
objective.  Every subject of the list is one *anchored* component: its seed holds the
terms that stand out in messages labelled with it, and a sentence's mixture may only
use subjects its message was labelled with; multiplicative updates keep both zeros.
One further component holds the common language.

The components are fitted on a bounded sample of labelled messages (``FIT_MESSAGES``,
those of smallest hash).  Then they are held fixed, and the same multiplicative updates
give every sentence of the corpus its factor row, a batch of messages at a time: its
terms shared out between subjects and common language.  A sentence is on the subject
that explains most of its terms; a message treats the subjects that at least three of
its sentences are on.

Defined results: a null, empty or blank message has no subjects; labels of unknown
messages, unknown subjects, null labels and repeated labels are harmless; without any
usable label nothing is assigned.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .mail import sentences

#: Bound of the sample of labelled messages the factorization is fitted on.
FIT_MESSAGES = 8000
ROUNDS = 20
SUBJECT_SHARE = 0.3
#: The anchored components keep at least this share of a sentence of a labelled message.
ANCHOR_SHARE = 0.3
#: A term seeds a subject if at least this share of its sentences may be on the subject ...
SEED_SHARE = 0.3
#: ... and that is so many standard deviations above the share that common language may reach:
#: this one, or 1.3 times the subject's share of all sentences if that is more.
SEED_CHANCE = 0.2
SEED_SURPLUS = 2.5
#: A term has a row in the model if a subject's component holds it at least so many times as the common one.
LEAST_LIFT = 1.2
#: Rounds of updates that share a sentence's terms out between fixed components.
APPLY_ROUNDS = 4
#: A term of the common language alone counts this much against a term of a subject.
COMMON_WEIGHT = 0.2
#: Terms that a message's sentences on a subject lend, on a logarithmic scale, to its other sentences.
MESSAGE_PRIOR = 0.6
#: A sentence is on the subject that explains most of its terms, if it explains so many.
LEAST_TERMS = 0.8
LEAST_SENTENCES = 3
REMEMBERED_TERMS = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_FOLD = str.maketrans("áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")


class _Folded(dict):
    """Words without accents, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED_TERMS:
            self.clear()
        self[word] = folded = word.translate(_FOLD)
        return folded


_FOLDED = _Folded()


def terms(sentence: str) -> list[str]:
    """Words without case and accents, and pairs of neighbours, each once."""
    words = list(map(_FOLDED.__getitem__, _WORD.findall(sentence.lower())))
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _without_one(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


@dataclass
class SubjectModel:
    """The fitted components: ``terms`` numbers the rows of ``h``, one column per subject and the common language last.

    Only terms that some subject lifts above the common language have a row; every other
    term, known or not, speaks for the common language alone.
    """

    subjects: list[str]
    terms: dict[str, int]
    h: np.ndarray
    known: set[str]
    near: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lift = self.h[:, :-1].max(axis=1, initial=0.0) / np.maximum(self.h[:, -1], 1e-12) if len(self.h) else np.zeros(0)
        for w in sorted(self.terms):
            if " " not in w and len(w) >= 5 and lift[self.terms[w]] > 20:
                for v in (w, *_without_one(w)):
                    self.near.setdefault(v, self.terms[w])
        self._rows: dict[str, int] = {}

    def _row(self, word: str) -> int:
        """The row of a term, of the word it misspells, or -1; remembered."""
        row = self.terms.get(word, -1)
        if row < 0 and " " not in word and len(word) >= 5 and word not in self.known:
            row = next((self.near[v] for v in (word, *_without_one(word)) if v in self.near), -1)
        if len(self._rows) >= REMEMBERED_TERMS:
            self._rows.clear()
        self._rows[word] = row
        return row

    def mixtures(self, sentences_: list[str], message: np.ndarray) -> np.ndarray:
        """The factor row of every sentence with ``h`` held fixed: its terms shared out between the components.

        Multiplicative updates under the Kullback-Leibler objective, twice: once for the
        sentence alone and once with the mixture of its ``message`` (a number per
        sentence) as prior, so that a word that fits two subjects follows its message.
        """
        n, k = len(sentences_), len(self.subjects)
        i, j, common = [], [], np.zeros(n)
        get = self._rows.get
        for s, text in enumerate(sentences_):
            for t in terms(text):
                row = get(t)
                if row is None:
                    row = self._row(t)
                if row < 0:
                    common[s] += 1
                else:
                    i.append(s)
                    j.append(row)
        if not i:
            return np.zeros((n, k))
        i, hj = np.array(i), self.h[np.array(j)]
        starts = np.searchsorted(i, np.arange(n))
        empty = np.bincount(i, minlength=n) == 0
        total = np.bincount(i, minlength=n) + common * COMMON_WEIGHT
        prior = np.zeros((n, k + 1))
        for _ in range(2):
            weight = (total + prior.sum(axis=1))[:, None]
            share = np.full((n, k + 1), SUBJECT_SHARE / k)
            share[:, k] = 1 - SUBJECT_SHARE
            for _ in range(APPLY_ROUNDS):
                part = share[i] * hj
                part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
                got = np.add.reduceat(part, np.minimum(starts, len(i) - 1), axis=0)
                got[empty] = 0
                out = got + prior
                out[:, k] += common * COMMON_WEIGHT
                share = out / np.maximum(weight, 1e-12)
            per_message = np.zeros((message.max() + 1, k))
            np.add.at(per_message, message, (got[:, :k] >= LEAST_TERMS).astype(float))
            prior[:, :k] = MESSAGE_PRIOR * np.log1p(per_message)[message]
        return got[:, :k]

    def subject_of(self, texts: list[str], message: np.ndarray | None = None) -> np.ndarray:
        """Number of each sentence's subject, or -1."""
        if not len(texts):
            return np.zeros(0, dtype=int)
        got = self.mixtures(texts, np.zeros(len(texts), dtype=int) if message is None else message)
        best = got.argmax(axis=1)
        return np.where(got[np.arange(len(best)), best] >= LEAST_TERMS, best, -1)

    def counts(self, messages: list[list[str]]) -> np.ndarray:
        """(messages x subjects): how many sentences of each message are on each subject."""
        out = np.zeros((len(messages), len(self.subjects)), dtype=int)
        message = np.repeat(np.arange(len(messages)), [len(m) for m in messages])
        subject = self.subject_of([s for m in messages for s in m], message)
        np.add.at(out, (message[subject >= 0], subject[subject >= 0]), 1)
        return out


def fit(messages: list[tuple[list[str], set[str]]], subjects: list[str]) -> SubjectModel:
    """Seeded non-negative factorization of the labelled messages' sentences.

    ``messages``: (sentences, labels); labels outside ``subjects`` mean none of them.
    """
    rows: list[list[str]] = []
    allowed: list[set[int]] = []
    at = {s: i for i, s in enumerate(subjects)}
    used: Counter[str] = Counter()
    for ss, labels in messages:
        ks = {at[x] for x in labels if x in at}
        seen: set[str] = set()
        for s in ss:
            t = terms(s)
            if t:
                rows.append(t)
                allowed.append(ks)
                seen.update(t)
        used.update(seen)
    vocabulary = {t: j for j, t in enumerate(sorted(t for t, n in used.items() if n >= 2))}
    k, v, n = len(subjects), len(vocabulary), len(rows)
    if not v:
        return SubjectModel(subjects, {}, np.zeros((0, k + 1)), set())
    inside = [[vocabulary[t] for t in ts if t in vocabulary] for ts in rows]
    i = np.repeat(np.arange(n), [len(x) for x in inside])
    j = np.fromiter((c for x in inside for c in x), dtype=np.int64, count=len(i))
    del inside, rows
    mask = np.zeros((n, k + 1))
    for r, ks in enumerate(allowed):
        mask[r, list(ks)] = 1.0
    mask[:, k] = 1.0

    # seeds: terms that stand out among sentences of messages labelled with a subject
    total = np.bincount(j, minlength=v).astype(float)
    h = np.zeros((k + 1, v))
    for s in range(k):
        own = np.bincount(j[mask[i, s] > 0], minlength=v).astype(float)
        chance = min(max(SEED_CHANCE, 1.3 * own.sum() / max(total.sum(), 1.0)), 0.9)
        surplus = (own - chance * total) / np.sqrt(np.maximum(chance * (1 - chance) * total, 1e-12))
        h[s] = np.where((own >= max(SEED_SHARE, chance) * total) & (surplus >= SEED_SURPLUS), own - chance * total, 0.0)
    h[k] = total
    h /= np.maximum(h.sum(axis=1, keepdims=True), 1e-12)
    w = mask / mask.sum(axis=1, keepdims=True)

    order = np.argsort(j, kind="stable")
    i2, starts = i[order], np.searchsorted(j[order], np.arange(v))
    row_starts = np.searchsorted(i, np.arange(n))
    empty_rows = np.bincount(i, minlength=n) == 0

    def per_row(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(x, np.minimum(row_starts, len(x) - 1), axis=0)
        out[empty_rows] = 0
        return out

    for _ in range(ROUNDS):
        hj = h.T[j]
        q = 1.0 / np.maximum((w[i] * hj).sum(axis=1), 1e-12)
        w = w * per_row(hj * q[:, None])
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        anchored = w[:, :k].sum(axis=1)
        lifted = np.where((anchored > 0) & (anchored < ANCHOR_SHARE), ANCHOR_SHARE / np.maximum(anchored, 1e-12), 1.0)
        w[:, :k] *= lifted[:, None]
        w[:, k] = np.where(mask[:, :k].any(axis=1), np.minimum(w[:, k], 1 - ANCHOR_SHARE), w[:, k])
        q = 1.0 / np.maximum((w[i] * hj).sum(axis=1), 1e-12)
        h = h * np.add.reduceat(w[i2] * q[order][:, None], starts, axis=0).T
        h /= np.maximum(h.sum(axis=1, keepdims=True), 1e-12)

    h[k] += 0.5 / max(total.sum(), 1.0)
    lifted = np.flatnonzero(h[:k].max(axis=0) > LEAST_LIFT * h[k])
    row = {int(c): r for r, c in enumerate(lifted)}
    return SubjectModel(subjects, {t: row[c] for t, c in vocabulary.items() if c in row}, np.ascontiguousarray(h[:, lifted].T), set(vocabulary))


def labelled_messages(documents: DataFrame, labels: DataFrame, limit: int = FIT_MESSAGES) -> list[tuple[list[str], set[str]]]:
    """The bounded sample for the fit: sentences and cleaned labels of ``limit`` messages.

    A label counts if at least half of the message's annotators gave it.
    """
    clean = labels.where("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject"), F.coalesce("annotator", F.lit("")).alias("annotator")).distinct()
    votes = clean.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    voters = clean.groupBy("doc_id").agg(F.countDistinct("annotator").alias("voters"))
    per = votes.join(voters, "doc_id").where("2 * n >= voters").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    sample = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for batch in batches:
            split = [sentences(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(split, pa.list_(pa.string()))], names=["doc_id", "labels", "sentences"])

    ship(documents.sparkSession)
    text = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "labels")
    rows = text.mapInArrow(run, "doc_id bigint, labels array<string>, sentences array<string>").toArrow()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "sentences", "labels"))))
    return [(s, set(x)) for _, s, x in got]


def assign(documents: DataFrame, model: SubjectModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject): the subjects each message treats in three sentences or more."""
    shared = ship(documents.sparkSession).sparkContext.broadcast((model.subjects, model.terms, model.h, model.known))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        m = SubjectModel(*shared.value)
        names = pa.array(m.subjects, pa.string())
        for batch in batches:
            n = m.counts([sentences(t) for t in batch.column(1).to_pylist()])
            rows, on = np.nonzero(n >= LEAST_SENTENCES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(on))], names=[key, "subject"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, subject string")


def fitted(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> SubjectModel:
    """The model of the subjects of ``areas``, from the labelled messages."""
    names = sorted({r["subject"].strip().lower() for r in areas.where("subject is not null").select("subject").distinct().collect()})
    return fit(labelled_messages(documents, labels), names)


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject) for the whole corpus: fit on labelled messages, apply to all."""
    return assign(documents, fitted(documents, labels, areas))
