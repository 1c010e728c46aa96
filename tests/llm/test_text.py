"""New text of messages, and subjects on small corpora."""

import base64
import random

import numpy as np

from aroeira.llm import mail, subjects

PLAIN = "From: a\nContent-Type: text/plain; charset=utf-8\n\n"


def test_parts_and_encodings():
    inner = "Olá mundo. Três coisas."
    b64 = base64.b64encode(inner.encode()).decode()
    for raw in (
        PLAIN + inner,
        (PLAIN + inner).replace("\n", "\r\n"),
        inner,
        "\n" + inner,
        f"Subject: x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{b64}",
        "Subject: x\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nOl=E1 mundo. Tr=\n=EAs coisas.",
        "Subject: x\nContent-Type: text/html\n\n<html><style>p {}</style><body><p>Ol&aacute; mundo.<br>\nTr&#234;s coisas.</p></body></html>",
        "Subject: x\n\nOlÃ¡ mundo. TrÃªs coisas.",
    ):
        assert mail.sentences(raw) == ["Olá mundo.", "Três coisas."], raw


def test_multipart():
    mixed = (
        'Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b 1"\n\npreamble\n--b 1\nContent-Type: multipart/alternative; boundary=b2\n\n'
        "--b2\nContent-Type: text/plain\n\nOne here.\n--b2\nContent-Type: text/html\n\n<p>One there.</p>\n--b2--\n"
        '--b 1\nContent-Type: text/csv; name="a.csv"\n\nTwo.\n--b 1\nContent-Type: text/plain; name=n\nContent-Disposition: attachment\n\nThree.\n--b 1\nContent-Type: text/plain\n\nFour.\n--b 1--\nepilogue'
    )
    assert mail.sentences(mixed) == ["One here.", "Four."]
    html_only = 'Content-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/plain\n\n \n--b\nContent-Type: text/html\n\n<p>Only here.</p>\n--b--'
    assert mail.sentences(html_only) == ["Only here."]
    assert mail.sentences("Content-Type: multipart/mixed; boundary=gone\n\nStill text.") == ["Still text."]


def test_any_depth_of_parts():
    for depth in (1, 9, 40, 400, 3000):
        inner = "Content-Type: text/plain\n\nDeep inside."
        for i in range(depth):
            inner = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{inner}\n--b{i}--\n"
        assert mail.sentences("Subject: x\n" + inner) == ["Deep inside."], depth


def test_own_text():
    quoted = "> Old one.\n> > Older.\nAB> Old.\n| Old.\n"
    cases = {
        "Dear Ana,\n\nNew one. And\ntwo.\n\nKind regards\nBia\nRua X, 1\n\n****************************************\nNot here.\n": ["New one.", "And two."],
        "Above.\n\nAna wrote on Mon, 1 Jan:\n" + quoted + "\nBetween. " + "\n" + quoted + "Below.\n-- \nAna\n": ["Above.", "Between.", "Below."],
        "Above.\n\n-----Original Message-----\nFrom: a\nSent: b\nSubject: c\n\nOld text. Old again.\n": ["Above."],
        "________________________________\nDe: a\nData: b\n> velho\n\nNovo texto.\n": ["Novo texto."],
        "Above.\n\nAntes de imprimir, pense.\n\nMore.": ["Above.", "More."],
        "": [], "   \n\t": [],
    }
    for body, want in cases.items():
        assert mail.sentences(body and PLAIN + body) == want, body
    assert mail.sentences(None) == [] and mail.sentences("\n\n") == []
    long = "Palavra comum aqui. " * 20000
    assert len(mail.sentences(PLAIN + long)) == 20000


WORDS = {
    "law": "judge court verdict appeal statute clause bail".split(), "sport": "goal team coach stadium match league referee".split(),
    "health": "nurse ward fever clinic vaccine dose patient".split(), "transport": "bus lorry road toll ferry driver bridge".split(),
}


def corpus(n, seed=1):
    rng = random.Random(seed)
    fill = ["Thanks for the patience.", "Let us meet at ten.", "I will be away on Friday."]
    say = lambda k: rng.choice(["We lost days over the {} and the {}.", "What does {} have to do with {}?", "Ask Ana about the {} or the {}."]).format(*rng.sample(WORDS[k], 2))
    out = []
    for _ in range(n):
        counts = {k: rng.choice([0, 0, 0, 0, 1, 2, 3, 5]) for k in WORDS}
        ss = [say(k) for k, c in counts.items() for _ in range(c)] + rng.sample(fill, 2)
        rng.shuffle(ss)
        out.append((ss, {k for k, c in counts.items() if c >= 3}))
    return out


def test_held_out_subjects():
    train, test = corpus(300), corpus(200, 2)
    noisy = [(s, x if i % 15 else {"sport"}) for i, (s, x) in enumerate(train)]
    model = subjects.fit(noisy, sorted(WORDS))
    counts = model.counts([x for x, _ in test])
    right = sum({model.subjects[i] for i in np.flatnonzero(n >= 3)} == x for n, (_, x) in zip(counts, test))
    assert right >= 190
    one = model.subject_of(["Ask about the verdictt.", "I will be away on Friday.", ""])
    assert model.subjects[one[0]] == "law" and list(one[1:]) == [-1, -1]
    assert subjects.fit([], ["law"]).counts([["The court."], []]).tolist() == [[0], [0]]
    assert model.counts([]).shape == (0, 4) and model.counts([[], [""]]).sum() == 0


def test_factor_rows_follow_from_the_fixed_components():
    """The shares of a sentence are those of plain multiplicative updates, and batches do not matter."""
    model = subjects.fit(corpus(300), sorted(WORDS))
    texts = [s for m, _ in corpus(40, 3) for s in m]
    alone = [model.subject_of([s])[0] for s in texts]
    own = np.arange(len(texts))
    assert model.subject_of(texts, own).tolist() == alone
    got = model.mixtures(texts, own)
    k = len(model.subjects)
    for s, row in list(zip(texts, got))[:40]:
        found = subjects.terms(s)
        h = model.h[[model.terms[t] for t in found if t in model.terms]]
        common = subjects.COMMON_WEIGHT * sum(t not in model.terms for t in found)
        prior = np.zeros(k + 1)
        for _ in range(2):
            w = np.array([subjects.SUBJECT_SHARE / k] * k + [1 - subjects.SUBJECT_SHARE])
            for _ in range(subjects.APPLY_ROUNDS):
                part = w * h / np.maximum((w * h).sum(axis=1, keepdims=True), 1e-300)
                terms_of = part.sum(axis=0)
                w = terms_of + prior + np.array([0.0] * k + [common])
                w = w / max(w.sum(), 1e-12)
            prior[:k] = subjects.MESSAGE_PRIOR * np.log1p((terms_of[:k] >= subjects.LEAST_TERMS).astype(float))
        assert np.allclose(terms_of[:k], row, atol=1e-6)


def test_subject_frames(spark):
    docs = corpus(200)
    rows = [(i, PLAIN + " ".join(s)) for i, (s, _) in enumerate(docs)] + [(900, None), (901, ""), (902, "  ")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as subject", "2 as labels")
    labels = spark.createDataFrame(
        [(i, k.upper() if i % 9 == 0 else k, "a", 1) for i, (_, x) in enumerate(docs) if i % 2 for k in (x or {"none"})] + [(None, "law", "a", 1), (5000, "law", "a", 1), (1, None, "b", 1)] * 2,
        "doc_id bigint, subject string, annotator string, sentences int",
    )
    areas = spark.createDataFrame([(k, k.title()) for k in WORDS] + [(None, None)], "subject string, title string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(documents, labels, areas).collect()}
    want = {(i, k) for i, (_, x) in enumerate(docs) for k in x}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert subjects.subject_areas(documents, labels.limit(0), areas).count() == 0
    assert subjects.subject_areas(documents.limit(0), labels, areas).count() == 0
    assert len(subjects.labelled_messages(documents, labels, limit=7)) == 7
