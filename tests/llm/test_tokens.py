"""Exact ids against two public implementations, edge cases, round trip."""

import random

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from aroeira.llm import tokens

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BPE = tokens.ByteBpe(public.path("byte_bpe_50k.tiktoken"))
HF = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
HF.encode_special_tokens = True


def theirs(text):
    return HF.encode(text, add_special_tokens=False).ids


def test_pattern_is_the_public_one():
    assert tokens.PATTERN == public.PATTERN


def test_odd_texts():
    rng = random.Random(3)
    odd = ["", " ", "  \n x", "a\x1cb \x1d c\x85d\xa0 e", "x" * 3000, " " * 2000 + "y", "½²Ⅷ १२ ﬁ", "don't  I'll'll <|endoftext|>", "日本語 🙂👩‍👩‍👧 ᠎ a b", "=" * 300 + "\r\n\r\n"]
    odd += ["".join(rng.choice(" \n\tab'sé日½.,!1ſ̃") for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for t in odd:
        assert BPE.encode(t) == theirs(t), t


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text_and_round_trip(text):
    ids = BPE.encode(text)
    assert ids == theirs(text) and BPE.count(text) == len(ids)
    assert b"".join(BPE.text[i] for i in ids) == text.encode()


def test_pairs_are_compatible_where_their_bytes_merge_to_them():
    rng = random.Random(9)
    near = [BPE.encode("".join(rng.choice("abehilnorst e") for _ in range(30))) for _ in range(300)]
    pairs = {(rng.randrange(50_000), rng.randrange(50_000)) for _ in range(4000)} | {p for ids in near for p in zip(ids, ids[1:])} | {(t, t) for t in range(0, 3000, 7)}
    pairs |= {(rng.randrange(600), rng.randrange(600)) for _ in range(4000)}
    for a, b in pairs:
        assert BPE.compatible(a, b) == (BPE.merged(BPE.text[a] + BPE.text[b]) == [a, b]), (a, b)


def test_cover_equals_merges():
    rng = random.Random(5)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcdeinorst xyz01=") for _ in range(rng.randrange(1, 24)))
        assert BPE.cover(piece) == BPE.merged(piece)


def test_memo_limits_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(tokens, "REMEMBERED_PAIRS", 2)
    small = tokens.ByteBpe(public.path("byte_bpe_50k.tiktoken"))
    text = "the quick brown foxes jumped over unbelievably lazy dogs; " * 4
    assert small.encode(text) == BPE.encode(text) == theirs(text)


def test_words_end_where_pieces_end():
    text = "a  b\n c\t\td 'll x9 \n\n  e"
    assert [p for w in tokens.WORDS.findall(text) for p in regex.findall(tokens.PATTERN, w)] == regex.findall(tokens.PATTERN, text)


def test_frames(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    rows = [(1, "hello world", "s", 0), (2, "", "s", 0), (3, None, None, 0), (None, "olá", "s", 0), (1, "hello world", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df, path=path).collect()), key=repr)
    assert got == sorted([(1, theirs("hello world"))] * 2 + [(2, []), (3, []), (None, theirs("olá"))], key=repr)
    assert sorted((r.doc_id or 0, r.tokens) for r in tokens.token_counts(df, ["doc_id", "source"], path=path).collect()) == [(0, len(theirs("olá"))), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert tokens.encode(df.limit(0), path=path).count() == 0
    assert tokens.encode(df, path=path).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_batches_are_cut_by_bytes():
    texts = ["a" * 10, None, "", "b" * 100, "c" * 3, "d" * 3, "e" * 9]
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": pa.array(texts, pa.string())})
    for size in (1, 5, 12, 20, 1000):
        got = list(tokens.pieces([batch, batch.slice(0, 0)], 1, size))
        assert [t for p in got for t in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= size for p in got)
