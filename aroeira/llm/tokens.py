"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Tokens are byte strings, mapped to Latin-1 so that one Aho-Corasick automaton finds
every token that starts at every byte.  A piece is covered from left to right with
the longest token first; a token may follow another only if the two, merged from
their bytes, come out as exactly these two (memoised per pair of tokens).  A position
that cannot be continued is dead and left by stepping back.  A covering in which all
neighbours are compatible is the merge result itself, so the ids are exact, in time
linear in the text.  Texts are first cut after each run of white space's following
word, a cut the tokenizer's own pattern always makes, and words are memoised.

Defined results: an empty text and a null text both have no ids (an empty list).
Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Where the public vocabularies are; a parameter of every function here.
TOKENIZERS = os.environ.get("AROEIRA_TOKENIZERS", "/opt/tokenizers")
BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Fixed value: the tokenizer's splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
WORDS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

REMEMBERED_WORD = 64
REMEMBERED_PIECE = 16
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 1_000_000


class ByteBpe:
    """Exact byte-level BPE from a rank file (base64 token, rank per line), given as its path or its bytes."""

    def __init__(self, source: str | bytes) -> None:
        import ahocorasick
        import regex

        lines = (source if isinstance(source, bytes) else Path(source).read_bytes()).splitlines()
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.text = {r: t for t, r in self.rank.items()}
        self.length = [len(self.text.get(r, b"")) for r in range(max(self.text, default=0) + 1)]
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pieces = _Pieces(self)
        self.words = _Words(self)
        self.sizes = _Sizes(self)

    def merged(self, data: bytes, below: int = 1 << 30) -> list[int]:
        """Merges of rank less than ``below``, straight from the definition; used on single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            r, i = min(ranked)
            if r >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, None for a single byte; remembered."""
        if token not in self._halves:
            parts = self.merged(self.text[token], token) if self.length[token] > 1 else []
            self._halves[token] = (parts[0], parts[-1]) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together merge to just these two tokens.

        The merges of both are undone from the last to the first; at each point no merge
        across the border may have had its turn.  Turns go by rank, of equal ranks the left one first.
        """
        rank, text = self.rank, self.text
        left, right, turn = a, b, 1 << 30
        known = True
        while True:
            if rank.get(text[left] + text[right], 1 << 30) < turn:
                known = False
                break
            for side in ("left", "right") if left > right else ("right", "left"):
                parts = self.halves(left if side == "left" else right)
                if parts:
                    break
            else:
                break
            if side == "left":
                turn, left = left, parts[1]
            else:
                turn, right = right + 1, parts[0]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = known
        return known

    def cover(self, data: bytes) -> list[int]:
        """The covering of ``data`` by tokens whose neighbours are all compatible."""
        end, length, known = len(data), self.length, self.pairs.get
        options: list[list[int]] = [[] for _ in range(end)]
        for last, token in self.automaton.iter(data.decode("latin-1")):
            options[last + 1 - length[token]].append(token)
        dead = bytearray(end + 1)
        path: list[int] = []
        left: list[int] = []  # of each token of the path, the shorter ones not yet tried
        at, before, choice = 0, -1, len(options[0])
        while at < end:
            here = options[at]
            while choice:
                choice -= 1
                token = here[choice]
                if dead[at + length[token]]:
                    continue
                if before < 0:
                    break
                fits = known(before << 20 | token)
                if fits or fits is None and self.compatible(before, token):
                    break
            else:
                dead[at] = 1
                at -= length[path.pop()]
                choice = left.pop()
                before = path[-1] if path else -1
                continue
            path.append(token)
            left.append(choice)
            at += length[token]
            before = token
            choice = len(options[at]) if at < end else 0
        return path

    def encoded(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.words.__getitem__, WORDS.findall(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, WORDS.findall(text))) if text else 0


class _Pieces(dict):
    """Ids of the pieces that the pattern splits words into, remembered while they are short."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.bpe.rank.get(data)
        ids = array("i", (whole,) if whole is not None else self.bpe.cover(data)).tobytes()
        if len(piece) <= REMEMBERED_PIECE:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[piece] = ids
        return ids


class _Words(dict):
    """Ids of words with the white space before them, remembered while they are short."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.bpe.pieces.__getitem__, self.bpe.split(word)))
        if len(word) <= REMEMBERED_WORD:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Sizes(dict):
    """Numbers of ids of words with the white space before them, remembered while they are short."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        n = sum(map(len, map(self.bpe.pieces.__getitem__, self.bpe.split(word)))) // 4
        if len(word) <= REMEMBERED_WORD:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = n
        return n


_LOADED: dict[tuple[int, int], ByteBpe] = {}


def vocabulary(spark: SparkSession, path: str = BPE_50K) -> Broadcast:
    """The rank file, read on the driver and sent to the workers: about a megabyte, whatever the corpus."""
    return ship(spark).sparkContext.broadcast(Path(path).read_bytes())


def tokenizer(data: bytes) -> ByteBpe:
    """One tokenizer per worker process and vocabulary."""
    key = (len(data), zlib.crc32(data))
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(data)
    return _LOADED[key]


def pieces(batches: Iterable[pa.RecordBatch], text: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut where ``size`` bytes of the text column are full, so long texts do not pile up; texts stay whole."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            end = max(at + 1, full)
            yield batch.slice(at, end - at)
            at = end


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BPE_50K) -> DataFrame:
    """(key, ids): the ids of every text, whole, without special tokens."""
    kind, ranks = df.schema[key].dataType.simpleString(), vocabulary(df.sparkSession, path)

    def run(batches):
        bpe = tokenizer(ranks.value)
        for batch in pieces(batches, 1):
            ids = [bpe.encoded(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = BPE_50K) -> DataFrame:
    """(*keep, tokens): the number of ids of every text; only the number leaves Python."""
    slim, ranks = df.select(*keep, text), vocabulary(df.sparkSession, path)
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        bpe = tokenizer(ranks.value)
        for batch in pieces(batches, len(keep)):
            tokens = pa.array([bpe.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], tokens], names=[*keep, "tokens"])

    return slim.mapInArrow(run, schema + ", tokens bigint")
