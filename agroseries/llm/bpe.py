"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Encoding a pre-token: its bytes become a Latin-1 string, an Aho-Corasick
automaton over the vocabulary reports the longest token starting at every
byte, and a depth-first walk lays those tokens down from left to right.  A
token may follow another only if BPE itself would leave the two side by side
(``Vocabulary.adjacent``, memoised per pair); where it may not, the next
shorter prefix token is tried, and an end position that was given up is never
tried again.  The walk therefore visits every byte position a bounded number of
times, and a sequence whose neighbours are all compatible is exactly what the
merge loop would return.

Defined results: null text counts as empty (no ids); empty text gives an empty
array; text of any length is encoded whole; repeated rows give equal results.
The vocabulary file is a parameter and is opened once per Python worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import give_back

CACHE_ENTRIES = 200_000  # pre-tokens, cuts and pairs that a task remembers, each; then it starts anew


class Vocabulary:
    """Ranks of a byte-level BPE and what the backtracking walk needs of them."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick
        self.tokens = tokens
        self.size = [len(t) for t in tokens]
        self.most = max(self.size, default=0)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in tokens]
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        for i, t in enumerate(tokens):
            self._split(i, t)
        self.memo.clear()  # pairs judged while merges were still missing

    def _shorter(self, token: bytes) -> int:
        """The longest proper prefix that is a token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (r := self.rank.get(token[:n])) is not None:
                return r
        return -1

    def _split(self, i: int, token: bytes) -> None:
        """The last merge that builds the token; all its parts have lower ranks."""
        left = self.shorter[i]
        while left >= 0:
            right = self.rank.get(token[len(self.tokens[left]):])
            if right is not None and left < i and right < i and self._stays(left, right):
                self.halves[i] = (left, right)
                self.merged[left, right] = i
                return
            left = self.shorter[left]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE can leave these two tokens next to each other."""
        pair = left << 32 | right
        known = self.memo.get(pair)
        if known is None:
            if len(self.memo) >= CACHE_ENTRIES:
                self.memo.clear()
            known = self.memo[pair] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo merges from the latest to the earliest on both sides of the
        border; no merge across the border may come before the one undone."""
        bound = len(self.tokens)  # merges across the border below this rank would have won
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            inner_left, inner_right = self.halves[left], self.halves[right]
            if inner_left is not None and (left > right or inner_right is None):
                bound, left = left, inner_left[1]
            elif inner_right is not None:
                # a merge of equal rank on the left of the border happens first
                bound, right = right + 1, inner_right[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        # the walk without a step back: longest matches one after the other
        ids = [token for _, token in self.automaton.iter_long(latin)]
        known, before = self.memo.get, ids[0]
        for i in range(1, len(ids)):
            token = ids[i]
            stays = known(before << 32 | token)
            if not (self.adjacent(before, token) if stays is None else stays):
                return self._walk(piece, latin, ids[:i], token)
            before = token
        return ids

    def _longest(self, piece: bytes, latin: str, at: int) -> int:
        """The longest token that starts here; the trie bounds its length."""
        n = self.automaton.longest_prefix(latin[at : at + self.most])
        rank = self.rank.get
        while (token := rank(piece[at : at + n])) is None:
            n -= 1
        return token

    def _walk(self, piece: bytes, latin: str, ids: list[int], token: int) -> list[int]:
        """Go on from compatible ``ids`` and a token that may not follow them."""
        n, size, shorter, adjacent = len(piece), self.size, self.shorter, self.adjacent
        at = sum(size[i] for i in ids)
        dead = set()
        while True:
            end = at + size[token]
            if end not in dead and (not ids or adjacent(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return ids
                at, token = end, self._longest(piece, latin, end)
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = ids.pop()
                at -= size[token]
                token = shorter[token]


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(token_bytes(path))


#: A single blank between two visible characters always starts a pre-token, so
#: text can be cut there and the cuts remembered.
CUT = re.compile(r"(?<=\S) (?=\S)")
WIDE = re.compile(r"\s\s")


class Remembered(dict):
    """Ids by text, made when missing; starts anew when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= 32:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Text to ids, as 32-bit integers of the machine's byte order."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.vocabulary, self.pieces = load(path), regex.compile(pattern).findall
        self.piece, self.cut = Remembered(self._piece), Remembered(self._cut)

    def forget(self) -> None:
        self.piece.clear()
        self.cut.clear()
        self.vocabulary.memo = {}

    def _piece(self, piece: str) -> bytes:
        return array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def _ids(self, text: str) -> bytes:
        return b"".join([self.piece[p] for p in self.pieces(text)])

    def _cut(self, cut: str) -> bytes:
        """Ids of a blank and what follows it up to the next cut."""
        if cut[:-1].isalpha() and cut[-1] in ".,":  # what the pattern does with most words
            return self.piece[" " + cut[:-1]] + self.piece[cut[-1]]
        return self._ids(" " + cut)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        # without neighbouring white space, all blanks inside are such places
        first, *rest = text.split(" ") if WIDE.search(text) is None else CUT.split(text)
        return self._ids(first) + b"".join(map(self.cut.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """``array<int>`` of token ids of a text column, without special tokens."""
    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        try:
            for texts in batches:
                parts = [own.encode(t.as_py()) for t in texts]
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
        finally:  # Python workers outlive the task: what it remembers goes with it
            own.forget()
            give_back()

    # else Catalyst would write it once more into each expression that uses its result
    return bpe_encode.asNondeterministic()(text)


def encode_checked(text: Column, path: str, pattern: str) -> Column:
    """``struct<ids, round_trip>``: the ids of a text column (null: empty) and whether they
    decode to it again; one Python worker a task does both."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("round_trip", T.BooleanType())])

    @F.arrow_udf(kind)
    def bpe_encode_checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, token = encoder(path, pattern), token_bytes(path).__getitem__
        try:
            for texts in batches:
                parts, same = [], []
                for t in texts:
                    t = t.as_py() or ""
                    ids = own.encode(t)
                    parts.append(ids)
                    same.append(b"".join(map(token, np.frombuffer(ids, np.int32).tolist())) == t.encode())
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])
        finally:
            own.forget()
            give_back()

    return bpe_encode_checked.asNondeterministic()(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of a column of token ids; null for null."""
    @F.arrow_udf(T.BinaryType())
    def bpe_decode(lists: pa.Array) -> pa.Array:
        token = token_bytes(path).__getitem__
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        known = lists.is_valid().to_pylist()
        return pa.array([b"".join(map(token, values[a:b].tolist())) if k else None for k, a, b in zip(known, ends[:-1], ends[1:])], pa.binary())

    return bpe_decode(ids)


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids; other columns pass through."""
    return docs.withColumn(ids, encode(F.coalesce(F.col(text), F.lit("")), path, pattern))
