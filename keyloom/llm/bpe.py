"""Encoding with a public byte-level BPE vocabulary, in linear time.

Texts are split by the vocabulary's pattern and each piece is encoded by backtracking.  An
Aho-Corasick automaton over all tokens gives the longest token that starts at each position; the
encoder takes it if the pair (token before, token) is compatible, that is, if merging would leave
the boundary between them alone; otherwise it tries the next shorter token, and where none fits
it steps back and marks the position as a dead end, so that no position fails twice.  The result
is exactly that of merging pairs by rank, without the quadratic worst case on long pieces.
Decoding gathers byte ranges through an offset table.

The vocabulary file (``token in base64, rank`` a line) is read on the driver from a path that is a
parameter and sent to the executors; it has a fixed size.

Defined results: null and empty texts have the empty list; special tokens are ordinary text;
lone surrogates cannot occur in Spark strings; encoding never fails.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PIECES = 200_000


class Vocabulary:
    """Tokens with the tables the encoder and decoder need."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines.splitlines() if line))
        self.tokens = [token for _, token in pairs]
        if [rank for rank, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.lengths = [len(token) for token in self.tokens]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, token in enumerate(self.tokens):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of each token; -1 for none
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1) for t in self.tokens]
        self._parts()
        self.cache: dict[str, tuple[int, ...]] = {}

    def _parts(self) -> None:
        """The two tokens each token was merged from, and the table of merging pairs."""
        self.merges: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        for i, token in enumerate(self.tokens):
            head = self.shorter[i]
            while head >= 0:
                tail = self.rank.get(token[self.lengths[head] :], i)
                if head < i and tail < i and self.compatible(head, tail):
                    self.left[i], self.right[i] = head, tail
                    self.merges[head, tail] = i
                    break
                head = self.shorter[head]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between tokens a and b alone.

        The merges that made a and b are undone, latest first; at each state the pair at the
        boundary must not merge earlier than the merge just undone.
        """
        merges, left, right = self.merges, self.left, self.right
        limit = 1 << 60
        while True:
            if merges.get((a, b), limit) < limit:
                return False
            undo_a = a > b
            if undo_a and right[a] == a or not undo_a and left[b] == b:
                undo_a = not undo_a  # a single byte cannot be undone; the other side is next
                if (right[a] == a) if undo_a else (left[b] == b):
                    return True
            if undo_a:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]  # of equal merges the left one comes first

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        size = len(piece)
        longest = [-1] * size
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end - lengths[token] + 1
            if longest[start] < 0 or lengths[token] > lengths[longest[start]]:
                longest[start] = token
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            if token < 0:  # no token fits here: the one before was wrong
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                continue
            end = at + lengths[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                token = shorter[token]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        cache = self.cache
        for piece in self.split(text):
            got = cache.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = got
            ids.extend(got)
        return ids

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no valid text become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("id outside the vocabulary")
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        index = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.bytes[index].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """The tables, made once in each Python worker."""
    key = hashlib.sha1(lines + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(lines, pattern)
    return _LOADED[key]


def load_vocabulary(path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    with open(path, "rb") as file:
        return _vocabulary(file.read(), pattern)


def _sent(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``<key>, ids`` of every row; a map over the scan, without a shuffle."""
    lines = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines.value, pattern)
        for batch in batches:
            # long texts: several small batches rather than one of unbounded size
            texts = batch.column(1)
            start, held, ends = 0, array("i"), [0]
            for i in range(batch.num_rows):
                held.extend(vocabulary.encode(texts[i].as_py()))
                ends.append(len(held))
                if len(held) >= 1_000_000 or i + 1 == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(held, np.int32)) if len(held) else pa.array([], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), ids], [key, "ids"])
                    start, held, ends = i + 1, array("i"), [0]

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``<key>, n_tokens`` of every row; the ids stay in the worker."""
    lines = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines.value, pattern)
        for batch in batches:
            counts = pa.array([len(vocabulary.encode(x.as_py())) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, n_tokens bigint")


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``<key>, text`` from lists of ids; a null list has a null text."""
    lines = _sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines.value, pattern)
        for batch in batches:
            texts = pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids)).mapInArrow(run, f"{key} {kind}, text string")
