"""Encoding of texts with a public byte-level BPE vocabulary, and decoding of its ids.

The merges are compiled into a finite-state transducer over bytes, determinised as it is used. After some
bytes of a word, a later token can only begin where the rest so far begins some token of the vocabulary.
For each such place the tokens up to it are fixed, as the last token before a place is the only one that
may follow the tokens before it. A state is the set of those places with the tokens not yet written; what
all of them share is written at once, so a token leaves after a lookahead of at most the longest token.
States and transitions are made when first met and forgotten together when there are too many.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the vocabulary, as ranks of byte strings.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States, words and pairs of tokens kept before they are forgotten; bounds of memory only.
MOST_STATES, MOST_WORDS, LONGEST_KEPT, MOST_PAIRS = 200_000, 200_000, 32, 500_000


class Transducer:
    """BPE as a lazily determinised transducer: ``encode`` for one text, ``word`` for one word's bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.split = regex.compile(pattern)
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}  # as many as there are tokens
        # The trie of the vocabulary: node -> {byte: node}, and the token that ends at a node.
        self.below: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for x in word:
                if x not in self.below[at]:
                    self.below[at][x] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                at = self.below[at][x]
            self.token[at] = rank
        self._forget()

    def _forget(self) -> None:
        # A state: places (trie node, tokens not yet written) in order of their start, and the last token written.
        # It is a dict of byte -> (tokens to write, next state), with its key under None.
        self._states: dict[tuple, dict] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._start = self._state((((0, ()),), -1))

    def _state(self, key: tuple) -> dict:
        state = self._states.get(key)
        if state is None:
            state = self._states[key] = {None: key}
        return state

    def merged(self, parts: list[bytes]) -> list[int]:
        """The plain definition: join the neighbours of lowest rank until none can be joined."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _may_stand(self, token: int) -> bool:
        """Whether the merges of a token's bytes give that token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged([bytes([x]) for x in self.bytes_of[token]]) == [token]
        return known

    def _may_follow(self, first: int, second: int) -> bool:
        """Whether the merges of two tokens' bytes give those two tokens."""
        known = self._follows.get((first, second))
        if known is None:
            both = self.bytes_of[first] + self.bytes_of[second]
            if len(self._follows) >= MOST_PAIRS:
                self._follows.clear()
            known = self._follows[first, second] = self.merged([bytes([x]) for x in both]) == [first, second]
        return known

    def _step(self, state: dict, x: int) -> tuple[tuple[int, ...], dict]:
        places, written = state[None]
        live: list[tuple[int, tuple[int, ...]]] = []
        here: tuple[int, ...] | None = None
        for node, tokens in places:
            node = self.below[node].get(x)
            if node is None:
                continue
            if self.below[node]:
                live.append((node, tokens))
            token = self.token[node]
            if here is None and token >= 0 and self._may_stand(token):
                before = tokens[-1] if tokens else written
                if before < 0 or self._may_follow(before, token):
                    here = (*tokens, token)
        if here is None:
            raise ValueError("the vocabulary lacks a single byte")
        live.append((0, here))
        shared = 0
        while all(len(t) > shared and t[shared] == here[shared] for _, t in live):
            shared += 1
        out = here[:shared]
        step = out, self._state((tuple((n, t[shared:]) for n, t in live), out[-1] if out else written))
        state[x] = step
        return step

    def word(self, data: bytes) -> list[int]:
        """Tokens of the bytes between two splits."""
        out: list[int] = []
        state = self._start
        for x in data:
            step = state.get(x)
            if step is None:
                step = self._step(state, x)
            if step[0]:
                out += step[0]
            state = step[1]
            if len(self._states) > MOST_STATES:  # within a long word as well; the word goes on from where it is
                key = state[None]
                self._forget()
                state = self._state(key)
        out += state[None][0][-1][1]  # what stands before the last place
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose names are ordinary text; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        for m in self.split.finditer(text):
            piece = m.group()
            ids = self._words.get(piece)
            if ids is None:
                ids = self.word(piece.encode("utf-8", "replace"))
                if len(piece) <= LONGEST_KEPT:
                    if len(self._words) >= MOST_WORDS:
                        self._words.clear()
                    self._words[piece] = tuple(ids)
            out += ids
        return out


class Utf8Decoder:
    """Bytes in, text out, in any portions; each longest broken start of a character becomes U+FFFD."""

    def __init__(self) -> None:
        self.value = self.left = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for x in data:
            if self.left:
                if self.low <= x <= self.high:
                    self.value = self.value << 6 | x & 0x3F
                    self.low, self.high = 0x80, 0xBF
                    self.left -= 1
                    if not self.left:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.left, self.low, self.high = 0, 0x80, 0xBF
            if x < 0x80:
                out.append(chr(x))
            elif 0xC2 <= x <= 0xDF:
                self.value, self.left = x & 0x1F, 1
            elif 0xE0 <= x <= 0xEF:
                self.value, self.left = x & 0x0F, 2
                self.low, self.high = (0xA0 if x == 0xE0 else 0x80), (0x9F if x == 0xED else 0xBF)
            elif 0xF0 <= x <= 0xF4:
                self.value, self.left = x & 0x07, 3
                self.low, self.high = (0x90 if x == 0xF0 else 0x80), (0x8F if x == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """U+FFFD if the bytes ended within a character."""
        left, self.left = self.left, 0
        self.low, self.high = 0x80, 0xBF
        return "�" if left else ""


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, packed, to be sent with a job: some 0.6 MB whatever the data."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


@lru_cache(2)
def transducer(packed: bytes) -> Transducer:
    """One transducer for each Python worker, kept from task to task."""
    return Transducer({base64.b64decode(a): int(b) for a, b in (line.split() for line in zlib.decompress(packed).splitlines() if line)})


def encode_texts(texts: DataFrame, id_column: str, column: str, path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, tokens) with the number of ids alone.

    Empty and null texts have the empty list (0 tokens). One row out for each row in, repeated or not; an empty
    table gives an empty result; other columns are ignored. Texts may be of any length. No shuffle.
    """
    packed = texts.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(packed.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = [np.array(encode(x), np.int32) for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists], np.int32)
                if counts_only:
                    result = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
                    result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.array([], np.int32)))
                yield pa.record_batch([part.column(0), result], names=[id_column, "tokens" if counts_only else "ids"])

    kind = dict(texts.dtypes)[id_column]
    out = f"`{id_column}` {kind}, " + ("tokens int" if counts_only else "ids array<int>")
    return texts.select(id_column, F.col(column).cast("string").alias("_text")).mapInArrow(run, out)


def decode_ids(encoded: DataFrame, id_column: str, column: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text) of lists of ids, decoded as a stream; a null list gives a null text, an unknown id U+FFFD."""
    packed = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = transducer(packed.value).bytes_of
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                stream = Utf8Decoder()
                texts.append(None if ids is None else "".join([stream.feed(known.get(i, b"\xff")) for i in ids]) + stream.close())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return encoded.select(id_column, column).mapInArrow(run, f"`{id_column}` {dict(encoded.dtypes)[id_column]}, text string")
