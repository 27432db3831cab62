"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Per pre-token the bytes form a linked list.  Every adjacent pair with a rank waits in the
bucket of that rank; a bitmap marks the buckets in use and a second bitmap the words of the
first, so the highest bits give the lowest rank in two steps whatever the pre-token's length:
ranks stand in the bitmap counted from the last one.  A token is a stretch of the pre-token,
so the list's links are all that is kept of it.
Entries whose pair has changed meanwhile are stale and skipped.  A pre-token of n bytes costs
O(n log n) at worst, with no quadratic rescans, so a text without blanks is no trouble.

Texts go through Spark's Arrow batches; nothing is shuffled.  The vocabulary is broadcast:
its size is that of the rank file, checked against ``MAX_VOCABULARY_BYTES``.

Defined cases: null and empty texts give no ids; any white space, emoji or broken grouping is
encoded as bytes; repeated rows are encoded alike; an empty table gives an empty result; the
columns of the input are kept by :func:`encode`, whose own are named by the caller.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAX_VOCABULARY_BYTES = 64 << 20
#: Words whose ids a worker remembers; the memory is emptied when full, and at a task's end if it then holds more than MEMORY_KEPT.
MEMORY_WORDS, MEMORY_KEPT = 1_000_000, 600_000
#: Longer words are encoded but not remembered.
LONGEST_WORD = 48


#: Small tables of the merge loop.
_BYTE = [bytes([k]) for k in range(256)]
_BIT = [1 << k for k in range(256)]
_COUNT = list(range(-1, 300))


class Unsafe(Exception):
    """A blank followed by white space: the text must be cut by the pattern as a whole."""


class Bpe:
    """Encoder and decoder for one rank table."""

    WIDTH = 256

    def __init__(self, rank_file: bytes, pattern: str):
        import public_tokenizers

        # splitting at blanks holds for this pattern only
        self.by_word = pattern == public_tokenizers.PATTERN
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        # ranks counted from the last one, so that the lowest rank is the highest bit
        last = max(self.ranks.values())
        self.last, self.places = last, {token: last - rank for token, rank in self.ranks.items()}
        self.names = [str(last - place) for place in range(last + 1)]
        self.bytes = [self.places.get(b) for b in _BYTE]
        self.pairs = [[self.places.get(a + b) for b in _BYTE] for a in _BYTE]
        self.low = [0] * (last // self.WIDTH + 1)
        self.words = _Memory(self)
        self.parts: dict[str, str] = {}
        self.spelled = {str(rank): token for token, rank in self.ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return [self.last - place for place in self._merged(piece)]

    def _merged(self, piece: bytes) -> list[int]:
        """Places of one pre-token's tokens."""
        get, low, n = self.places.get, self.low, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        if n < len(_COUNT) - 2:
            after, before = _COUNT[2 : n + 2], _COUNT[:n]
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        token: list[int] = list(map(self.bytes.__getitem__, piece))
        waiting: list[int | None] = [pairs[a][b] for a, b in pairwise(piece)]  # the place under which a position stands now
        waiting.append(None)
        buckets: dict[int, int | list[int]] = {}  # by place: the one position that waits there, or a heap of several
        high = 0  # bit w: word w of ``low`` has bits
        for k, r in enumerate(waiting):
            if r is not None:
                if r in buckets:
                    if (held := buckets[r]).__class__ is list:
                        held.append(k)
                    else:
                        buckets[r] = [held, k]
                else:
                    buckets[r] = k
                    w = r >> 8
                    low[w] |= _BIT[r & 255]
                    high |= _BIT[w] if w < 256 else 1 << w
        while high:
            w = high.bit_length() - 1
            bits = low[w]
            b = bits.bit_length() - 1
            r = w << 8 | b
            k = buckets[r]
            if k.__class__ is int or len(k) == 1:
                if k.__class__ is not int:
                    k = k[0]
                del buckets[r]
                low[w] = bits = bits ^ _BIT[b]
                if not bits:
                    high ^= _BIT[w] if w < 256 else 1 << w
            else:
                k = heappop(k)
            if waiting[k] != r:
                continue  # stale
            token[k] = r
            gone = after[k]
            waiting[gone] = None
            right = after[k] = after[gone]
            if right < n:
                before[right] = k
                r = waiting[k] = get(piece[k : after[right]])
                if r is not None:
                    if r in buckets:
                        if (held := buckets[r]).__class__ is list:
                            heappush(held, k)
                        else:
                            buckets[r] = [held, k] if held < k else [k, held]
                    else:
                        buckets[r] = k
                        w = r >> 8
                        low[w] |= _BIT[r & 255]
                        high |= _BIT[w] if w < 256 else 1 << w
            else:
                waiting[k] = None
            left = before[k]
            if left >= 0:
                r = waiting[left] = get(piece[left:right])
                if r is not None:
                    if r in buckets:
                        if (held := buckets[r]).__class__ is list:
                            heappush(held, left)
                        else:
                            buckets[r] = [held, left] if held < left else [left, held]
                    else:
                        buckets[r] = left
                        w = r >> 8
                        low[w] |= _BIT[r & 255]
                        high |= _BIT[w] if w < 256 else 1 << w
        found, k = [], 0
        while k < n:
            found.append(token[k])
            k = after[k]
        return found

    def _spelled(self, piece: str) -> str:
        return " ".join(map(self.names.__getitem__, self._merged(piece.encode("utf-8", "surrogatepass"))))

    def _part(self, part: str) -> str:
        found = self.parts.get(part)
        if found is None:
            found = self._spelled(part)
            if len(part) <= LONGEST_WORD:
                if len(self.parts) >= MEMORY_WORDS // 4:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def spell(self, text: str) -> str:
        """The ids of a text in decimal, joined by blanks.

        The public pattern never matches across a blank that a visible character follows, so a text
        splits at such blanks and the words' ids are remembered; other texts are cut whole.
        """
        if not text:
            return ""
        if not self.by_word:
            return " ".join(map(self._part, self.find(text)))
        first, *rest = text.split(" ")
        try:
            found = list(map(self.words.__getitem__, rest))
        except Unsafe:
            return " ".join(map(self._part, self.find(text)))
        if first:
            found.insert(0, " ".join(map(self._part, self.find(first))))
        return " ".join(found)

    def forget(self) -> None:
        self.words.clear()
        self.parts.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.spell(text or "").split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def unspell(self, spelled: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, spelled.split(" "))) if spelled else b""


class _Memory(dict):
    """Ids of a blank and a word."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        if not word or word[0].isspace():
            raise Unsafe
        bpe = self.bpe
        # letters are one pre-token and a lone mark behind them another; the pattern is asked about all else
        first, *rest = [" " + word] if word.isalpha() else [" " + word[:-1], word[-1]] if word[-1] in ",." and word[:-1].isalpha() else bpe.find(" " + word)
        if not rest:
            found = bpe._spelled(first)
        else:  # a word and its punctuation: the word itself is remembered without it
            found = " ".join([self[first[1:]], *map(bpe._part, rest)])
        if len(word) <= LONGEST_WORD:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = found
        return found


_OPEN: dict[tuple, Bpe] = {}


def _opened(shared, pattern: str) -> Bpe:
    """One encoder for a worker process, kept from task to task."""
    key = (hashlib.sha256(shared.value).digest(), pattern)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Bpe(shared.value, pattern)
    return _OPEN[key]


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """(broadcast rank file, pattern).  ``path``: a rank file in tiktoken's form."""
    import public_tokenizers

    data = open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the rank file is too large to broadcast")
    return spark.sparkContext.broadcast(data), pattern or public_tokenizers.PATTERN


def _mapped(df: DataFrame, column: str, schema: T.StructType, vocab, row) -> DataFrame:
    """``row(bpe, value)`` gives the new columns of each row; the others pass through as they are."""
    shared, pattern = vocab
    names = [f.name for f in schema.fields]
    arrow = [{"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _opened(shared, pattern)
        try:
            for whole in batches:
                step = 512  # rows whose results are held at once
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    made = [row(bpe, v.as_py()) for v in batch.column(batch.schema.names.index(column))]
                    new = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(arrow)]
                    kept = [n for n in batch.schema.names if n not in names]
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in kept] + new, names=[*kept, *names])
        finally:
            if len(bpe.words) > MEMORY_KEPT:
                bpe.forget()  # the worker goes on to other stages, which need the memory

    kept = [f for f in df.schema.fields if f.name not in names]
    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *schema.fields]))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids of ``text_col``.  A column of ``docs`` that is named like ``ids_col`` is replaced."""
    schema = T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return _mapped(docs, text_col, schema, vocabulary(docs.sparkSession, path, pattern), lambda bpe, text: (bpe.encode(text),))


def decode(tokens: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that the ids stand for."""
    schema = T.StructType([T.StructField(bytes_col, T.BinaryType())])
    return _mapped(tokens, ids_col, schema, vocabulary(tokens.sparkSession, path, pattern), lambda bpe, ids: (bpe.decode(ids or []),))


def _both_ways(bpe: Bpe, text: str | None) -> tuple[list[int], str]:
    ids = bpe.encode(text)
    return ids, hashlib.sha256(bpe.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`encode`, and decodes the ids in the same pass; adds decoded_sha256, the SHA-256 of their bytes."""
    schema = T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])
    return _mapped(docs, text_col, schema, vocabulary(docs.sparkSession, path, pattern), _both_ways)


def _digest(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    spelled = bpe.spell(text or "")
    n = spelled.count(" ") + 1 if spelled else 0
    return n, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(bpe.unspell(spelled)).hexdigest()


def digests(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass; adds n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _mapped(docs, text_col, schema, vocabulary(docs.sparkSession, path, pattern), _digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
