"""Phrase collocations from vertical positional inverted lists.

Texts are cut into blocks; a block holds, for each of its words, the sorted positions of the
word.  Positions run on within a piece and skip one number between pieces, so that
neighbours differ by one exactly if a phrase may span them.  Each level makes the lists anew
from the texts: a task holds one block's lists, and lists are never rows, of which Spark
would gather many megabytes each for a reader, a writer and a batch.  The list of a
phrase of k words is extended by merging it, moved by k, with the lists of the words next
to it; the lengths of lists over all blocks are the exact frequency.

* Level 1: list lengths are summed per word; words of ``MIN_COUNT`` or more are frequent.
* Level 2, 3: a part of a frequent phrase is frequent, so only lists of words, then pairs,
  that a Bloom filter of the frequent ones knows are extended.  The filter is bounded by
  ``MOST_BITS`` and only ever lets more lists pass; the exact sums decide.

Blocks count within themselves before anything is shuffled, so a frequent word or phrase is
one row per block.  Words stand as 64-bit hashes of language and word until the end.

Defined cases: a null text is empty; a null language is ``und``, together with rows that say
so; empty texts and tables give no phrase; rows are counted one by one, whatever their ids,
so repeated rows count again; a text is never cut, so a block is as long as one text at
least; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from . import common as C
from .suffix_dedup import _BASE, _TABLE, mixed

MIN_COUNT, SHARE, TOP = 10, 50, 2000
#: Shares of a language that are ranked by themselves before they meet.
SHARES = 64
#: Bytes of text in a block (or one text, if longer), and bits of a filter that workers hold (2**28 bits are 32 MB).
BLOCK_BYTES, MOST_BITS = 3_000_000, 2**28
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, list lengths, and all positions, list after list, of the texts together."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(data):
        return pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int32)
    first = np.unique(offsets[:-1] - offsets[0])
    first = first[first < len(data)]
    kind = _KIND[data]
    inside, breaks = kind == 0, kind == 2
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[first] = inside[first]
    closes[first[1:] - 1] = inside[first[1:] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # a new text is a new piece as well
    gaps = np.cumsum(breaks, dtype=np.int32)[begin] + np.searchsorted(first, begin, "right").astype(np.int32)
    at = np.arange(len(begin), dtype=np.int32) + gaps
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    codes = words.indices.to_numpy()
    return words.dictionary, np.bincount(codes, minlength=len(words.dictionary)), at[np.argsort(codes, kind="stable")]


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (none is empty) of a language."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first, n = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(n.max()) - 1, _BASE)]))
    sums = np.add.reduceat(_TABLE[data] * powers[np.arange(len(data)) - np.repeat(first, n)], first)
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return mixed(mixed(sums + n.astype(np.uint64)) + seed).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, words, their hashes and list lengths, and positions list after list, of each block."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        of = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = b.column(1).take(pa.array(np.flatnonzero(of == k)))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1, [len(texts)]]))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                words, lengths, at = postings(texts.slice(low, high - low))
                if len(words):
                    yield lang, words, word_hashes(lang, words), lengths, at


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h1, n) of each block's words, and the block's length as the list of no word."""
    for lang, words, h, lengths, at in _blocks(batches):
        yield pa.RecordBatch.from_pydict({"lang": [lang], "word": pa.array([None], pa.string()), "h1": pa.array([0], pa.int64()), "n": pa.array([len(at)], pa.int64())})
        for low in range(0, len(words), 50_000):
            own = words.slice(low, 50_000)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own)), "word": own.cast(pa.string()), "h1": pa.array(h[low : low + 50_000]), "n": pa.array(lengths[low : low + 50_000].astype(np.int64))})


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    b = b.view(np.uint64)
    return (a.view(np.uint64) ^ ((b << np.uint64(17)) | (b >> np.uint64(47)))).view(np.int64)


def _pair_hash(a: str, b: str):
    return F.expr(f"{a} ^ (shiftleft({b}, 17) | shiftrightunsigned({b}, 47))").alias("h")


def by_position(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    return at[order], code[order]


def extended(at: np.ndarray, length: int, next_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge of two sorted position lists: indexes of phrases of ``length`` and of what stands right behind them."""
    want = at + np.int32(length)
    where = np.searchsorted(next_at, want)
    hit = np.flatnonzero(np.take(next_at, where, mode="clip") == want) if len(next_at) else np.empty(0, np.int64)
    return hit, where[hit]


def _known_lists(h: np.ndarray, lengths: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the known words by position, with the word's index."""
    code = np.repeat(np.arange(len(h), dtype=np.int32), lengths)
    keep = bloom.np_has(known, h)[code]
    return by_position(at[keep], code[keep])


def _rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns as batches of a bounded length."""
    whole = pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})
    for low in range(0, whole.num_rows, 50_000):
        yield whole.slice(low, 50_000)


def _pairs(known_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h, lengths, positions in _blocks(batches):
            at, word = _known_lists(h, lengths, positions, known_words.value)
            here, there = extended(at, 1, at)
            pair, n = np.unique(word[here] * np.int64(len(h)) + word[there], return_counts=True)
            yield from _rows(h1=h[pair // len(h)], h2=h[pair % len(h)], n=n)

    return run


def _triples(known_words, known_pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h, lengths, positions in _blocks(batches):
            at, word = _known_lists(h, lengths, positions, known_words.value)
            here, there = extended(at, 1, at)
            pair, of = np.unique(word[here] * np.int64(len(h)) + word[there], return_inverse=True)
            likely = bloom.np_has(known_pairs.value, pair_hash(h[pair // len(h)], h[pair % len(h)]))[of]
            starts, pairs = at[here][likely], of[likely]
            # the word behind the pair, where its own pair with the word before it is likely too
            front, third = extended(starts, 2, at)
            both = np.isin(starts[front] + 1, starts, assume_unique=True)
            front, third = front[both], third[both]
            triple, n = np.unique(pairs[front] * len(h) + word[third], return_counts=True)
            first = pair[triple // len(h)]
            yield from _rows(h1=h[first // len(h)], h2=h[first % len(h)], h3=h[triple % len(h)], n=n)

    return run


def _known(hashes: DataFrame):
    """A broadcast filter of written hashes, for Python workers."""
    words = bloom.words_for(hashes.count(), MOST_BITS)
    return hashes.sparkSession.sparkContext.broadcast(bloom.array(bloom.table(hashes, words)))


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (lang, h1, word, f), pairs (h1, h2, f), triples (h1, h2, h3, f) of ``min_count`` or more, and totals (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = texts.mapInArrow(_words, "lang string, word string, h1 long, n long").groupBy("lang", "word", "h1").agg(F.sum("n").alias("f"))
    counts = C.written(each.where(F.col("word").isNull() | (F.col("f") >= min_count)), "frequent-words")
    words = counts.where("word is not null").select("lang", "h1", "word", "f")
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    known_words = _known(words.select(F.col("h1").alias("h")))
    pairs = texts.mapInArrow(_pairs(known_words), "h1 long, h2 long, n long")
    # blocks have counted already, so a count in the task would only fill its memory: dealt first, counted after
    pairs = C.written(pairs.repartition("h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "frequent-pairs")
    known_pairs = _known(pairs.select(_pair_hash("h1", "h2")))
    triples = texts.mapInArrow(_triples(known_words, known_pairs), "h1 long, h2 long, h3 long, n long")
    triples = C.written(triples.repartition("h1", "h2", "h3").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "frequent-triples")
    return words, pairs, triples, totals


def _score(a, left, right):
    """floor(1000000 a a / (left right)) in exact decimals: counts up to 10**13 fit."""
    return F.expr(f"cast(cast(1000000 * cast({a} as decimal(13,0)) * cast({a} as decimal(13,0)) as decimal(38,0)) div cast(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)) as decimal(38,0)) as bigint)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases (all, if None).

    Phrases inside a longer one that has ``share`` percent of their occurrences go.
    """
    words, pairs, triples, totals = frequent(docs, min_count, lang_col, text_col)
    word = lambda k: words.select(F.col("h1").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    longer = triples.select("h1", "h2", "f").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f")).groupBy("h1", "h2").agg(F.max("f").alias("longer"))
    twos = pairs.join(longer, ["h1", "h2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True)))
    twos = twos.withColumnRenamed("f", "a").join(word(2), "h2").join(words.withColumnRenamed("f", "f1"), "h1")
    twos = twos.select("lang", F.concat_ws(" ", "word", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    ends = triples.withColumnRenamed("f", "a").join(pairs.withColumnRenamed("f", "f12"), ["h1", "h2"]).join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23")), ["h2", "h3"])
    ends = ends.join(word(3), "h3").join(word(2), "h2").join(words.withColumnRenamed("f", "f1"), "h1")
    cut = F.least(F.struct(_score("a", "f1", "f23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(_score("a", "f12", "f3").alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")))
    threes = ends.select("lang", F.concat_ws(" ", "word", "w2", "w3").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = twos.withColumn("score", _score("a", "l", "r")).unionByName(threes)
    if top is not None:
        # a language's phrases are ranked in shares first, so that the last window reads SHARES * top rows at most
        share_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(share_of)).where(F.col("rank") <= top).drop("rank")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    else:
        found = found.withColumn("rank", F.lit(None).cast("long"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (SELECT p.lang, p.phrase, p.k, p.f AS a, x.f AS l, y.f AS r, x.k AS cut, ((1000000::HUGEINT * p.f * p.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM f p JOIN f x ON x.lang = p.lang AND x.k < p.k AND x.phrase = array_to_string(p.w[1:x.k], ' ') JOIN f y ON y.lang = p.lang AND y.k = p.k - x.k AND y.phrase = array_to_string(p.w[x.k + 1:], ' ') WHERE p.k > 1),
c AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT t.lang, t.f, unnest([array_to_string(t.w[1:2], ' '), array_to_string(t.w[2:3], ' ')]) AS phrase FROM f t WHERE t.k = 3),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i USING (lang, phrase) WHERE 100 * i.f >= 50 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c ANTI JOIN gone USING (lang, phrase)) JOIN n USING (lang) WHERE rank <= 2000
"""
