"""Exact dedup by two-pass Bloom filtering: only rows whose hash may repeat are shuffled.

Pass one sends the 8-byte hashes alone, each once per batch of rows, to the task that owns
them.  That task keeps a Bloom filter of the hashes it has seen; a hash that arrives again
goes into a second filter, which holds possibly repeated hashes only.  Pass two probes the
second filter, broadcast within ``MOST_BITS``: rows that miss it are alone for certain and
pass straight through, the others are grouped exactly, by SHA-256 of the text without white
space.  Strangers that pass a filter end as groups of one, so the result never depends on
its size.

A group is counted and its row that stays is chosen by a partial aggregate; members read
the outcome from a table of one row per group, which Spark splits where a group is hot.

Defined cases: a null text is empty; empty texts, and texts of white space alone, are one
group; of equal texts the longest original stays, then the smallest id, null ids last;
among rows that also share the id exactly one stays, the first as written.  An empty table
gives an empty result; other columns travel untouched through ``keep_one``, and none of
them clashes with a helper column, since rows travel as one struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from . import common as C

#: Bound of the second filter, which is broadcast (2**33 bits are 1 GB), and hashes that one task's first filter is sized for.
MOST_BITS, PART_HASHES = 2**33, 4_000_000


def normalised(text: Column) -> Column:
    """Text without white space: plain replacements, which only search bytes."""
    text = F.coalesce(text, F.lit(""))
    for blank in C.BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row as struct ``row``, with its id and place, code points, SHA-256 (bytes) and 64-bit hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), C.place(id_col).alias("place"), F.length(text).alias("points"), C.identity(F.col(text_col)).alias("ident"), F.unhex(F.sha2(normalised(text), 256)).alias("sha"))
    return base.withColumn("h", F.xxhash64("sha"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hash of a batch once, and whether the batch held it more often."""
    for b in batches:
        h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "many"])


def _arriving_again(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes that this task meets for the second time or later, by a Bloom filter of those it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(words, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            h, where, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True, return_counts=True)
            many = np.bincount(where, weights=b.column(1).to_numpy(zero_copy_only=False), minlength=len(h)) > 0
            again = many | (n > 1) | bloom.np_has(seen, h)
            np.bitwise_or.at(seen, bloom.np_slot(h, words), bloom.np_mask(h))
            yield pa.RecordBatch.from_arrays([pa.array(h[again])], ["h"])

    return run


def repeated_filter(hashes: DataFrame, count: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """The second filter as a written table and its words, from one 64-bit hash per row in column ``h``."""
    spark = hashes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_HASHES))
    once = hashes.select("h").mapInArrow(_once, "h long, many boolean").repartition(parts, "h")
    again = C.written(once.mapInArrow(_arriving_again(bloom.words_for(2 * -(-count // parts), 2**40)), "h long"), "repeated-hashes")
    words = bloom.words_for(again.count(), most_bits)
    return C.written(bloom.table(again, words), "repeated-filter"), words


def _order() -> Column:
    """Least for the row that stays."""
    return F.struct((-F.col("points")).alias("points"), "place", "tie")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and the SHA-256 of its normalised text.

    The digests (id, code points, SHA-256, hash: 64 bytes or so a row) are written once, and
    all later steps read them, never the texts.
    """
    made = keyed(docs, id_col, text_col).select("id", "place", "points", "sha", "h").withColumn("tie", F.monotonically_increasing_id())
    digests = C.written(made, "digests")
    found, words = repeated_filter(digests, digests.count(), most_bits)
    rows = bloom.probed(digests, found, words)
    alone = rows.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    doubtful = rows.where("maybe").select("id", "sha", "tie", "place", "points")
    groups = C.written(doubtful.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(F.struct(_order().alias("o"), "id")).alias("best")), "groups")
    groups = groups.select("sha", "group_size", F.col("best.id").alias("keep_id"), F.col("best.o.tie").alias("stays"))
    met = doubtful.select("id", "sha", "tie").join(groups, "sha").select("id", "keep_id", "group_size", (F.col("tie") == F.col("stays")).alias("kept"), "sha")
    return alone.unionByName(met)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The columns of ``docs``, one row of each group of equal texts; rows that are alone are not shuffled."""
    rows = keyed(docs, id_col, text_col)
    hashes = C.written(rows.select("h"), "hashes")
    found, words = repeated_filter(hashes, hashes.count(), most_bits)
    rows = bloom.probed(rows, found, words)
    doubtful = rows.where("maybe").withColumn("tie", F.col("ident"))
    chosen = doubtful.groupBy("sha").agg(F.min_by("row", _order()).alias("row"))
    return rows.where(~F.col("maybe")).select("row").unionByName(chosen.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS rank, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, text_sha256 FROM r
"""
