"""Bloom filters of 64-bit hashes as tables: every hash owns one 64-bit word and four bits in it.

A filter has at most the bits that its maker is given, however many hashes it takes; more
hashes let more strangers pass, and members always pass.  So a filter may only save work,
and an exact step must follow it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a hash gets while the bound allows it, and words in one row of the table.
BITS_EACH, CHUNK = 16, 1024


def words_for(count: int, most_bits: int) -> int:
    """64-bit words for ``count`` hashes: a power of two of whole rows, within ``most_bits``."""
    words = CHUNK
    while words * 64 < BITS_EACH * count and words * 128 <= most_bits:
        words *= 2
    return words


def mask(h: str | Column) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12, 18)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def slot(h: str | Column, words: int) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(words - 1))


def np_mask(h: np.ndarray) -> np.ndarray:
    h, one = h.view(np.uint64), np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    for k in (0, 6, 12, 18):
        out |= one << ((h >> np.uint64(k)) & np.uint64(63))
    return out


def np_slot(h: np.ndarray, words: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(24)) & np.uint64(words - 1)).astype(np.int64)


def np_has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    m = np_mask(h)
    return bits[np_slot(h, len(bits))] & m == m


def table(hashes: DataFrame, words: int, h: str = "h") -> DataFrame:
    """(chunk, bits): ``words`` / CHUNK rows of CHUNK words each, from a column of hashes."""
    own = hashes.select(slot(h, words).alias("at"), mask(h).alias("m"))
    every = hashes.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("m"))
    merged = own.unionByName(every).groupBy("at").agg(F.bit_or("m").alias("m"))
    rows = merged.groupBy(F.expr(f"at div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("found"))
    return rows.select("chunk", F.col("found.m").alias("bits"))


def array(filter_table: DataFrame) -> np.ndarray:
    """The filter as one array on the driver; its size is the bound it was made with."""
    rows = filter_table.toArrow().sort_by("chunk")
    return rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64)


def probed(rows: DataFrame, filter_table: DataFrame, words: int, h: str = "h", name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean that is true for every member: one look at a broadcast row, no shuffle."""
    at = slot(h, words)
    met = rows.withColumn("_chunk", F.shiftright(at, CHUNK.bit_length() - 1)).join(F.broadcast(filter_table.withColumnRenamed("chunk", "_chunk").withColumnRenamed("bits", "_bits")), "_chunk", "left")
    m = mask(h)
    hit = F.get("_bits", at.bitwiseAND(F.lit(CHUNK - 1)).cast("int")).bitwiseAND(m) == m
    return met.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_chunk", "_bits")
