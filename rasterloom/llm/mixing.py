"""Mix sources to target weights with DataFrame functions only.

Words are aggregated per source; targets share a multiple of all words by weight and
stop at a cap; a document is taken ``floor(rate)`` times plus one Bernoulli copy drawn
from a hash of its id and text, where ``rate`` is its source's target over its source's words.

Defined cases: a null source is a source of its own, last in order; null or blank text
has size 0 and takes 0 words; a source without words has target 0; rows with a null id
draw by their texts, so they are taken in proportion as well; rows that share both id and
text draw alike; an empty table gives an empty result; other columns travel untouched,
whatever their names, since rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Of (source, source_size), one row per source: adds weight, target, rate.

    Sources fill up in the order of ``cap * size / weight``; the sorted running sums say
    which of them stop at the cap, so no loop is needed.  The windows without keys hold one
    row per source, never documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    filling = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    left = (F.sum("source_size").over(everything) * F.lit(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)
    full = (left * F.col("weight")) >= (F.col("source_size") * F.lit(cap) * F.sum("weight").over(after))
    return (
        ranked.withColumn("full", full)
        .withColumn("rest", F.sum("source_size").over(everything) * F.lit(share) - F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything) * F.lit(cap))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("source_size") * F.lit(cap)).otherwise(F.col("rest") * F.col("weight") / F.col("open_weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "weight", "target", "rate")
    )


def draw(id_col: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1), a function of id, text and seed alone: 52 bits of MD5."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with size, source_size, target, rate and copies."""
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("u"))
    table, fits = C.small(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    if fits:
        t = table.withColumnRenamed("source", "t_source")
        joined = sized.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left")
    else:  # a source may hold a third of all rows: spread it over 64 copies of its target
        salts = 64
        t = table.withColumnRenamed("source", "t_source").withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        s = sized.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int"))
        joined = s.join(t, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt")), "left")
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("u") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return joined.select("row", "id", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``."""
    plan = plan_mix(docs, **options).where("copies > 0")
    return plan.select(F.explode(F.expr("array_repeat(row, copies)")).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = plan_mix(docs)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
  >= 2.0::DOUBLE * source_size * sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM w),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE
  (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.digest || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
