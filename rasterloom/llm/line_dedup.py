"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a sorted table (hash, owner): the document that keeps the line.  A batch of
documents with larger ids merge-anti-joins all runs and adds the hashes left over as a run
of level 0; ``FANOUT`` runs of one level are merged into one of the next.  A document loses
the lines whose owner has a smaller id.  Lines of a document are never gathered across
documents: only (document, position) pairs travel, and the text is cut in place.

Defined cases: a null or empty text is one empty line; keys under ``MIN_KEY`` code points
stay; rows with a null id count as one document after all others; rows that share an id are
one document, so they do not take lines from each other; an empty table gives an empty
result; other columns travel untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_KEY, BATCHES, FANOUT = 10, 4, 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return C.ascii_lower(F.trim(line, F.lit(C.BLANKS)))


def hashed_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(place, ident, pos, h1, h2): every line with a long enough key, as a 128-bit hash."""
    lines = docs.select("place", "ident", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("place", "ident", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    return keyed.select("place", "ident", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The levelled runs under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> str:
        self.made += 1
        path = f"{self.root}/level{level}/run{self.made}"
        run.repartition(F.col("h1"), F.col("h2")).sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*paths) if paths else None

    def add(self, lines: DataFrame) -> None:
        """Add a batch; its ids must all be above those added before."""
        fresh, old = lines.groupBy("h1", "h2").agg(F.min("place").alias("owner")), self.runs()
        if old is not None:
            # an anti-join, written so that Spark does not move it below the counts, where all lines would be shuffled
            old = old.select("h1", "h2", F.lit(True).alias("old")).hint("merge")
            fresh = fresh.join(old, ["h1", "h2"], "left").where("old is null").select("h1", "h2", "owner")
        self.levels[0].append(self._write(fresh, 0))
        for k in range(64):
            if k == len(self.levels) or len(self.levels[k]) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            # hashes of different runs are disjoint, so merging is a sorted rewrite
            merged = self.spark.read.schema("h1 long, h2 long, owner long").parquet(*self.levels[k])
            self.levels[k + 1].append(self._write(merged, k + 1))
            self.levels[k] = []

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(place, ident, drops): sorted line positions that each document loses."""
        hits = lines.join(self.runs().hint("merge"), ["h1", "h2"]).where("owner < place")
        return hits.groupBy("place", "ident").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def without(lines: str, drops: str) -> Column:
    """Array ``lines`` without the 0-based sorted positions ``drops``: slices between them, in linear time."""
    return F.expr(
        f"flatten(transform(sequence(0, size({drops})), k -> slice({lines}, "
        f"(if(k = 0, 0, {drops}[k - 1] + 1)) + 1, "
        f"(if(k = size({drops}), size({lines}), {drops}[k])) - (if(k = 0, 0, {drops}[k - 1] + 1)))))"
    )


def cuts(lines: DataFrame, batches: int) -> list[int]:
    """Places between the batches, each of about as many lines; fewer where one id holds many."""
    found = lines.agg(F.percentile_approx("place", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(found or []))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_key: int = MIN_KEY, fanout: int = FANOUT) -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with kept text, n_lines and n_dropped.

    The documents come in ``batches`` of rising ids, as a growing corpus would bring them.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct("*").alias("row"), C.place(id_col).alias("place"), F.col(text_col).alias("text")).withColumn("ident", C.identity(F.col("text")))
    lines = C.written(hashed_lines(base, min_key), "lines")
    runs = LineRuns(spark, C.scratch(spark, "line-runs"), fanout)
    bounds = cuts(lines, batches)
    for least, most in zip([None, *bounds], [*bounds, None], strict=True):
        part = lines if least is None else lines.where(F.col("place") >= least)
        runs.add(part if most is None else part.where(F.col("place") < most))
    drops = runs.dropped(lines)
    joined = base.join(drops, ["place", "ident"], "left").withColumn("lines", lines_of(F.col("text")))
    cut = F.when(F.col("drops").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(without("lines", "drops"), "\n"))
    return joined.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), cut.alias("kept"))


def filter_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its text cut; null texts stay null where nothing was cut."""
    kept = dedup_lines(docs, text_col=text_col, **options)
    fields = [F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return kept.select(*fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
