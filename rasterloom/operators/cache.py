"""A cache of results by content key: segments of Parquet, and versions that name them.

A version is one small file that lists the segments it consists of.  It is written under a
name of its own and renamed to the next number, unless that number exists: so a reader sees
a whole version or none, a crash leaves at most a segment that no version names, and of two
writers one has to look again (where a store's rename replaces files, writers take turns).  Keys are added only if absent; when segments
become many they are rewritten as one, and the keys used longest ago beyond a bound go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ResultCache:
    """Rows (key, used, *columns) under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, columns: str, most_segments: int = 8, most_rows: int | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"key string, used long, {columns}"
        self.most_segments, self.most_rows = most_segments, most_rows

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        files, at = self._files(), self._path("versions")
        if not files.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def segments(self, version: int) -> list[str]:
        if not version:
            return []
        return [r["value"] for r in self.spark.read.text(f"{self.root}/versions/{version}").collect() if r["value"]]

    def read(self, version: int | None = None) -> DataFrame:
        names = self.segments(self.version() if version is None else version)
        paths = [f"{self.root}/segments/{n}" for n in names]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _segment(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/segments/{name}")
        return name

    def _commit(self, version: int, names: list[str]) -> bool:
        """Make ``names`` version ``version``; false if another writer was first."""
        files, own, to = self._files(), self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version}")
        out = files.create(own, True)
        out.write(bytearray("\n".join(names) + "\n", "utf-8"))
        out.close()
        if not files.exists(to) and files.rename(own, to):
            return True
        files.delete(own, False)
        return False

    def add(self, rows: DataFrame, now: int, tries: int = 5) -> int:
        """Add (key, *columns) of keys that are absent, the least row of each; the version that holds them."""
        for _ in range(tries):
            version = self.version()
            names = self.segments(version)
            columns = [c for c in rows.columns if c != "key"]
            fresh = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(*columns)).alias("r")).select("key", F.lit(now).cast("long").alias("used"), "r.*")
            fresh = fresh.join(self.read(version).select("key"), "key", "left_anti")
            names = [*names, self._segment(fresh.select(*self.read(0).columns))]
            if len(names) > self.most_segments:
                names = [self._segment(self._kept(names))]
            if self._commit(version + 1, names):
                return version + 1
        raise RuntimeError("other writers were always first")

    def _kept(self, names: list[str]) -> DataFrame:
        """All rows, or the ``most_rows`` used last: a bound on ``used`` first, so that only its ties are ranked."""
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/segments/{n}" for n in names])
        if self.most_rows is None:
            return rows
        times = rows.groupBy("used").agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(W.orderBy(F.desc("used"))))
        whole = times.where(F.col("so_far") <= self.most_rows).agg(F.min("used").alias("least"), F.max("so_far").alias("n")).first()
        ties = times.where(F.col("so_far") > self.most_rows).agg(F.max("used")).first()[0]
        keep = rows.where(F.lit(False)) if whole["least"] is None else rows.where(F.col("used") >= whole["least"])
        room = self.most_rows - (whole["n"] or 0)
        return keep if ties is None or room <= 0 else keep.unionByName(rows.where(F.col("used") == ties).orderBy("key").limit(room))

    def touch(self, keys: DataFrame, now: int) -> int:
        """Note that ``keys`` were used: the cache is rewritten as one segment with the new times."""
        version = self.version()
        hit = keys.select("key").distinct().withColumn("hit", F.lit(True))
        rows = self.read(version).join(hit, "key", "left").withColumn("used", F.when(F.col("hit"), F.greatest("used", F.lit(now))).otherwise(F.col("used"))).drop("hit")
        if not self._commit(version + 1, [self._segment(rows)]):
            return self.touch(keys, now)
        return version + 1

    def through(self, jobs: DataFrame, compute, now: int) -> DataFrame:
        """``jobs`` (key, ..) with their results: ``compute`` gets only the rows whose key is absent, each key once, and what it returns is added; a null key has no result."""
        version = self.version()
        absent = jobs.where("key is not null").join(self.read(version).select("key"), "key", "left_anti").dropDuplicates(["key"])
        if absent.limit(1).count():
            version = self.add(compute(absent), now)
        return jobs.join(self.read(version).drop("used"), "key", "left")

    def sweep(self) -> int:
        """Remove segments that the latest version does not name, and older versions; how many segments went."""
        files, latest = self._files(), self.version()
        named, gone = set(self.segments(latest)), 0
        for s in files.listStatus(self._path("segments")) if files.exists(self._path("segments")) else []:
            if s.getPath().getName() not in named:
                gone += files.delete(s.getPath(), True)
        for s in files.listStatus(self._path("versions")) if latest else []:
            name = s.getPath().getName()
            if not name.isdigit() or int(name) < latest:
                files.delete(s.getPath(), False)
        return gone
