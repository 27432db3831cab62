"""Reports, configuration and meshes read back as relations."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON reports; a broken file gives nulls, as an empty report."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)


def simple_config(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of a two-level ``key: value`` file; comments and quotes go."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("no", "line"))
    bare = lines.withColumn("line", F.regexp_replace("line", r"(^|\s)#.*$", "")).where(F.trim("line") != "")
    parts = bare.select("no", (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), F.regexp_extract("line", r"^\s*([^:]+?)\s*:", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)), "^['\"]|['\"]$", "").alias("value"))
    from pyspark.sql import Window as W

    section = F.last(F.when(F.col("indent") == 0, F.col("key")), ignorenulls=True).over(W.orderBy("no"))  # one short file
    return parts.withColumn("section", section).where("indent > 0").select("section", "key", "value")


def typed(value) -> dict:
    """A scalar of a configuration in each type it can have."""
    return {"as_int": value.try_cast("bigint"), "as_double": value.try_cast("double"), "as_bool": F.when(F.lower(value).isin("true", "yes", "on"), True).when(F.lower(value).isin("false", "no", "off"), False), "as_string": value}


def stl_faces(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, face, ax, ay, az, bx, ... cz) of binary STL files."""
    return stl_content_faces(spark.read.format("binaryFile").load(path))


def stl_content_faces(files: DataFrame) -> DataFrame:
    """As :func:`stl_faces`, of (path, content)."""
    files = files.select(F.regexp_extract("path", r"([^/]+)\.stl$", 1).alias("image_id"), "content")
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(struct.unpack_from("<I", content, 80)[0], (len(content) - 84) // 50) if len(content) >= 84 else 0
                rows = np.frombuffer(content, np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("tag", "<u2")]), n, 84)["v"].astype(np.float64) if n else np.zeros((0, 9))
                yield pa.RecordBatch.from_arrays([pa.array([image] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(rows[:, k]) for k in range(9)]], names=["image_id", "face", *names])

    return files.mapInArrow(run, "image_id string, face int, " + ", ".join(f"{n} double" for n in names))


def stl_report(faces: DataFrame, places: int = 6) -> DataFrame:
    """(image_id, faces, edges, open_edges, overused_edges, watertight, bounds): vertices alike to ``places`` are one."""
    point = lambda p: F.struct(*[F.round(f"{p}{c}", places).alias(c) for c in "xyz"])
    f = faces.select("image_id", point("a").alias("a"), point("b").alias("b"), point("c").alias("c"))
    sides = F.array(*[F.struct(F.least(u, v).alias("p"), F.greatest(u, v).alias("q")) for u, v in ("ab", "bc", "ca")])
    used = f.select("image_id", F.explode(sides).alias("e")).groupBy("image_id", "e.p", "e.q").agg(F.count("*").alias("n"))
    edges = used.groupBy("image_id").agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if(F.col("n") > 2).alias("overused_edges"), F.min(F.col("n") == 2).alias("watertight"))
    corners = f.select("image_id", F.explode(F.array("a", "b", "c")).alias("p"))
    size = corners.groupBy("image_id").agg(*[g(f"p.{c}").alias(f"{g.__name__}_{c}") for g in (F.min, F.max) for c in "xyz"])
    return f.groupBy("image_id").agg(F.count("*").alias("faces")).join(edges, "image_id").join(size, "image_id")
