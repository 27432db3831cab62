"""Files of finished jobs: PNG masks, binary STL, 3MF packages, SVG and reports.

Every sink turns rows into one row per file, (path, content), on the executors; ``save``
writes those to a folder that all executors share.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import trimmed


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    h, w = gray.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 9)) + _chunk(b"IEND", b"")


def mask_files(mask: DataFrame) -> DataFrame:
    """(path, content): one PNG per mask, the mask black on white."""

    def run(table: pa.Table) -> pa.Table:
        y, x, m = (table.column(c).to_numpy() for c in ("y", "x", "m"))
        out = np.full((y.max() + 1, x.max() + 1), 255, np.uint8)
        out[y[m], x[m]] = 0
        return pa.table({"path": [f"{table.column('image_id')[0]}_silhouette.png"], "content": pa.array([png(out)], pa.binary())})

    return mask.select("image_id", "y", "x", "m").groupBy("image_id").applyInArrow(run, "path string, content binary")


def stl_files(triangles: DataFrame) -> DataFrame:
    """(path, content): binary STL of (image_id, ax .. cz), faces in their order of coordinates."""
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]

    def run(table: pa.Table) -> pa.Table:
        v = np.stack([table.column(c).to_numpy() for c in names], 1).astype(np.float32)
        v = v[np.lexsort(v.T[::-1])]
        p = v.reshape(-1, 3, 3)
        normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        size = np.linalg.norm(normal, axis=1, keepdims=True)
        out = np.zeros(len(v), np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("tag", "<u2")]))
        out["normal"], out["v"] = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0), v
        content = b"\0" * 80 + struct.pack("<I", len(v)) + out.tobytes()
        return pa.table({"path": [f"{table.column('image_id')[0]}.stl"], "content": pa.array([content], pa.binary())})

    return triangles.select("image_id", *names).groupBy("image_id").applyInArrow(run, "path string, content binary")


def model_xml(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(image_id, xml): the 3D model part of a package, of (image_id, vid, x, y, z) and (image_id, fid, v1, v2, v3)."""
    v = vertices.select("image_id", "vid", F.concat(F.lit('<vertex x="'), trimmed(F.col("x")), F.lit('" y="'), trimmed(F.col("y")), F.lit('" z="'), trimmed(F.col("z")), F.lit('"/>')).alias("t"))
    f = faces.select("image_id", "fid", F.format_string('<triangle v1="%d" v2="%d" v3="%d"/>', "v1", "v2", "v3").alias("t"))
    joined = lambda d, k: d.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(k, "t")))["t"], "").alias(k))
    head = '<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources><object id="1" type="model"><mesh><vertices>'
    tail = '</triangles></mesh></object></resources><build><item objectid="1"/></build></model>'
    return joined(v, "vid").join(joined(f, "fid"), "image_id").select("image_id", F.concat(F.lit(head), "vid", F.lit("</vertices><triangles>"), "fid", F.lit(tail)).alias("xml"))


#: The parts that every 3MF package holds besides its model.
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
RELATIONSHIPS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>'


def package(parts: dict[str, str]) -> bytes:
    """A zip file with fixed times and order, so that equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def model_files(models: DataFrame) -> DataFrame:
    """(path, content): a 3MF package per (image_id, xml)."""

    def run(batches):
        for b in batches:
            content = [package({"[Content_Types].xml": CONTENT_TYPES, "_rels/.rels": RELATIONSHIPS, "3D/3dmodel.model": xml}) for xml in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.3mf" for i in b.column(0).to_pylist()]), pa.array(content, pa.binary())], names=["path", "content"])

    return models.select(F.col("image_id").cast("string"), "xml").mapInArrow(run, "path string, content binary")


def svg_files(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, content): an SVG per image of its ring paths (image_id, ring, d), evenodd-filled."""
    d = paths.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ring", "d")))["d"], " ").alias("d"))
    text = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('"><path fill-rule="evenodd" d="'), "d", F.lit('"/></svg>\n'))
    return d.join(sizes, "image_id").select(F.concat(F.col("image_id").cast("string"), F.lit(".svg")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def save(files: DataFrame, folder: str) -> None:
    """The files as rows (path, content) of a Parquet table in ``folder``, from which a consumer unpacks them."""
    files.write.mode("overwrite").parquet(folder)
