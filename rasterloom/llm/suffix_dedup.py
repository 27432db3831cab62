"""Exact removal of repeated byte passages by a depth-limited radix sort of suffixes.

Suffixes of all texts are ordered through ``depth`` bytes only, in most-significant-digit
passes; suffixes alone in their group leave after each pass, and groups that are still equal
at full depth are exactly the repeated windows.  A digit is a block of bytes, held as a
64-bit rolling hash.

1. Neighbouring suffixes share their first digit: the ``gram`` bytes at the least gram hash
   within their ``depth`` bytes, a place that depends on those bytes alone.  One row stands
   for such a run of suffixes, so that the first pass shuffles a row for about 130 bytes.
   Runs whose first digit occurs once hold no repeated window and leave.
2. The second digit is all the bytes that a run's windows touch.  Runs that agree on it are
   repeated as they stand, and one of them stands for all in the last pass.
3. Where one first digit has several second ones, the runs are taken apart: each window of
   one run per second digit is hashed at full depth, and those found twice are repeated.

Texts are shuffled by document once; hot passages are counted before the shuffle and joined
to one row per key, which Spark may split.  No group is gathered in one task.

Defined cases: null text is empty; texts under ``depth`` bytes lose nothing; matches never
cross documents; rows with equal id and text are occurrences of their own, so they remove
each other; null ids are allowed; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

DEPTH, GRAM = 400, 128
#: Bytes hashed at once; longer texts are hashed in overlapping parts.
BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


class Rolling:
    """Prefix hashes modulo 2**64: the hash of any slice costs two lookups."""

    def __init__(self):
        self.size = -1

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BLOCK * 2)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.size, b)])) for b in (_BASE, inverse))

    def load(self, data: np.ndarray) -> None:
        self._grow(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.prefix[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[stop] - self.prefix[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return mixed((self.prefix[width:] - self.prefix[:n]) * self.down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def runs_of(rolling: Rolling, data: np.ndarray, ends: np.ndarray, begins: np.ndarray, depth: int, gram: int):
    """Runs of window starts within the texts [begin, end) of ``data``: text number, first start, length, anchor, digits 1 and 2."""
    rolling.load(data)
    grams = rolling.windows(gram)
    marked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(marked, depth - gram + 1) & np.uint64(0xFFFFFFFF)
    counts = np.maximum(ends - begins - depth + 1, 0)
    text = np.repeat(np.arange(len(ends)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    at = least[start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    length = np.diff(np.append(first, len(at)))
    lo, anchor = start[first], at[first].astype(np.int64)
    second = rolling.slices(lo, lo + length - 1 + depth) + (anchor - lo).astype(np.uint64) * _BASE + length.astype(np.uint64)
    return text[first], lo, length, anchor, grams[anchor], mixed(second)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end and their n + 1 offsets; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(offsets: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, start within it or -1, cuts): texts gathered up to BLOCK bytes; long ones alone, in overlapping parts."""
    k, n = 0, len(offsets) - 1
    while k < n:
        j = int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1
        if j > k:
            yield k, -1, offsets[k : j + 1]
            k = j
        else:
            size = int(offsets[k + 1] - offsets[k])
            for at in range(0, max(size - depth + 1, 1), BLOCK):
                yield k, at, np.array([offsets[k] + at, offsets[k] + min(size, at + BLOCK + depth - 1)])
            k += 1


def _columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.names.index(n)) for n in names]


def packed(lo: np.ndarray, seg: np.ndarray, n: np.ndarray) -> pa.Array:
    """A span in one long: first start, its distance from its run's first start, number of starts."""
    return pa.array((lo.astype(np.int64) << 32) | (seg.astype(np.int64) << 16) | n.astype(np.int64))


ROWS = "d1 long, d2 long, place long, ident long, span long, anchor int"


def _rows(one, two, place, ident, lo, seg, n, anchor) -> pa.RecordBatch:
    columns = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), place, ident, packed(lo, seg, n), pa.array(anchor.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "place", "ident", "span", "anchor"])


def _map_runs(depth: int, gram: int):
    """First pass: a row for each run of neighbouring suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            place, ident, texts = _columns(batch, "place", "ident", "text")
            data, offsets = _bytes_of(texts)
            for k, at, cuts in _parts(offsets, depth):
                text, lo, length, anchor, one, two = runs_of(rolling, data[cuts[0] : cuts[-1]], cuts[1:] - cuts[0], cuts[:-1] - cuts[0], depth, gram)
                if len(text):
                    rows = pa.array(text + k)
                    yield _rows(one, two, place.take(rows), ident.take(rows), lo - (cuts[text] - cuts[0]) + max(at, 0), np.zeros(len(lo)), length, anchor - lo)

    return run


def _map_contexts(depth: int):
    """All bytes that the windows of each wanted run touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, ident, texts, wanted = _columns(batch, "place", "ident", "zipped", "wanted")
            for k in range(batch.num_rows):
                text, runs = unzipped(texts[k].as_py()), wanted[k].as_py()
                cut = [text[r["span"] >> 32 : (r["span"] >> 32) + (r["span"] & 0xFFFF) - 1 + depth] for r in runs]
                rows = pa.array(np.full(len(runs), k))
                yield pa.RecordBatch.from_arrays(
                    [place.take(rows), ident.take(rows), pa.array([r["span"] for r in runs], pa.int64()), pa.array([r["anchor"] for r in runs], pa.int32()), pa.array(cut, pa.binary())],
                    names=["place", "ident", "span", "anchor", "bytes"],
                )

    return run


def _map_blocks(depth: int, block: int):
    """Later passes: the runs' windows in blocks aligned to the anchor, a row each.

    The first digit is what all windows of the block share, the second what any of them touches.
    ``blocks``: those wanted, as spans; null: all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                place, ident, spans, anchors, texts, blocks = _columns(batch, "place", "ident", "span", "anchor", "bytes", "blocks")
                lengths = np.array([len(t) for t in texts.to_pylist()])
                begin = np.cumsum(lengths) - lengths
                rolling.load(np.frombuffer(b"".join(texts.to_pylist()), np.uint8))
                span, anchor = spans.to_numpy(zero_copy_only=False), anchors.to_numpy(zero_copy_only=False).astype(np.int64)
                lo, n = span >> 32, span & 0xFFFF
                shift = anchor % block  # blocks begin at these offsets from the first start, plus multiples of block
                k, first, last = [], [], []
                for j, wanted in enumerate(blocks.to_pylist()):
                    if wanted is None:
                        f = np.arange(int(shift[j]) - block if shift[j] else 0, int(n[j]), block)
                    else:
                        got = np.array(sorted({(w >> 16 & 0xFFFF, w & 0xFFFF) for w in wanted}), np.int64)
                        f = np.concatenate([np.arange(a, a + c, block) for a, c in got]) if block == 1 else got[:, 0]
                    k.append(np.full(len(f), j))
                    first.append(f)
                k, first = np.concatenate(k).astype(np.int64), np.concatenate(first).astype(np.int64)
                last = first + block - 1
                real, end = np.maximum(first, 0), np.minimum(last, n[k] - 1)
                one = rolling.slices(begin[k] + last, begin[k] + first + depth) + (first - anchor[k]).astype(np.uint64) * _BASE
                two = rolling.slices(begin[k] + real, begin[k] + end + depth) + (real - anchor[k]).astype(np.uint64) * _BASE + (end - real).astype(np.uint64)
                rows = pa.array(k)
                yield _rows(mixed(one), mixed(two), place.take(rows), ident.take(rows), lo[k] + real, real, end - real + 1, anchor[k] - real)

    return run


def unzipped(data: bytes | None) -> bytes:
    return zstandard.decompress(data) if data else b""


def _map_zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled."""
    zipper = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        at = whole.schema.names.index("text")
        for k in range(0, whole.num_rows, 1024):
            batch = whole.slice(k, 1024)
            columns = list(batch.columns)
            columns[at] = pa.array([zipper.compress(t.encode("utf-8", "surrogatepass")) if t else None for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=["zipped" if n == "text" else n for n in batch.schema.names])


def zipped(df: DataFrame) -> DataFrame:
    fields = [T.StructField("zipped", T.BinaryType()) if f.name == "text" else f for f in df.schema.fields]
    return df.mapInArrow(_map_zipped, T.StructType(fields))


def _map_cut(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [_cut(unzipped(t.as_py()), s.as_py(), depth) for t, s in zip(*_columns(batch, "zipped", "spans"), strict=True)]
                new = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*_columns(batch, "row"), *new], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _cut(text: bytes, spans: list[int] | None, depth: int) -> tuple[int, int, int, bytes]:
    if not spans:
        return len(text), 0, 0, text
    s = np.sort(np.array(spans, np.int64))
    lo, stop = s >> 32, (s >> 32) + (s & 0xFFFF) - 1 + depth
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    begins, ends = lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
    kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)], strict=True))
    return len(text), len(text) - len(kept), len(begins), kept


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose second digit occurs again, one row per second digit where a first digit has several)."""
    first = [F.first(c).alias(c) for c in ("place", "ident", "span", "anchor")]
    classes = C.written(rows.groupBy("d1", "d2").agg(F.count("*").alias("n"), *first), "classes")
    same = rows.join(classes.where("n > 1").select("d1", "d2"), ["d1", "d2"], "left_semi")
    several = C.written(classes.groupBy("d1").agg(F.count("*").alias("kinds")).where("kinds > 1").select("d1"), "several")
    return same, classes.join(several, "d1", "left_semi").drop("n")


def repeats(base: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(place, ident, spans): the starts of all repeated windows, of ``base``'s (place, ident, text)."""
    texts = base.select("place", "ident", "text")
    runs = texts.where(F.octet_length("text") >= depth).mapInArrow(_map_runs(depth, gram), ROWS)
    # written, since Spark splits a hot key only where both sides of a join come straight from a shuffle
    shared = C.written(runs.groupBy("d1").count().where("count > 1").select("d1"), "shared")
    same, apart = split(C.written(runs.join(shared, "d1", "left_semi"), "runs"))

    by_text = ["place", "ident"]
    wanted = apart.groupBy(by_text).agg(F.collect_set(F.struct("span", "anchor")).alias("wanted"))
    kind = "place long, ident long, span long, anchor int, bytes binary"
    contexts = zipped(texts.where(F.octet_length("text") >= depth)).dropDuplicates(by_text).join(wanted, by_text).mapInArrow(_map_contexts(depth), kind)
    contexts = C.written(contexts, "contexts")
    all_blocks = contexts.withColumn("blocks", F.expr("cast(null as array<long>)"))
    same_blocks, open_blocks = split(C.written(all_blocks.mapInArrow(_map_blocks(depth, 16), ROWS), "blocks"))
    run_lo = F.expr("shiftright(span, 32) - (shiftright(span, 16) & 65535)")
    left = open_blocks.groupBy("place", "ident", run_lo.alias("run_lo")).agg(F.collect_list("span").alias("blocks"))
    ends = contexts.withColumn("run_lo", F.expr("shiftright(span, 32)")).join(left, [*by_text, "run_lo"]).drop("run_lo")
    same_windows, _ = split(C.written(ends.mapInArrow(_map_blocks(depth, 1), ROWS), "windows"))
    found = same.select(*by_text, "span").unionByName(same_blocks.select(*by_text, "span")).unionByName(same_windows.select(*by_text, "span"))
    return found.groupBy(by_text).agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """Each row without its text as struct ``row``, with n_bytes, n_removed, n_spans and the kept bytes."""
    if not 16 <= gram <= depth - 16 or depth > 32_000:
        raise ValueError("gram and depth do not fit")
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(*others).alias("row"), C.place(id_col).alias("place"), C.identity(text).alias("ident"), text.alias("text"))
    spans = repeats(base, depth, gram)
    joined = zipped(base).join(spans, ["place", "ident"], "left").select("row", "zipped", "spans")
    schema = T.StructType([joined.schema["row"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_map_cut(depth), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
