"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes slide over the whole text in steps of 4.  A
text is covered by chunks of 256 bytes that overlap by half.  Wider filters, learned as well,
span a chunk: each weighs how strongly the narrow ones answer on it.  Their answers are
max-pooled over all chunks of the text and combined into one probability.  Nothing but the
bytes enters a score.

The network is fitted on the driver from at most ``max_rows`` labelled texts per class, of a
longer text from windows spread over it that hold ``max_bytes`` together, so that the sample
is bounded at any size of the corpus and at any length of its texts.  Scoring
is one Arrow pass over all texts, without a shuffle; the model is some kilobytes.

Defined cases: null text is scored like an empty one; any length is scored whole; repeated
rows score alike up to the rounding of 32-bit sums; labels with null or several values count once per distinct value; with
labels of one class only every score is that class, without labels 0.5; if labels exist but
none belongs to a document, fitting raises, unless there are no documents; an empty table
gives an empty result; other columns pass, and one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

HOP, STEP, WIDTH, DIMS, FILTERS, HIDDEN = 128, 4, 8, 6, 32, 24
THRESHOLD = 0.7
#: Bytes scored at once; a longer text is scored alone.
BLOCK = 1 << 18


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each padded with zeros to whole hops and by ``WIDTH`` at least, so that none sees another; hops and lengths per text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    hops = -(-(lengths + WIDTH) // HOP)
    data = np.zeros(int(hops.sum()) * HOP, np.uint8)
    at = (np.cumsum(hops) - hops) * HOP
    for t, k, n in zip(texts, at.tolist(), lengths.tolist(), strict=True):
        data[k : k + n] = np.frombuffer(t, np.uint8)
    return data, hops, lengths


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Without overflow at either end."""
    return (1 + np.tanh(x / 2)) / 2


@dataclass
class Net:
    """The parameters; ``prior`` alone is set where labels of both classes are missing."""

    embed: np.ndarray | None = None
    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    hidden: np.ndarray | None = None
    hidden_bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None
    prior: float = 0.5

    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    @staticmethod
    def fresh(seed: int) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return Net(
            f(256, DIMS, scale=0.5), f(STEP * DIMS, 2 * FILTERS, scale=(WIDTH * DIMS) ** -0.5), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, scale=0.3),
            np.full(HIDDEN, 0.05, np.float32), f(HIDDEN, scale=0.2), np.zeros(1, np.float32),
        )

    def _forward(self, data: np.ndarray, hops: np.ndarray, lengths: np.ndarray) -> dict:
        x = self.embed[data].reshape(-1, STEP * DIMS)
        halves = x @ self.filters
        answers = halves[:, :FILTERS] + self.bias
        cut = np.cumsum(hops)[:-1] * (HOP // STEP)  # where a text begins, the filter of the text before ends
        halves[cut, FILTERS:] = 0
        answers[:-1] += halves[1:, FILTERS:]
        np.maximum(answers, 0, out=answers)
        first = np.cumsum(hops) - hops
        per_hop = answers.reshape(-1, HOP // STEP, FILTERS).sum(1)
        chunks = np.maximum(hops - 1, 1)
        begin = np.cumsum(chunks) - chunks
        text = np.repeat(np.arange(len(hops)), chunks)
        left = np.arange(len(text)) - begin[text] + first[text]
        paired = (hops > 1)[text]
        size = np.clip(lengths[text] - (left - first[text]) * HOP, 1, np.where(paired, 2 * HOP, HOP)).astype(np.float32) / STEP
        right = np.where(paired, left + 1, left)
        seen = (per_hop[left] + per_hop[right] * paired[:, None]) / size[:, None]
        z = seen @ self.hidden + self.hidden_bias
        h = np.maximum(z, 0)
        top = np.maximum.reduceat(h, begin, axis=0)
        logit = top @ self.out + self.out_bias[0]
        return {"x": x, "cut": cut, "answers": answers, "left": left, "right": right, "paired": paired, "size": size, "seen": seen, "h": h, "top": top, "text": text, "logit": logit}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.embed is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self._forward(*laid_out(texts))["logit"].astype(np.float64))

    def gradients(self, data: np.ndarray, hops: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        v = self._forward(data, hops, lengths)
        d = ((sigmoid(v["logit"]) - labels) * weights / weights.sum()).astype(np.float32)
        text, h = v["text"], v["h"]
        g = {"out": v["top"].T @ d, "out_bias": d.sum(keepdims=True)}
        at_top = (h == v["top"][text]) & (h > 0)
        dz = at_top * (d[:, None] * self.out)[text]
        g["hidden"], g["hidden_bias"] = v["seen"].T @ dz, dz.sum(0)
        seen = (dz @ self.hidden.T) / v["size"][:, None]
        per_hop = np.zeros((len(data) // HOP, FILTERS), np.float32)
        np.add.at(per_hop, v["left"], seen)
        np.add.at(per_hop, v["right"], seen * v["paired"][:, None])
        da = np.repeat(per_hop, HOP // STEP, axis=0) * (v["answers"] > 0)
        halves = np.zeros((len(da), 2 * FILTERS), np.float32)
        halves[:, :FILTERS], halves[1:, FILTERS:] = da, da[:-1]
        halves[v["cut"], FILTERS:] = 0
        g["bias"], g["filters"] = da.sum(0), v["x"].T @ halves
        dx = (halves @ self.filters.T).reshape(-1, DIMS)
        g["embed"] = np.stack([np.bincount(data, dx[:, k], 256) for k in range(DIMS)], 1).astype(np.float32)
        return g


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, least_steps: int = 700, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on the weighted log loss, for ``least_steps`` steps at least."""
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    s = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    t, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            g = net.gradients(*laid_out([texts[k] for k in pick]), labels[pick], weights[pick])
            t += 1
            lr = rate * (1 - 0.9 * t / steps)
            for n in net.NAMES:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                s[n] = 0.99 * s[n] + 0.01 * g[n] ** 2
                getattr(net, n).__isub__((lr * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.99**t)) + 1e-8)).astype(np.float32))
    return net


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; 0 for a null id."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


#: Windows that stand for a text over the bound.
WINDOWS = 8


def windows(text: Column, max_bytes: int) -> Column:
    """The bytes of a text, or ``WINDOWS`` stretches spread evenly from its first byte to its last."""
    data, size, width = text.cast("binary"), F.octet_length(text), max_bytes // WINDOWS
    parts = [F.substring(data, F.floor((size - width) * k / (WINDOWS - 1)).cast("int") + 1, F.lit(width)) for k in range(WINDOWS)]
    return F.when(size <= max_bytes, data).otherwise(F.concat(*parts))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_bytes: int = 8_000, **options) -> Net:
    """Fit on labelled rows outside the held-out fold: ``max_rows`` per class at most, chosen by a hash of the id.

    Labels are drawn among those of documents that are there, so every drawn row is fitted on.  The driver
    holds 2 * max_rows * max_bytes bytes at most; of several texts with one id the least counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 2)).select("doc_id", "quality").distinct()
    there = C.written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    counts = {r["quality"]: r["count"] for r in there.groupBy("quality").count().collect()}
    if not counts and known.limit(1).count() and docs.limit(1).count():
        raise ValueError("no label belongs to a document: there is nothing to fit on")
    if len(counts) < 2:
        return Net(prior=float(next(iter(counts), 0.5)))
    ranked = [there.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for q in (0, 1)]
    sample = F.broadcast(ranked[0].unionByName(ranked[1]).withColumnRenamed("doc_id", "label_id"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", windows(F.col("text"), max_bytes).alias("data"))
    # repeated rows cannot swell the sample
    rows = found.groupBy("doc_id", "quality").agg(F.min("data").alias("data")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    y = np.array([r["quality"] for r in rows], np.float32)
    weights = np.array([counts[int(q)] / max(1, int((y == q).sum())) for q in y], np.float32)
    weights = np.where(y == 1, weights / max(1.0, counts[1] / counts[0] / 3), weights).astype(np.float32)  # at most three to one
    return fit([bytes(r["data"]) for r in rows], y, weights, **options)


def score(docs: DataFrame, net: Net, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column; one of that name is replaced."""
    if text_col == score_col:
        raise ValueError("the score needs a column of its own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col)).cast(pa.large_binary())
            found, held, size = [], [], 0
            for v in column:
                t = v.as_py() or b""
                if held and size + len(t) > BLOCK:
                    found.append(net.scores(held))
                    held, size = [], 0
                held.append(t)
                size += len(t) + HOP
            if held:
                found.append(net.scores(held))
            kept = [n for n in batch.schema.names if n != score_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(n)) for n in kept], pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*kept, score_col])

    kept = [f for f in docs.schema.fields if f.name != score_col]
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with the columns they came with."""
    net = train(docs, labels)
    scored = score(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), net)
    return scored.where(F.col("score") >= threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
