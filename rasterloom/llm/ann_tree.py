"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Equal vectors have equal scores and ties go to the smaller id, so of each distinct vector only
the ``k + 1`` least ids can be answers, and equal queries are answered once.  The tree has about
``SPREAD`` times the square root of the rows as leaves, so that leaves and rows per leaf grow
alike.  It is fitted on the driver from at most ``SAMPLE`` vectors (``SAMPLE_VALUES`` numbers),
chosen by a hash of the id; every vector is then filed under a leaf.  A query walks the tree
through a priority queue: the nearest child goes on, its siblings wait, ordered by an upper
bound on the inner product with their region's vectors.  How many leaves to visit is
calibrated: ``PROBES`` queries that the tree was not fitted on are answered exactly against all
rows, and visits widen until their leaves hold ``RECALL`` of the true neighbours.

Neighbouring leaves share a bin of about ``BLOCK_ROWS`` vectors, and a larger leaf is cut into
several bins by a hash, so that a hot leaf is many tasks' work.  A vector goes to one bin, a
query once to every bin of its leaves; a bin's vectors come first, its queries stream past them
in batches, and a window merges the bins' best.  Only the tree, the counts per leaf and the
probes are sent around, all of bounded size.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a query is never its own answer, nor is a row with its
id; rows that share an id answer as one, by their largest score; null ids take no part; ties
go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

K, EVERY = 20, 20
#: Leaves in square roots of the rows; sampled vectors per leaf at least, of all at least and at most, and numbers in them at most.
SPREAD, PER_LEAF, LEAST_SAMPLE, SAMPLE, SAMPLE_VALUES, FAN = 4, 8, 20_000, 200_000, 16_000_000, 32
PROBES, RECALL, BLOCK_ROWS = 200, 0.95, 4096
#: How far a region is taken to reach beyond its centre, in root mean square distances.
REACH = 0.3


@dataclass
class Tree:
    """Nodes in one array: centre, radius, children (first, number) or leaf number."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    width: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``: down the tree by the nearest centre."""
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.width[node] > 0)
            if not len(open_):
                return self.leaf[node]
            for at in np.unique(node[open_]):
                rows = open_[node[open_] == at]
                kids = np.arange(self.first[at], self.first[at] + self.width[at])
                c = self.centres[kids]
                node[rows] = kids[np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, 1)]

    def order(self, q: np.ndarray) -> Iterator[int]:
        """The leaves, best bin first."""
        norm = float(np.sqrt(q @ q))
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            if self.width[node] == 0:
                yield int(self.leaf[node])
                continue
            a, b = self.first[node], self.first[node] + self.width[node]
            bound = self.centres[a:b] @ q + REACH * norm * self.radii[a:b]
            for k in range(a, b):
                heapq.heappush(queue, (-float(bound[k - a]), int(k)))


def _kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[r.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def grow(x: np.ndarray, leaf: int, max_leaves: int, fan: int = FAN, seed: int = 3) -> Tree:
    """Split the largest node until all hold ``leaf`` sampled vectors or fewer, or there are ``max_leaves``.

    A node's radius is the root mean square distance of its vectors to the centre: a typical
    reach, since the farthest vector would make all bounds alike.
    """
    r = np.random.default_rng(seed)
    centres, radii, first, width = [x.mean(0)], [float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()))], [0], [0]
    waiting, n_leaves = [(-len(x), 0, np.arange(len(x)))], 1
    while waiting and n_leaves < max_leaves:
        n, node, rows = heapq.heappop(waiting)
        if -n <= leaf:
            break
        c = _kmeans(x[rows], max(2, min(fan, len(rows) // leaf)), r)
        near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, 1)
        used = np.unique(near)
        if len(used) < 2:
            continue  # all alike: stays a leaf
        first[node], width[node] = len(centres), len(used)
        n_leaves += len(used) - 1
        for j in used:
            mine = rows[near == j]
            centre = x[mine].mean(0)
            heapq.heappush(waiting, (-len(mine), len(centres), mine))
            centres.append(centre)
            radii.append(float(np.sqrt(((x[mine] - centre) ** 2).sum(1).mean())))
            first.append(0)
            width.append(0)
    width_ = np.array(width)
    numbers = np.where(width_ == 0, np.cumsum(width_ == 0) - 1, -1)
    return Tree(np.array(centres), np.array(radii), np.array(first), width_, numbers)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): double vectors that take part; their common length is the most frequent one."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    v = v.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x != 0)")
    lengths = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool = True) -> np.ndarray:
    """Places of the ``k`` largest scores of different ids, ties to the smaller id."""
    if len(scores) > 4 * k and not repeated:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        pool = np.flatnonzero(scores >= cut)
    else:
        pool = np.arange(len(scores))
    order = pool[np.lexsort((ids[pool], -scores[pool]))]
    if repeated:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    order = order[:k]
    return order[scores[order] > -np.inf]


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order whatever the shapes."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += np.multiply.outer(q[:, j], x[:, j])
    return out


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's partial answers."""
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, leaf): exact answers of the probes against all rows, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                own, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                s = q @ matrix(part.column(1)).T
                s[ids[:, None] == own[None, :]] = -np.inf
                out = [(j, _best(own, s[j], k)) for j in range(len(ids))]
                who = np.concatenate([np.full(len(p), ids[j]) for j, p in out])
                at_ = np.concatenate([p for _, p in out])
                sc = np.concatenate([s[j][p] for j, p in out])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(own[at_]), pa.array(sc), pa.array(leaf[at_])], names=["query_id", "vec_id", "score", "leaf"])

    found = rows.select("id", "vec", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf int")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _share(column: str = "id") -> Column:
    """A number in [0, 1) by the hash of the id."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / F.lit(1 << 30)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(id, vec) without repeats, and of each distinct vector the ``most`` least ids; counted down before it is shuffled."""
    order = W.partitionBy("vec").orderBy("id")
    return rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("id", "vec")


class Index:
    """Every usable vector filed under a leaf, and the number of leaves to visit."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL, sample: int = SAMPLE):
        self.k = k
        base = C.written(distinct_vectors(usable(vectors, id_col, vec_col), k + 1), "vectors")
        self.rows = self.tree = None
        n = base.count()
        if not n:
            self.empty = base
            return
        dims = base.select(F.size("vec")).first()[0]
        leaves = max(1, int(SPREAD * n**0.5))
        wanted = min(sample, max(LEAST_SAMPLE, PER_LEAF * leaves), max(1000, SAMPLE_VALUES // dims))
        low = min(0.1, 2 * PROBES / n)
        near = base.where(_share() < low).orderBy(_share(), "id").limit(PROBES).toArrow()
        # the share is cut before rows are ordered, so that a task sends few more than are wanted in all
        chosen = base.where((_share() >= low) & (_share() < low + 1.2 * wanted / n)).orderBy(_share(), "id").limit(wanted).toArrow()
        chosen = chosen if chosen.num_rows else near
        x = matrix(chosen.column("vec").combine_chunks())
        leaves = max(1, min(leaves, len(x) // PER_LEAF))
        self.tree = tree = grow(x, max(1, len(x) // leaves), leaves)

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.file(matrix(b.column(1))) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], names=["id", "vec", "leaf"])

        self.rows = C.written(base.mapInArrow(filed, "id long, vec array<double>, leaf int"), "ann")
        self.sizes = {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}
        probes = (near.column("id").to_numpy(), matrix(near.column("vec").combine_chunks())) if near.num_rows else (np.zeros(0, np.int64), x[:0])
        self.visits, self.calibrated = self._calibrate(*probes, recall)

    def _calibrate(self, ids: np.ndarray, q: np.ndarray, recall: float) -> tuple[int, float]:
        """Least number of leaves that holds ``recall`` of the probes' exact neighbours."""
        orders = {int(i): {leaf: n for n, leaf in enumerate(self.tree.order(v))} for i, v in zip(ids, q, strict=True)}
        if not len(ids):
            return self.tree.leaves, 1.0
        need = sorted(orders[r["query_id"]][r["leaf"]] for r in _exact(self.rows, ids, q, self.k).select("query_id", "leaf").collect())
        if not need:
            return self.tree.leaves, 1.0
        visits = need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1
        return visits, float(np.mean(np.array(need) < visits))

    def search(self, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score) for every usable query."""
        if self.tree is None:
            return self.empty.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        tree, sizes, visits, k = self.tree, self.sizes, self.visits, self.k
        asked = C.written(usable_like(queries, id_col, vec_col, tree.centres.shape[1]).distinct(), "queries")
        keys = C.written(asked.groupBy("vec").agg(F.min("id").alias("id")), "query-keys")
        bins = _bins(sizes)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    rows, to, wanted = [], [], []
                    for j, v in enumerate(matrix(b.column(1))):
                        seen, mine = 0, {}
                        for n, leaf in enumerate(tree.order(v)):
                            if n >= visits and seen > k:
                                break
                            seen += sizes.get(leaf, 0)
                            if leaf in bins:
                                first, number = bins[leaf]
                                for bin_ in range(first, first + number):
                                    mine.setdefault(bin_, []).append(leaf)
                        rows += [j] * len(mine)
                        to += mine
                        wanted += mine.values()
                    at_rows = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at_rows), b.column(1).take(at_rows), pa.array(to, pa.int64()), pa.array(wanted, pa.list_(pa.int32()))], names=["id", "vec", "bin", "leaves"])

        q = keys.select("id", "vec").mapInArrow(routed, "id long, vec array<double>, bin long, leaves array<int>").withColumn("kind", F.lit(1))
        spark = self.rows.sparkSession
        where = spark.createDataFrame([(leaf, first, number) for leaf, (first, number) in bins.items()], "b_leaf int, b_first long, b_number long")  # a row per leaf
        x = self.rows.join(F.broadcast(where), F.col("leaf") == F.col("b_leaf"))
        x = x.select("id", "vec", (F.col("b_first") + F.pmod(F.xxhash64("id"), F.col("b_number"))).alias("bin"), F.array("leaf").alias("leaves"), F.lit(0).alias("kind"))
        met = x.unionByName(q).repartition("bin").sortWithinPartitions("bin", "kind")
        found = C.written(_merge(met.mapInArrow(_answers(k + 1), "query_id long, vec_id long, score double"), k + 1), "answers")
        # back to the queries that share a vector, each without itself
        named = asked.join(keys.withColumnRenamed("id", "key"), "vec").select("id", "key")
        own = named.join(found.withColumnRenamed("query_id", "key"), "key").where("id <> vec_id")
        return _merge(own.select(F.col("id").alias("query_id"), "vec_id", "score"), k)


def _bins(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first bin, number of bins) of each leaf in use."""
    out, bin_, held = {}, 0, 0
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if held and held + n > BLOCK_ROWS:
            bin_, held = bin_ + 1, 0
        number = -(-n // BLOCK_ROWS)
        out[leaf] = (bin_, number)
        if number > 1:
            bin_, held = bin_ + number, 0
        else:
            held += n
    return out


def _answers(k: int):
    """Each bin's best ``k`` for each of its queries; rows come by bin, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_, parts, built = None, [], None
        for batch in batches:
            bins, kinds = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(bins) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bins[a] != bin_:
                    bin_, parts, built = bins[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append((part.column(0).to_numpy(), matrix(part.column(1)), part.column(3).flatten().to_numpy()))
                    continue
                if built is None and parts:
                    built = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    built.append(len(np.unique(built[0])) < len(built[0]))
                for at in range(0, part.num_rows, 128) if built else ():
                    yield _answer(part.slice(at, 128), *built, k)

    return run


def _answer(queries: pa.RecordBatch, own: np.ndarray, xs: np.ndarray, leaf: np.ndarray, repeated: bool, k: int) -> pa.RecordBatch:
    who, qs, wanted = queries.column(0).to_numpy(), matrix(queries.column(1)), queries.column(3)
    by_leaf: dict[int, list[int]] = {}
    for j, leaves in enumerate(wanted.to_pylist()):
        for at in leaves:
            by_leaf.setdefault(at, []).append(j)
    s = np.full((len(who), len(own)), -np.inf)
    for at, rows in by_leaf.items():
        mine = np.flatnonzero(leaf == at)
        if len(mine):
            s[np.ix_(rows, mine)] = _inner(qs[rows], xs[mine])
    best = [_best(own, row, k, repeated) for row in s]
    n = [len(b) for b in best]
    place, row = np.concatenate(best), np.repeat(np.arange(len(who)), n)
    return pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(own[place]), pa.array(s[row, place])], names=["query_id", "vec_id", "score"])


def usable_like(vectors: DataFrame, id_col: str, vec_col: str, length: int) -> DataFrame:
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(f"id is not null and vec is not null and size(vec) = {length}")
    return v.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x != 0)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = Index(vectors).search(vectors.where(F.col("vec_id") % EVERY == 0))
    return found.select("query_id", "rank", "vec_id", "score")
