"""Exact Jaccard join over word shingles, and its connected components.

A text's set is its distinct 5-word shingles, held as 64-bit hashes.  Texts with equal sets
are one node.  Nodes meet in the inverted lists of their prefixes: the ``n - ceil(t n) + 1``
first shingles in one order for all, the rarest first.  How often a shingle occurs is read from
a sketch: every shingle owns one of at most ``MOST_SLOTS`` counters, which count all occurrences
in all documents.  Shingles that share a counter look more frequent than they are, by about as much
for all; counts only steer the order, and no order loses a link.  So what tasks hold of the
counts is bounded, and the order still tells apart all that occur more often than most.

Set relations save work at both levels of the join:

* index: each list is sorted by set size and cut into blocks where the sizes are too far
  apart to match, and lists with the same members are one list that counts several times.
  From these counts follows how many prefix shingles two sets share at most, and pairs whose
  sets cannot overlap enough are skipped by that position bound.
* answers: the members of a long list are not paired out.  They form a family around one
  member, the hub, which is compared with all others on whole texts.  The answer for a member
  is its difference from the hub: shingles it lacks and shingles it adds.  Members linked with
  the hub are near and connected by it.  Far members meet all members of their family: blocks of
  ``BLOCK_ROWS`` members, in which every member is held once, are streamed past by the far
  ones, and overlaps follow from the differences alone, without texts.

So a family of n members, f of them far, travels as n + f n / ``BLOCK_ROWS`` rows of differences:
in proportion to its size where all are near.  Pairs of short lists that stay are compared on
whole texts.  No list, group or link set is gathered on the driver or in one task: lists over
``SHORT`` members travel as rows, and a task holds one block.

Defined cases: null and blank texts have an empty set and are linked with nothing; texts of
1 to 4 words have one shingle; null ids count as one id after all others, their component is
null where it has no other; repeated rows share a node; an empty table gives an empty
result; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .suffix_dedup import BLOCK, Rolling, _bytes_of, _columns, mixed, unzipped, zipped

WIDTH, NUM, DEN = 5, 3, 4  # linked when intersection / union >= NUM / DEN
SHORT = 64
#: Counters of the sketch at most (a byte each once they are ranked, which is broadcast), and how many are one row.
MOST_SLOTS, SLOT_ROW = 2**23, 2**16
#: Ranks up to here are counts above those that any counter has; beyond, six ranks double the count.
EXACT_RANKS = 128
#: Shingles counted at once in a task; names of sets that a task remembers.
COUNTED, REMEMBERED = 1_000_000, 200_000
#: Members of a family that a task holds at once.
BLOCK_ROWS = 512
_M = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingles(rolling: Rolling, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts end to end in ``data``, and how many each text has."""
    texts = len(offsets) - 1
    data = _LOWER[data]
    rolling.load(data)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    stop = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) + 1 if len(data) else start
    words = mixed(rolling.slices(start, stop) + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, offsets[:-1])
    n = np.diff(np.append(first, len(start)))
    counts = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(texts), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[text]
    width = np.minimum(n[text], WIDTH)
    h = width.astype(np.uint64)
    for k in range(WIDTH):
        more = k < width
        h = np.where(more, mixed(h * _M + words[np.minimum(at + k, len(words) - 1)]), h) if len(h) else h
    return h, counts


def sets_of(rolling: Rolling, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted shingle sets of the texts, in blocks: (first row, sets)."""
    data, offsets = _bytes_of(column)
    k, n = 0, len(offsets) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
        h, counts = shingles(rolling, data[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k])
        out, at = [], 0
        for c in counts.tolist():
            s = h[at : at + c]
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if c else s)
            at += c
        yield k, out
        k = j


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A node's name: 64 bits of its set; 0 for the empty set."""
    n = np.array([len(s) for s in sets])
    full = np.flatnonzero(n)
    out = np.zeros(len(sets), np.uint64)
    if len(full):
        joined = np.concatenate([sets[k] for k in full])
        sums = np.add.reduceat(mixed(joined * _M), np.cumsum(n[full]) - n[full])
        out[full] = mixed(sums + n[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _map_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        place, ident, texts = _columns(batch, "place", "ident", "text")
        for k, sets in sets_of(rolling, texts):
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([place.slice(k, len(sets)), ident.slice(k, len(sets)), pa.array(_names(sets)), n], names=["place", "ident", "node", "n"])


def _map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, count) within blocks of shingles, so that copies within a task are shuffled once."""
    rolling, held, size = Rolling(), [], 0

    def counted() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "count"])

    for batch in batches:
        for _, sets in sets_of(rolling, _columns(batch, "text")[0]):
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def slots_for(total: int) -> int:
    """Counters for so many occurrences: a power of two, one an occurrence while the bound allows it."""
    return min(MOST_SLOTS, max(1024, 1 << max(total - 1, 0).bit_length()))


def _slot(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(65 - slots.bit_length())).view(np.int64)


def _map_sketch(slots: int):
    """(part, width, packed): the counters of a task's shingles, zipped, each in as many bytes as its row needs.

    A task counts up to 65,535, which is far beyond the counts that need telling apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(slots, np.uint16)
        for whole in _map_counts(batches):
            for k in range(0, whole.num_rows, COUNTED // 8):
                counted = whole.slice(k, COUNTED // 8)
                at = _slot(counted.column(0).to_numpy(), slots)  # sorted as unsigned numbers, so slots come in order
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                at = at[first]
                counters[at] = np.minimum(counters[at] + np.add.reduceat(counted.column(1).to_numpy(), first), 2**16 - 1)
        for part in range(-(-slots // SLOT_ROW)):
            own = counters[part * SLOT_ROW : (part + 1) * SLOT_ROW]
            most = int(own.max())
            if most:
                kind = np.uint8 if most < 2**8 else np.uint16
                packed = pa.compress(own.astype(kind).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "packed": pa.array([packed], pa.binary())})

    return run


def _map_ranks(slots: int, total: int):
    """(part, ranks) of all counters, a byte each; the rows of a part are in one task."""
    length, mean = min(slots, SLOT_ROW), total / slots
    base = max(0, int(mean - 4 * mean**0.5))  # what a counter has from strangers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, width, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(pa.decompress(packed, length * width, codec="zstd", asbytes=True), f"u{width}")
                sums[part] = sums[part] + own if part in sums else own.astype(np.uint32)
        for part, count in sums.items():
            above = np.maximum(count, np.uint64(base)) - np.uint64(base)
            coarse = EXACT_RANKS + 6 * np.log2(np.maximum(above, np.uint64(EXACT_RANKS)) / EXACT_RANKS)
            ranks = np.minimum(np.where(above < EXACT_RANKS, above, coarse), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    return run


def _map_prefixes(ranks):
    """(token, node, n) for the prefix of each set, by rank and hash; a set met before in the task is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        rolling, seen = Rolling(), set()
        for batch in batches:
            for _, sets in sets_of(rolling, _columns(batch, "text")[0]):
                tokens, nodes, sizes = [], [], []
                for s, name in zip(sets, _names(sets).tolist(), strict=True):
                    if not name or name in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()  # a set that comes again is passed over in its lists
                    seen.add(name)
                    n = len(s)
                    # sets are sorted by hash, and the sort is stable
                    s = s[np.argsort(rank[_slot(s, len(rank))], kind="stable")[: n + (-NUM * n // DEN) + 1]]
                    tokens.append(s)
                    nodes.append(name)
                    sizes.append((len(s), n))
                if tokens:
                    count = [c for c, _ in sizes]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), count)), pa.array(np.repeat(np.array([n for _, n in sizes], np.int64), count))],
                        names=["token", "node", "n"],
                    )

    return run


def _map_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and size, into blocks of nodes whose sizes may match: (list, members, sizes, long).

    Short blocks are one row with all members.  A long block is many rows, each with one
    member; its name is its token and first size.  Members of a block are gathered only up
    to ``SHORT``; beyond, they stream.
    """

    def flush(out):
        names = ["list", "first", "members", "sizes", "is_long"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    token = size = node = first = None
    held: list[tuple[int, int]] = []  # the block so far, while it is short
    long, out = False, []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(3)]
        # single rows leave at once: those whose neighbours have other tokens
        t = columns[0]
        alone = np.ones(len(t), bool)
        alone[1:] &= t[1:] != t[:-1]
        alone[:-1] &= t[1:] != t[:-1]
        alone[[0, -1]] = False  # may go on in the next batch
        for a, b, n in zip(*[c[~alone].tolist() for c in columns], strict=True):
            if a != token or DEN * size < NUM * n:
                if len(held) > 1 and not long:
                    out.append(_short(held))
                token, first, held, long = a, n, [], False
            elif b == node:
                continue  # the same set from another task
            size, node = n, b
            if long:
                out.append((token, first, [b], [n], True))
            else:
                held.append((b, n))
                if len(held) > SHORT:
                    out += [(token, first, [x], [s], True) for x, s in held]
                    held, long = [], True
            if len(out) >= 20_000:
                yield flush(out)
                out = []
    if len(held) > 1 and not long:
        out.append(_short(held))
    if out:
        yield flush(out)


def _short(held: list[tuple[int, int]]) -> tuple:
    members = sorted(held)
    name = np.array([m for m, _ in members], np.int64).view(np.uint64)
    one = int(mixed(np.cumsum(mixed(name * _M)))[-1].view(np.int64))
    return one, len(members), [m for m, _ in members], [n for _, n in members], False


def _bound(a: str, b: str) -> str:
    """Least overlap of sets of these sizes that are linked: t / (1 + t) of their sum, rounded up."""
    return f"(({a} + {b}) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}"


def _map_compared(differences: bool):
    """Exact intersections of the pairs' whole texts; on demand what b lacks of a, as places, and what it adds."""
    names = ["a", "b", "common", "na", "nb", *(["lacks", "adds"] if differences else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, last, last_set = Rolling(), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                a, b, za, zb = _columns(batch, "a", "b", "za", "zb")
                left = a.to_pylist()
                fresh = [k for k in range(len(left)) if left[k] != (left[k - 1] if k else last)]
                texts = pa.array([unzipped(za[k].as_py()) for k in fresh] + [unzipped(z.as_py()) for z in zb], pa.large_binary()).cast(pa.large_string())
                sets = [s for _, block in sets_of(rolling, texts) for s in block]
                of_a, of_b, start = iter(sets[: len(fresh)]), sets[len(fresh) :], set(fresh)
                common, na, nb, lacks, adds = [], [], [], [], []
                for k, y in enumerate(of_b):
                    if k in start:
                        last_set = next(of_a)
                    place = np.minimum(np.searchsorted(last_set, y), len(last_set) - 1)
                    both = last_set[place] == y
                    common.append(int(both.sum()))
                    na.append(len(last_set))
                    nb.append(len(y))
                    if differences:
                        there = np.ones(len(last_set), bool)
                        there[place[both]] = False
                        lacks.append(np.flatnonzero(there).astype(np.int32))
                        adds.append(y[~both].view(np.int64))
                last = left[-1]
                columns = [a, b, *[pa.array(c, pa.int64()) for c in (common, na, nb)]]
                if differences:
                    columns += [pa.array(lacks, pa.list_(pa.int32())), pa.array(adds, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


LINKED = f"{DEN} * common >= {NUM} * (na + nb - common)"
MEMBER = ("a", "block", "streams", "node", "n", "common", "na", "near", "lacks", "adds")


def _overlaps(rows: list[dict], others: list[dict]) -> np.ndarray:
    """Overlaps of the sets of two lists of members, from their differences from a common hub."""
    out = (np.array([m["common"] for m in rows])[:, None] + np.array([m["common"] for m in others]) - rows[0]["na"]).astype(np.float64)
    for side in ("lacks", "adds"):  # what both lack counts back, what both add counts too
        (ta, ra), (tb, rb) = ((np.concatenate([m[side] for m in ms]), np.repeat(np.arange(len(ms)), [len(m[side]) for m in ms])) for ms in (rows, others))
        shared = np.intersect1d(ta, tb)
        ka, kb = np.isin(ta, shared), np.isin(tb, shared)
        ra, ca, rb, cb = ra[ka], np.searchsorted(shared, ta[ka]), rb[kb], np.searchsorted(shared, tb[kb])
        for at in range(0, len(shared), 4096):
            p, q = np.zeros((len(rows), 4096), np.float32), np.zeros((len(others), 4096), np.float32)
            ia, ib = (ca >= at) & (ca < at + 4096), (cb >= at) & (cb < at + 4096)
            p[ra[ia], ca[ia] - at] = 1
            q[rb[ib], cb[ib] - at] = 1
            out += p @ q.T
    return out


def _map_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of far members; rows come by family and block, the block's members before the far ones that stream past.

    Of the links within a block those are left out that connect what others there connect.
    """
    key, held, parent = None, [], {0: 0}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for whole in batches:
        made = []
        for at in range(0, whole.num_rows, 256):
            part = whole.slice(at, 256)
            lists = [map(np.array, part.column(MEMBER.index(c)).to_pylist()) for c in ("lacks", "adds")]
            rows = [dict(zip(MEMBER, r, strict=True)) for r in zip(*(part.column(k).to_pylist() for k in range(len(MEMBER) - 2)), *lists, strict=True)]
            far: list[dict] = []
            for k, r in enumerate(rows):
                if (r["a"], r["block"]) != key:
                    key, held, parent = (r["a"], r["block"]), [], {0: 0}
                (far if r["streams"] else held).append(r)
                if not r["streams"]:
                    parent[r["node"]] = 0 if r["near"] else r["node"]  # 0 stands for the hub; no node is named 0
                last = k + 1 == len(rows) or (rows[k + 1]["a"], rows[k + 1]["block"]) != key
                if last and far:
                    both = _overlaps(far, held)
                    sizes = np.array([m["n"] for m in far])[:, None] + np.array([m["n"] for m in held])
                    for i, j in zip(*np.nonzero((NUM + DEN) * both >= NUM * sizes), strict=True):
                        x, y = far[i]["node"], held[j]["node"]
                        if find(x) != find(y):
                            parent[find(x)] = find(y)
                            made.append((x, y))
                    far = []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], names=["a", "b"])


class Join:
    """The links between the different sets of (place, ident, text)."""

    def __init__(self, base: DataFrame):
        self.base = base.select("place", "ident", "text")
        self.rows = C.written(self.base.mapInArrow(_map_nodes, "place long, ident long, node long, n long"), "nodes")
        self._texts: DataFrame | None = None

    def ranks(self) -> np.ndarray:
        """The rank of each counter of the sketch over all documents."""
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        slots = slots_for(total)
        parts = self.base.select("text").mapInArrow(_map_sketch(slots), "part int, width int, packed binary")
        found = parts.repartition("part").mapInArrow(_map_ranks(slots, total), "part int, ranks binary").toArrow()  # a byte a counter
        out = np.zeros((-(-slots // SLOT_ROW), min(slots, SLOT_ROW)), np.uint8)
        for part, ranks in zip(found.column(0).to_pylist(), found.column(1), strict=True):
            out[part] = np.frombuffer(ranks.as_buffer(), np.uint8)
        return out.reshape(-1)

    def lists(self) -> DataFrame:
        ranks = self.base.sparkSession.sparkContext.broadcast(self.ranks())
        prefixes = self.base.select("text").mapInArrow(_map_prefixes(ranks), "token long, node long, n long")
        met = prefixes.repartition("token").sortWithinPartitions("token", "n", "node")
        return met.mapInArrow(_map_lists, "list long, first long, members array<long>, sizes array<long>, is_long boolean")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, zipped) of the wanted nodes, one text each."""
        # copies are counted down to one row per node and task before they are shuffled
        one = self.rows.groupBy("node").agg(F.min(F.struct("place", "ident")).alias("p")).select("node", "p.place", "p.ident").join(nodes.distinct(), "node", "left_semi")
        return zipped(self.base).join(one, ["place", "ident"]).select("node", "zipped").dropDuplicates(["node"])

    def compare(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """(a, b, common, na, nb) of pairs (a, b), and the differences on demand."""
        t = self._texts
        both = pairs.join(t.select(F.col("node").alias("b"), F.col("zipped").alias("zb")), "b")
        both = C.written(both, "half") if differences else both  # so that Spark can split a hub with many members
        both = both.join(t.select(F.col("node").alias("a"), F.col("zipped").alias("za")), "a")
        kind = "a long, b long, common long, na long, nb long" + (", lacks array<int>, adds array<long>" if differences else "")
        return both.select("a", "b", "za", "zb").mapInArrow(_map_compared(differences), kind)

    def links(self) -> DataFrame:
        """(a, b) of linked nodes that connect all that any links connect."""
        found = C.written(self.lists(), "lists")
        short = found.where("not is_long").groupBy("list", "first").agg(F.count("*").alias("times"), F.first("members").alias("members"), F.first("sizes").alias("sizes"))
        long = C.written(found.where("is_long").select("list", "first", F.col("members")[0].alias("node"), F.col("sizes")[0].alias("n")), "long")
        pairs = short.select("times", F.posexplode("members").alias("i", "a"), "members", "sizes").withColumn("na", F.col("sizes")[F.col("i")])
        pairs = pairs.select("times", "a", "na", F.explode(F.expr("slice(arrays_zip(members, sizes), i + 2, size(members))")).alias("o")).select("times", "a", "na", F.col("o.members").alias("b"), F.col("o.sizes").alias("nb"))
        pairs = pairs.where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)").groupBy("a", "b").agg(F.sum("times").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        # shingles in long lists were not counted: at most as many as either has there
        extra = C.written(long.groupBy("node").agg(F.count("*").alias("extra")), "extra")
        for x in "ab":
            pairs = pairs.join(extra.select(F.col("node").alias(x), F.col("extra").alias(f"extra_{x}")), x, "left")
        most = f"common + least(coalesce(extra_a, 0), coalesce(extra_b, 0)) + greatest(({NUM} * na + {DEN - 1}) div {DEN}, ({NUM} * nb + {DEN - 1}) div {DEN}) - 1"
        pairs = C.written(pairs.where(f"{most} >= {_bound('na', 'nb')}").select("a", "b"), "pairs")
        some = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(long.select("node"))
        self._texts = C.written(self.texts(some), "texts")
        linked = self.compare(pairs).where(LINKED).select("a", "b")
        return C.written(linked.unionByName(self.family_links(long, extra)), "links")

    def family_links(self, long: DataFrame, degree: DataFrame) -> DataFrame:
        """Links between members of long lists.  A list's hub is its member in most long lists, as an original is among its copies."""
        hubs = long.join(degree, "node").groupBy("list", "first").agg(F.max(F.struct("extra", "node")).alias("h")).select("list", "first", F.col("h.node").alias("hub"))
        pairs = long.join(hubs, ["list", "first"]).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        seen = C.written(self.compare(pairs, differences=True).withColumn("near", F.expr(LINKED)), "families")
        size = seen.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"), F.min("near").alias("all_near"))
        size = C.written(size.where("not all_near").drop("all_near"), "family-sizes")
        member = seen.join(size, "a").select("a", F.col("b").alias("node"), F.col("nb").alias("n"), "common", "na", "near", "lacks", "adds", "blocks")
        held = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("streams", F.lit(False))
        far = member.where("not near").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("streams", F.lit(True))
        met = held.select(*MEMBER).unionByName(far.select(*MEMBER)).repartition("a", "block").sortWithinPartitions("a", "block", "streams")
        return seen.where("near").select("a", "b").unionByName(met.mapInArrow(_map_family, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with place, ident, n_shingles, root and first.

    ``root`` names the component, null for empty sets; ``first`` is the least (place, ident) in
    it, or the row's own.
    """
    base = docs.select(F.struct("*").alias("row"), C.place(id_col).alias("place"), F.col(text_col).alias("text")).withColumn("ident", C.identity(F.col("text")))
    join = Join(base)
    roots = components(join.links())
    nodes = join.rows.where("n > 0").groupBy("node").agg(F.min(F.struct("place", "ident")).alias("first"))
    # written, so that Spark can split a component with many nodes when it is joined
    joined = C.written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    first = C.written(joined.groupBy("root").agg(F.min("first").alias("first")), "first")
    answer = C.written(joined.drop("first").join(first, "root").select("node", "root", "first"), "components")
    rows = join.rows.dropDuplicates(["place", "ident"]).join(answer, "node", "left")
    rows = rows.select("place", "ident", "n", "root", F.coalesce("first", F.struct("place", "ident")).alias("first"))
    slim = base.select("row", "place", "ident")
    return slim.join(rows, ["place", "ident"]).select("row", "place", "ident", F.col("n").alias("n_shingles"), "root", "first")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one of the least id, nulls last; of several texts under that id, one.

    Rows without words are linked with nothing and all stay.  Rows are told apart by their
    components, never by their ids: unrelated rows that share an id, or have none, all stay.
    """
    found = near_duplicates(docs)
    empty = found.where("n_shingles = 0")
    # one of the rows that are their component's first: they share place and ident, by which they are dealt already
    full = found.where("n_shingles > 0 and first.place = place and first.ident = ident").dropDuplicates(["place", "ident"])
    return full.select("row.*").unionByName(empty.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_shingles", F.when(F.col("first.place") < C.LAST, F.col("first.place")).alias("component_id"))
