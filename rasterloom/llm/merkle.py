"""Merkle manifest of a dataset, with a proof for every row by coordinate lookup.

Rows are leaves of one tree per source; the roots of these trees are the leaves of a top
tree, whose root stands for the dataset.  A node has the coordinate (tree, level, index)
and is materialised with the digests of its up to ``GROUP`` children.

* Index: leaves are sorted by range over the cluster, numbered within their part, and moved
  by the sizes of the parts before.  Only part sizes meet in a window.
* Nodes: level by level, runs of ``GROUP`` consecutive indexes become a node; each level is
  written, and the next reads only that.
* Proofs: from an index and the group size alone follow the coordinates of all nodes whose
  children are the siblings.  The leaves of a run need the same coordinates above
  their own level, so each run explodes them once, joins the node table, and orders what it
  finds by level; a leaf then concatenates its siblings and folds its digest upwards.
  Coordinates near a root are asked for by very many runs: nodes are repeated per ``CHUNK``
  runs below them, so that no join key is met by more than CHUNK requests.

Defined cases: null fields are written ``-`` into the leaf; a null source is a tree of its
own, before all others; rows with a null id come last in their tree and are never tampered
with by the query; rows that share source and id are ordered by their leaf, so equal rows
are interchangeable; a lone leaf is its own root and its proof is that of no siblings; an
empty table gives empty tables.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

GROUP, CHUNK = 16, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it enters a leaf: its UTF-8 length, a colon and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _power(group: int, level: Column) -> Column:
    return F.pow(F.lit(float(group)), level).cast("long")


def depth(size: Column, group: int = GROUP) -> Column:
    """Levels above a tree's leaves: how many powers of ``group``, from 1 on, are less than its size."""
    return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: _power(group, k)), lambda p: p < size))


def ranked(rows: DataFrame, tree: str | None, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``idx``, from 0 within each value of ``tree`` (nulls are a tree) by ``order``, and ``size`` of the tree."""
    keyed = rows.withColumn("_tree", F.col(tree) if tree else F.lit(0))
    by = [F.col("_tree").asc_nulls_first(), *order]
    placed = C.written(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranked")
    parts = placed.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.select(F.col("_tree").alias("_t"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("_tree")).alias("size"))
    met = placed.join(spans, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_tree", "_part", "_at", "_first", "_before", "_t", "_p")


def levels(leaves: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, level, idx, children, size) and roots (tree, root) over (tree, idx, size, digest).

    ``size`` stays the number of the tree's leaves.
    """
    spark = leaves.sparkSession
    current = leaves.select("tree", "idx", "size", "digest", F.col("size").alias("left"))
    most = current.agg(F.max("size")).first()[0] or 0
    nodes, roots, level = [], [current.where("left = 1").select("tree", F.col("digest").alias("root"))], 0
    while most > 1:
        level, most = level + 1, -(-most // group)
        runs = current.where("left > 1").groupBy("tree", F.expr(f"idx div {group}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.first("size").alias("size"), F.first("left").alias("left"))
        made = runs.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), F.col("run.digest").alias("children"), "size", F.expr(f"(left + {group - 1}) div {group}").alias("left"))
        made = C.written(made.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"level-{level}")
        nodes.append(made.select("tree", "level", "idx", "children", "size"))
        current = made
        roots.append(current.where("left = 1").select("tree", F.col("digest").alias("root")))
    every = nodes[0] if nodes else spark.createDataFrame([], "tree long, level int, idx long, children array<string>, size long")
    for more in nodes[1:]:
        every = every.unionByName(more)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return every, found


def run_paths(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """(tree, run, path): for each run of leaves the children of the nodes above it, lowest level first."""
    runs = nodes.where("level = 1").select("tree", F.col("idx").alias("run"), "size")
    asked = runs.select("tree", "run", F.explode(F.sequence(F.lit(1), depth(F.col("size"), group))).alias("level"))
    asked = asked.select("tree", "run", "level", F.floor(F.col("run") / _power(group, F.col("level") - 1)).alias("idx"), F.expr(f"run div {CHUNK}").alias("chunk"))
    below = _power(group, F.col("level") - 1)
    last = F.least((F.col("idx") + 1) * below, F.ceil(F.col("size") / group)) - 1
    chunks = F.explode(F.sequence(F.floor(F.col("idx") * below / CHUNK), F.floor(last / CHUNK))).alias("chunk")
    held = nodes.select("tree", "level", "idx", "children", chunks)
    met = asked.join(held, ["tree", "level", "idx", "chunk"])
    ordered = met.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("level", "children"))).alias("found"))
    return ordered.select("tree", "run", F.col("found.children").alias("path"))


def steps(path: Column, idx: Column, group: int = GROUP) -> Column:
    """``path`` with the 1-based place that the leaf ``idx`` has among the children of each node."""
    return F.transform(path, lambda children, k: F.struct(children.alias("children"), (F.floor(idx / _power(group, k)) % group + 1).cast("int").alias("place")))


def _before(step: Column) -> Column:
    return F.slice(step["children"], F.lit(1), step["place"] - 1)


def _after(step: Column) -> Column:
    return F.slice(step["children"], step["place"] + 1, F.size(step["children"]))


def proof_text(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.concat(_before(s), _after(s)))), "")


def folded(path: Column, digest: Column) -> Column:
    """The root that ``digest`` leads to among the siblings of ``path``."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(F.array_join(_before(s), ""), h, F.array_join(_after(s), "")), 256))


@dataclass
class Manifest:
    """Written tables: leaves (tree, idx, size, digest and what rows carry), nodes of all trees, one row per tree with its path to the root."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    group: int

    def proofs(self) -> DataFrame:
        """Leaves with subroot, root and ``path``: an array of (children, place), lowest level first."""
        paths = run_paths(self.nodes, self.group)
        per_chunk = self.group * CHUNK
        # a tree's row is repeated for every so many leaves, so that a hot tree is no hot key
        tops = self.trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {per_chunk}")))).drop("size")
        own = self.leaves.withColumn("run", F.expr(f"idx div {self.group}")).withColumn("part", F.expr(f"idx div {per_chunk}"))
        met = own.join(paths, ["tree", "run"], "left").join(tops, ["tree", "part"])
        none = F.expr("cast(array() as array<array<string>>)")
        path = F.concat(steps(F.coalesce("path", none), F.col("idx"), self.group), steps(F.coalesce("top", none), F.col("tree"), self.group))
        return met.withColumn("path", path).drop("run", "part", "top")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None, group: int = GROUP) -> Manifest:
    """Build the trees over ``docs``; ``carry`` adds columns to the leaves (a digest beside the true one, say)."""
    digest = leaf_digest([F.col(f) for f in fields])
    made = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), C.place(id_col).alias("place"), digest.alias("digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    # written first: sorting by range reads its input twice, and hashing whole texts is the costly part
    placed = C.written(ranked(C.written(made, "leaves"), "source", [F.col("place"), F.col("digest")]), "indexed")
    trees = ranked(placed.groupBy("source").agg(F.first("size").alias("leaves")), None, [F.col("source").asc_nulls_first()])
    trees = C.written(trees.select(F.col("source").alias("_s"), F.col("idx").alias("tree"), F.col("size").alias("trees"), "leaves"), "trees")
    own = [c for c in placed.columns if c not in ("place",)]
    leaves = C.written(placed.join(trees.select("_s", "tree"), F.col("source").eqNullSafe(F.col("_s"))).select("tree", *own), "numbered")
    nodes, roots = levels(leaves, group)
    subroots = C.written(trees.join(roots, "tree"), "subroots")
    top_nodes, top_root = levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("size"), F.col("root").alias("digest")), group)
    top_paths = run_paths(top_nodes, group).select("run", F.col("path").alias("top"))
    above = subroots.withColumn("run", F.expr(f"tree div {group}")).join(top_paths, "run", "left")
    # one row: the root of the dataset
    whole = top_root.select(F.col("root").alias("whole")).first()
    trees = above.select("tree", F.col("leaves").alias("size"), F.col("root").alias("subroot"), F.lit(whole["whole"] if whole else None).cast("string").alias("root"), "top")
    return Manifest(leaves, nodes, C.written(trees, "tops"), group)



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    changed = leaf_digest([*[F.col(f) for f in FIELDS[:-1]], C.ascii_lower(F.col("text"))])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, carry={"changed": F.when(hit, changed)})
    found = made.proofs()
    back = folded(F.col("path"), F.coalesce("changed", "digest"))
    out = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(tree_levels: int = 7, top_levels: int = 4) -> str:
    """Level by level, without coordinates: every leaf carries its digest, its proof and its index upwards."""
    f = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(f.format(c) for c in FIELDS) + ")"
    changed = "sha256(" + " || ".join(f.format(low if c == "text" else c) for c in FIELDS) + ")"
    # CRC-32 by its table of 256 values, made from the polynomial
    parts = [
        "tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)) AS t)",
        "crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), tab)",
        f"l AS (SELECT doc_id, source, {leaf} AS leaf, {changed} AS changed FROM documents)",
        "s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        "n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx, leaf AS h, doc_id, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS fold FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN crc USING (doc_id))",
        "p0 AS (SELECT doc_id, h AS leaf, tree, idx, fold, '' AS proof FROM n0)",
    ]

    def climb(name: str, rows: str, k: int) -> None:
        parts.append(f"{name}{k + 1} AS (SELECT tree, CASE WHEN c > 1 THEN idx // {GROUP} ELSE idx END AS idx, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h FROM (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k}) GROUP BY tree, c, CASE WHEN c > 1 THEN idx // {GROUP} ELSE idx END)")
        parts.append(f"{name}r{k} AS (SELECT *, idx // {GROUP} AS up, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k})")
        parts.append(
            f"{rows}{k + 1} AS (SELECT {{keep}}, p.leaf, p.tree, CASE WHEN any_value(n.c) > 1 THEN p.idx // {GROUP} ELSE p.idx END AS idx, CASE WHEN any_value(n.c) > 1 THEN sha256(string_agg(CASE WHEN n.idx = p.idx THEN p.fold ELSE n.h END, '' ORDER BY n.idx)) ELSE p.fold END AS fold, "
            f"p.proof || coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx <> p.idx), '') AS proof FROM {rows}{k} p JOIN {name}r{k} n ON n.tree = p.tree AND n.up = p.idx // {GROUP} GROUP BY {{by}}, p.leaf, p.tree, p.idx, p.fold, p.proof)".format(keep="p.doc_id" if rows == "p" else "p.doc_id, p.subroot", by="p.doc_id" if rows == "p" else "p.doc_id, p.subroot")
        )

    for k in range(tree_levels):
        climb("n", "p", k)
    parts.append(f"m0 AS (SELECT 0 AS tree, tree AS idx, h FROM n{tree_levels})")
    parts.append(f"q0 AS (SELECT doc_id, leaf, n.h AS subroot, 0 AS tree, p.tree AS idx, fold, proof FROM p{tree_levels} p JOIN n{tree_levels} n USING (tree))")
    for k in range(top_levels):
        climb("m", "q", k)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.h AS verified FROM q{top_levels} JOIN m{top_levels} m USING (tree)"


SQL = _sql()
