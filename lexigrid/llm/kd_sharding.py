"""Sharding by a k-d tree over document metadata.

The tree splits at weighted medians (weight = bytes) along the dimension that is
widest in the node, until every leaf holds its share of the bytes. A split value
is found by distributed selection: every pass sums bytes into value bins of all
nodes at once and narrows each node's value range to the bin that holds the
median, so the driver sees at most ``BINS`` sums a pass, whatever the input.
Rows that tie on the split dimension are ordered by a hash of the text (equal
texts stay side by side) and then by a hash of the id, so that a single hot value
can still be cut in two.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, gapless_index, located, stored_index, table, text_bytes

#: Bins of one selection pass over all nodes of a level.
BINS = 65_536
#: Most leaves of a tree; the split table of a level has at most as many rows.
MAX_LEAVES = 4096
#: A cut may miss its target by this share of a leaf.
TOLERANCE = 0.0005
#: Metadata dimensions of ``documents``, as whole numbers. Categories lie at their crc32.
DIMENSIONS = ("dim_chars", "dim_source", "dim_lang", "dim_id")
N_SHARDS = 8


@dataclass
class _Node:
    """A node whose split is being looked for. Keys are the split dimension, the text hash, the id hash."""

    leaves: int
    first: int
    weight: int
    dim: int
    bounds: list[tuple[int, int]]
    level: int = 0
    lo: int = 0
    hi: int = 0
    below: int = 0
    fixed: list[int] = field(default_factory=list)
    cut: tuple | None = None

    @property
    def target(self) -> float:
        return self.weight * (self.leaves // 2) / self.leaves


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(f'CAST({x} AS BIGINT)' for x in r) + ')' for r in rows)}) AS v({names})"


def _with_params(spark: SparkSession, points: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """``points`` joined with a row for each node: at most MAX_LEAVES rows, so the broadcast is bounded."""
    return points.join(F.broadcast(spark.sql(f"SELECT * FROM {_values(rows, names)}")), "node")


def _pick(node: _Node, sums: list[tuple[int, int]], width: int, tolerance: float) -> None:
    """Narrow the node to the bin that holds its target, or set its cut."""
    running = node.below
    for at, weight in sorted(sums):
        lo, hi = node.lo + at * width, min(node.lo + (at + 1) * width - 1, node.hi)
        if running + weight < node.target:
            running += weight
            continue
        over, under = running + weight - node.target, node.target - running
        if under <= tolerance or (over > tolerance and lo == hi and node.level == 2 and under <= over):
            node.cut = (*node.fixed, lo)  # this bin and all above go right
        elif over <= tolerance or (lo == hi and node.level == 2):
            node.cut = (*node.fixed, hi + 1)  # this bin still goes left
        else:
            node.below = running
            node.lo, node.hi = lo, hi
            if lo == hi:  # all rows of the bin tie: go on among them with the next key
                node.fixed.append(lo)
                node.level += 1
                node.lo, node.hi = -(2**63), 2**63 - 1
        return
    node.cut = (*node.fixed, node.hi + 1)


def _choose_cuts(spark: SparkSession, points: DataFrame, nodes: dict[int, _Node], leaf_weight: float) -> None:
    bins = max(16, BINS // max(1, len(nodes)))
    open_nodes = dict(nodes)
    while open_nodes:
        rows, widths = [], {}
        for i, n in open_nodes.items():
            widths[i] = max(1, -(-(n.hi - n.lo + 1) // bins))
            pad = (n.fixed + [0, 0])[:2]
            rows.append((i, n.dim, n.level, n.lo, n.hi, widths[i], *pad))
        at = _with_params(spark, points, rows, "node, dim, level, lo, hi, width, fix0, fix1")
        key = F.element_at(F.array(*DIMENSIONS), (F.col("dim") + 1).cast("int"))
        now = F.when(F.col("level") == 0, key).when(F.col("level") == 1, F.col("tie_text")).otherwise(F.col("tie_id"))
        inside = ((F.col("level") < 1) | (key == F.col("fix0"))) & ((F.col("level") < 2) | (F.col("tie_text") == F.col("fix1"))) & now.between(F.col("lo"), F.col("hi"))
        # decimals: the distance between two hashes may exceed a long
        bin_no = F.floor((now.cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("width").cast("decimal(20,0)")).cast("long")
        sums: dict[int, list[tuple[int, int]]] = {i: [] for i in open_nodes}
        for r in at.filter(inside).groupBy("node", bin_no.alias("bin")).agg(F.sum("size").alias("w")).collect():
            sums[r.node].append((r.bin, r.w))
        for i, n in list(open_nodes.items()):
            _pick(n, sums[i], widths[i], TOLERANCE * leaf_weight)
            if n.cut is not None:
                del open_nodes[i]


def kd_shards(points: DataFrame, n_leaves: int) -> DataFrame:
    """Add ``shard`` (0 to n_leaves - 1) to points (size, DIMENSIONS, tie_text, tie_id); law: near-equal bytes.

    An empty input stays empty; fewer distinct rows than leaves leave some shards empty.
    """
    if not 1 <= n_leaves <= MAX_LEAVES:
        raise ValueError(f"n_leaves must be 1 to {MAX_LEAVES}, not {n_leaves}")
    spark = points.sparkSession
    points = cut(points.withColumn("node", F.lit(0).cast("long")), "kd")
    todo, whole = {0: n_leaves}, None
    first_leaf = {0: 0}
    leaf_of: dict[int, int] = {}
    next_id = 1
    while todo:
        stats = points.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{p}{k}") for k, d in enumerate(DIMENSIONS) for p, f in (("lo", F.min), ("hi", F.max))]).collect()
        whole = whole or [max(1, max(r[f"hi{k}"] for r in stats) - min(r[f"lo{k}"] for r in stats)) for k in range(len(DIMENSIONS))] if stats else [1] * len(DIMENSIONS)
        nodes: dict[int, _Node] = {}
        for r in stats:
            if todo.get(r.node, 1) == 1:
                continue
            bounds = [(r[f"lo{k}"], r[f"hi{k}"]) for k in range(len(DIMENSIONS))]
            dim = max(range(len(DIMENSIONS)), key=lambda k: ((bounds[k][1] - bounds[k][0]) / whole[k], -k))
            nodes[r.node] = _Node(todo[r.node], first_leaf[r.node], r.w, dim, bounds, lo=bounds[dim][0], hi=bounds[dim][1])
        total = sum(r.w for r in stats)
        _choose_cuts(spark, points, nodes, total / n_leaves)
        rows, after = [], {}
        for i in todo:
            if i not in nodes:
                leaf_of[i] = first_leaf[i]
                rows.append((i, 0, 3, 0, 0, 0, i, i))
                continue
            n, left, right = nodes[i], next_id, next_id + 1
            next_id += 2
            first_leaf[left], first_leaf[right] = n.first, n.first + n.leaves // 2
            after[left], after[right] = n.leaves // 2, n.leaves - n.leaves // 2
            c = [min(x, 2**63 - 1) for x in n.cut]
            rows.append((i, n.dim, len(c) - 1, *(c + [0, 0, 0])[:3], left, right))
        kept = [(i, 0, 3, 0, 0, 0, i, i) for i in leaf_of if i not in todo]
        at = _with_params(spark, points, rows + kept, "node, dim, depth, c0, c1, c2, lft, rgt")
        key = F.element_at(F.array(*DIMENSIONS), (F.col("dim") + 1).cast("int"))
        left = (F.col("depth") == 3) | (key < F.col("c0")) | ((F.col("depth") >= 1) & (key == F.col("c0")) & ((F.col("tie_text") < F.col("c1")) | ((F.col("depth") >= 2) & (F.col("tie_text") == F.col("c1")) & (F.col("tie_id") < F.col("c2")))))
        points = at.withColumn("node", F.when(left, F.col("lft")).otherwise(F.col("rgt"))).select(*points.columns)
        todo = {i: n for i, n in after.items() if n > 1}
        leaf_of |= {i: first_leaf[i] for i, n in after.items() if n == 1}
        if todo:
            points = cut(points, "kd")
    return _with_params(spark, points, sorted(leaf_of.items()), "node, shard").withColumn("shard", F.col("shard").cast("int")).drop("node")


def metadata_points(docs: DataFrame, *more: str) -> DataFrame:
    """One narrow row a document: what the tree needs, without the text. Nulls count as 0 or as an empty text."""
    raw = text_bytes(F.col("text"))
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("dim_chars"),
        crc("source").alias("dim_source"),
        crc("lang").alias("dim_lang"),
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("dim_id"),
        F.xxhash64(raw).alias("tie_text"),
        F.xxhash64(F.col("doc_id"), F.lit(5)).alias("tie_id"),
        *more,
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, target_bytes: int | None = None, in_order: bool = False) -> DataFrame:
    """Shards of near-equal bytes for all documents, with a gapless slot in each shard.

    With ``target_bytes`` the number of leaves follows from the total size. With
    ``in_order`` the slots of a shard follow the order in which the files of ``docs``
    hold the rows. A null text has size 1 and crc32 0; a null id or source is a value
    like any other; copies of a row are rows of their own; extra columns are ignored;
    an empty table gives an empty result.
    """
    place = ["_lx_part", "_lx_file", "_lx_at"] if in_order else []
    points = cut(metadata_points(located(docs) if in_order else docs, *place), "kd-points")
    if target_bytes:
        n_shards = max(1, ceil((points.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = cut(kd_shards(points, n_shards).select("doc_id", "size", "text_crc32", "shard", *place), "kd-placed")
    numbered = stored_index(placed, ["shard"], "slot") if in_order else gapless_index(placed, ["shard"], ["text_crc32", "doc_id"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
