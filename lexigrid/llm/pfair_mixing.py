"""Mixing sources to target weights by Pfair scheduling (DataFrame and SQL functions only).

Each source's rows form blocks. When a source runs out, its share goes to the
others in proportion to their weights, so at time v a source should have placed
min(its blocks, v * weight) blocks, and its block k (from 0) should be placed while
that target grows from k to k + 1. The slot in which this begins is the block's
release, the slot after that in which it ends is its deadline. The weights are taken
as they are, as fractions. Together the targets fill one slot after the other, so
earliest deadline first meets every window: no source is ever a whole block off its
target, however many slots there are and whatever runs out. All rows are placed
exactly once.

Slots are cut into *segments* of PERIOD slots. How many blocks of each source a
segment gets is counted on the driver; a SQL fold for each segment, in parallel,
then schedules its blocks by their windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, gapless_index, join_small, located, table

#: Rows of a block, and blocks beyond which blocks get longer: the plan holds a window for each.
BLOCK_ROWS, MOST_BLOCKS = 16, 4_000_000
#: Slots of a segment.
PERIOD = 1024
#: Without target weights, a source with n rows has a weight in proportion to n to this power.
SMOOTHING = 0.5
#: A float this close to a whole number is worked out again as a fraction.
NEAR = 1e-4


def _phases(blocks: Mapping[str, int], weights: Mapping[str, Fraction]) -> list[tuple]:
    """Time, slot and slots a time unit from that time on, for each time at which a source runs out; also as floats."""
    out, v, slot, rate = [], Fraction(0), Fraction(0), sum(weights.values())
    for end, w in sorted((blocks[k] / w, w) for k, w in weights.items()):
        if end > v:
            out.append((v, slot, rate, float(v), float(slot), float(rate)))
            v, slot = end, slot + (end - v) * rate
        rate -= w
    return out


def windows(n: int, weight: Fraction, phases: list[tuple]) -> Iterator[tuple[int, int]]:
    """Release and deadline of each of a source's n blocks."""
    p, release, quick = 0, 0, float(weight)
    for k in range(1, n + 1):
        while p + 1 < len(phases) and phases[p + 1][3] * quick <= k * (1 + 1e-12) and phases[p + 1][0] * weight < k:
            p += 1
        v0, slot0, rate, v, slot, r = phases[p]
        ends = slot + (k / quick - v) * r
        if abs(ends - round(ends)) < NEAR:
            ends = slot0 + (k / weight - v0) * rate
        yield release, ceil(ends)
        release = floor(ends)


def plan_segments(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> Iterator[dict]:
    """Segments in order: first slot, slots, and for each source its first block there and the windows of its blocks."""
    w = {k: Fraction(weights[k]) for k in sorted(blocks) if blocks[k] > 0}
    phases = _phases(blocks, w)
    coming = {k: windows(blocks[k], w[k], phases) for k in w}
    waiting = [(*next(coming[k]), k) for k in w]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    total, done, slot = sum(blocks[k] for k in w), dict.fromkeys(w, 0), 0
    while slot < total:
        end, have = min(slot + period, total), {}
        for t in range(slot, end):
            while waiting and waiting[0][0] <= t:
                release, deadline, k = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, k, release))
            deadline, k, release = heapq.heappop(ready)
            first, own = have.setdefault(k, (done[k], []))
            own.append((release, deadline))
            if done[k] + 1 < blocks[k]:
                heapq.heappush(waiting, (*next(coming[k]), k))
            done[k] += 1
        yield {"slot": slot, "length": end - slot, "sources": have}
        slot = end


def schedule(spark: SparkSession, segments: list[dict]) -> DataFrame:
    """A row for each block: its slot, release and deadline.

    The fold walks the slots of one segment: of the next blocks of all sources, those
    that are released, the one with the earliest deadline is placed (ties: the source's name).
    """
    rows = []
    for n, s in enumerate(segments):
        names = sorted(s["sources"])
        own = [s["sources"][k] for k in names]
        rows.append((n, s["slot"], s["length"], names, [first for first, _ in own], [[r for r, _ in x] for _, x in own], [[d for _, d in x] for _, x in own]))
    longs = pa.list_(pa.int64())
    kinds = {"segment": pa.int32(), "slot": pa.int64(), "length": pa.int32(), "names": pa.list_(pa.string()), "start": longs, "releases": pa.list_(longs), "deadlines": pa.list_(longs)}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    table_ = pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))
    # an Arrow table needs no Python workers, which would wait beside those of later stages; dealt out, else the driver would fold it
    plan = spark.createDataFrame(table_).repartition(spark.sparkContext.defaultParallelism, "segment")
    # the array of one element: the pick is worked out once a slot, not once a source
    step = "(s, t) -> transform(array({pick}), p -> IF(p IS NULL, s, named_struct('done', transform(s.done, (x, i) -> x + CAST(i = p AS INT)), 'order', concat(s.order, array(p)))))[0]"
    pick = "array_min(transform(filter(sequence(0, size(names) - 1), i -> get(get(releases, i), get(s.done, i)) <= slot + t), i -> named_struct('deadline', get(get(deadlines, i), get(s.done, i)), 'i', i))).i"
    fold = f"aggregate(sequence(0, length - 1), named_struct('done', transform(names, x -> 0), 'order', CAST(array() AS ARRAY<INT>)), {step.format(pick=pick)}, s -> s.order)"
    placed = plan.withColumn("order", F.expr(fold))
    each = placed.selectExpr("segment", "slot", "order", "posexplode(arrays_zip(names, start, releases, deadlines)) AS (i, x)")
    offsets = each.selectExpr("segment", "slot", "x", "posexplode(filter(transform(order, (who, at) -> IF(who = i, at, -1)), at -> at >= 0)) AS (k, at)")
    return offsets.selectExpr("x.names AS source", "x.start + k AS block", "slot + at AS slot", "get(x.releases, k) AS release", "get(x.deadlines, k) AS deadline", "segment")


def _placed(rows: DataFrame, order: list[str], carried: list[str], weights: Mapping[str, float] | None, block_rows: int | None, period: int) -> tuple[DataFrame, int]:
    """The place of each row (source, order, carried), and the number of slots."""
    counts = {r.source: r.n for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights:
        used = {k: float(weights.get(k, min(weights.values()))) for k in counts}
        if min(used.values(), default=1) <= 0:
            raise ValueError("target weights must be positive")
    else:
        used = {k: n**SMOOTHING for k, n in counts.items()}
    size = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    blocks = {k: -(-n // size) for k, n in counts.items()}
    if not blocks:
        return rows.selectExpr("source", *carried, "0L AS block", "0L AS slot", "0L AS release", "0L AS deadline", "0 AS place", "0 AS segment").filter("false"), 0
    plan = cut(schedule(rows.sparkSession, list(plan_segments(blocks, used, period))), "schedule")
    numbered = gapless_index(rows, ["source"], order, "n").selectExpr("source", *carried, f"n DIV {size} AS block", f"CAST(n % {size} AS INT) AS place")
    joined = join_small(numbered, plan, ["source", "block"])
    return joined.select("source", *carried, "block", "slot", "release", "deadline", "place", "segment"), sum(blocks.values())


def _sources(docs: DataFrame, *more: str) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), *more)
    return rows.withColumn("_lx_h", F.xxhash64("doc_id", "source"))


def mix_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """Place all rows of ``docs`` (doc_id, source): block, slot, release, deadline and place in the block.

    A null source counts as the source named ''; a null id is an id like any other. A
    source without a target weight gets the smallest one given. Repeated rows are
    placed each; rows equal in id and source are interchangeable. Extra columns are
    ignored. An empty table gives an empty result.
    """
    placed, _ = _placed(_sources(docs), ["_lx_h", "doc_id"], ["doc_id"], weights, block_rows, period)
    return placed.select("doc_id", "source", "block", "slot", "release", "deadline", "place", "segment")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, with the columns they came with, sorted by slot: files written from it follow the schedule.

    Rows are placed without their texts, by the place they have in their file; texts
    move once, to the task that holds their slots. Odd rows are treated as in ``mix_documents``.
    """
    here = located(docs)
    keys = ["_lx_file", "_lx_at"]
    placed, slots = _placed(_sources(here, *keys), ["_lx_h", "doc_id", *keys], keys, weights, None, PERIOD)
    placed = cut(placed.select(*keys, "slot", "place"), "mixed")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = join_small(here, placed, keys).withColumn("_lx_task", F.expr(f"CAST(slot * {tasks} DIV {max(1, slots)} AS INT)"))
    return whole.repartitionById(tasks, "_lx_task").sortWithinPartitions("slot", "place").select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
