"""Mixing, sharding and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import corpus_pipeline
from lexigrid.llm import fertility_rules, kd_sharding, pfair_mixing
from lexigrid.llm._shared import gapless_index, table

from .test_pairs import groups, leaks


def simulate(blocks, weights, period):
    """Earliest deadline first, slot by slot, within the planned segments; checks every window."""
    order = []
    for s in pfair_mixing.plan_segments(blocks, weights, period):
        done = dict.fromkeys(s["sources"], 0)
        assert s["slot"] == len(order)
        for t in range(s["slot"], s["slot"] + s["length"]):
            ready = [(own[done[k]][1], k) for k, (_, own) in sorted(s["sources"].items()) if done[k] < len(own) and own[done[k]][0] <= t]
            deadline, k = min(ready)
            assert s["sources"][k][1][done[k]][0] <= t < deadline
            order.append((k, s["sources"][k][0] + done[k]))
            done[k] += 1
    return order


@pytest.mark.parametrize(("counts", "weights"), [({"a": 90, "b": 10, "c": 25}, {"a": 1.0, "b": 1.0, "c": 2.0}), ({"a": 400, "b": 3}, {"a": 0.9, "b": 0.1}), ({"x": 1}, {"x": 5.0}), ({f"s{i}": 7 * i + 1 for i in range(12)}, {f"s{i}": 1.0 + i % 3 for i in range(12)})])
def test_schedule_equals_a_simulation(spark, counts, weights):
    rows = [(n, s) for n, s in enumerate(s for s, c in counts.items() for _ in range(c))]
    mixed = pfair_mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=3, period=32)
    got = mixed.collect()
    assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows) and all(r.release <= r.slot < r.deadline for r in got)
    assert mixed.filter("slot < 7").count() == sum(r.slot < 7 for r in got)
    blocks = {s: -(-c // 3) for s, c in counts.items()}
    want = {b: slot for slot, b in enumerate(simulate(blocks, weights, 32))}
    assert {(r.source, r.block): r.slot for r in got} == want
    assert len(want) == sum(blocks.values())
    sizes = Counter((r.source, r.block) for r in got)
    assert all(n == 3 or b == blocks[s] - 1 for (s, b), n in sizes.items())


def off_target(blocks, weights, order):
    """The largest deviation from the given weights at any slot, in exact fractions; what has run out leaves its share to the others."""
    w = {k: Fraction(x) for k, x in weights.items()}
    worst, done, ends = 0, Counter(), sorted(blocks, key=lambda k: blocks[k] / w[k])
    gone, rate = 0, sum(w.values())
    for t, (k, _) in enumerate(order, 1):
        done[k] += 1
        while ends and gone + blocks[ends[0]] / w[ends[0]] * rate <= t:
            assert done[ends[0]] > blocks[ends[0]] - 1
            gone, rate = gone + blocks[ends[0]], rate - w[ends.pop(0)]
        if ends:
            v = (t - gone) / rate
            worst = max(worst, *(abs(done[x] - w[x] * v) for x in ends))
    return worst


@pytest.mark.parametrize("weights", [{"a": 0.95, "b": 0.05}, {"a": 0.33, "b": 0.27, "c": 0.25, "d": 0.15}, {"a": 0.7} | {f"s{i:02d}": 0.3 / 19 for i in range(19)}, {"a": 0.9} | {f"s{i:03d}": 0.1 / 99 for i in range(99)}])
def test_no_source_is_a_block_off_its_weight(weights):
    blocks = {k: 1 + int(3000 * w * (1 + i % 3 / 7)) for i, (k, w) in enumerate(weights.items())}
    order = simulate(blocks, weights, pfair_mixing.PERIOD)
    assert Counter(k for k, _ in order) == blocks and len(set(order)) == len(order)
    assert off_target(blocks, weights, order) < 1


def test_windows_hold_over_a_million_slots():
    weights = {"a": 0.33, "b": 0.27, "c": 0.25, "d": 0.15}
    blocks = {"a": 330_000, "b": 270_000, "c": 260_000, "d": 150_000}
    assert len(simulate(blocks, weights, pfair_mixing.PERIOD)) == sum(blocks.values())  # every window was met, so no deviation reached one


def test_any_number_of_sources(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('h', id % 700) AS source")
    got = pfair_mixing.mix_documents(docs, block_rows=2).collect()
    assert len(got) == len({r.doc_id for r in got}) == 2000
    assert {r.slot for r in got} == set(range(len({(r.source, r.block) for r in got}))) and all(r.release <= r.slot < r.deadline for r in got)


def test_mixing_odd_rows(spark, odd, empty):
    got = pfair_mixing.mix_documents(odd)
    assert got.count() == odd.count() and pfair_mixing.mix_documents(empty).collect() == []
    ordered = pfair_mixing.in_mixed_order(odd)
    key = lambda rows: sorted(map(str, rows))
    assert ordered.columns == odd.columns and key(ordered.collect()) == key(odd.collect())
    with pytest.raises(ValueError, match="positive"):
        pfair_mixing.mix_documents(odd, {"a": 0.0})


def test_slots_of_a_shard_follow_the_schedule(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('h', id * id % 7) AS source", "repeat('x', CAST(id % 40 AS INT)) AS text", "'en' AS lang").cache()
    pfair_mixing.in_mixed_order(docs).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    here = mixed.selectExpr("doc_id", "source", "_metadata.file_name AS f", "_metadata.row_index AS n").toPandas().sort_values(["f", "n"])
    counts, size = Counter(here.source), pfair_mixing.BLOCK_ROWS
    blocks = {k: -(-n // size) for k, n in counts.items()}
    order = simulate(blocks, {k: n**pfair_mixing.SMOOTHING for k, n in counts.items()}, pfair_mixing.PERIOD)
    assert list(here.source) == [k for k, b in order for _ in range(min(size, counts[k] - b * size))]
    place = {d: n for n, d in enumerate(here.doc_id)}
    rows = kd_sharding.shard_documents(mixed, 4, in_order=True).collect()
    for shard in range(4):
        own = sorted((r.slot, place[r.doc_id]) for r in rows if r.shard == shard)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)
    docs.unpersist()


def test_gapless_index(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id DIV 2 AS x")
    got = defaultdict(list)
    for r in gapless_index(df, ["g"], ["x"], "n", buckets=8).collect():
        got[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 5000


def check_shards(docs, n):
    rows = kd_sharding.shard_documents(docs, n).collect()
    plain = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in plain)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    return sums, rows


def test_shards_are_even(spark, sf):
    docs = table(spark, sf, "documents")
    largest = max(len((r.text or "").encode()) for r in docs.collect())
    sums, _ = check_shards(docs, 8)
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) <= 2 * largest
    sums, _ = check_shards(docs.selectExpr("doc_id", "'tie' AS text", "'x' AS source", "'y' AS lang"), 8)
    assert max(sums.values()) - min(sums.values()) <= 8, "one hot value is still cut"
    sums, _ = check_shards(docs.selectExpr("1L AS doc_id", "'tie' AS text", "'x' AS source", "'y' AS lang").limit(3), 4)
    assert sum(sums.values()) == 12


def brute_tree(points, n):
    """Shards by plain recursion: sort along the widest dimension, cut at the row nearest to the target weight."""
    dims = kd_sharding.DIMENSIONS
    whole = [max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in dims]
    out = {}

    def split(rows, leaves, first):
        if leaves == 1 or not rows:
            out.update({p["row"]: first for p in rows})
            return
        spread = [(max(p[d] for p in rows) - min(p[d] for p in rows)) / w for d, w in zip(dims, whole, strict=True)]
        dim = dims[max(range(len(dims)), key=lambda k: (spread[k], -k))]
        key = lambda p: (p[dim], p["tie_text"], p["tie_id"])
        target, running, weights = sum(p["size"] for p in rows) * (leaves // 2) / leaves, 0, Counter()
        for p in rows:
            weights[key(p)] += p["size"]
        for k in sorted(weights):
            if running + weights[k] >= target:
                goes_left = running + weights[k] - target < target - running
                break
            running += weights[k]
        left = [p for p in rows if key(p) < k or (goes_left and key(p) == k)]
        split(left, leaves // 2, first)
        split([p for p in rows if p not in left], leaves - leaves // 2, first + leaves // 2)

    split(points, n, 0)
    return out


@pytest.mark.parametrize("n", [2, 5, 8])
def test_tree_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(kd_sharding, "TOLERANCE", 0.0)
    r = random.Random(n)
    rows = [(i, "x" * int(1000 * r.random() ** 4), r.choice(["a", "a", "a", "b", "c"]), r.choice(["en", "de"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    points = [p.asDict() | {"row": p.doc_id} for p in kd_sharding.metadata_points(docs).collect()]
    got = {p.doc_id: p.shard for p in kd_sharding.shard_documents(docs, n).collect()}
    assert got == brute_tree(points, n)


def test_sharding_odd_rows(odd, empty):
    sums, rows = check_shards(odd, 5)
    assert len(rows) == odd.count()
    assert kd_sharding.shard_documents(empty, 8).collect() == [] and kd_sharding.shard_documents(empty, target_bytes=100).collect() == []
    target = kd_sharding.shard_documents(odd, target_bytes=60_000).toPandas()
    assert target["shard"].max() == 4, "five leaves; rows larger than a leaf leave some of them empty"
    with pytest.raises(ValueError, match="n_leaves"):
        kd_sharding.shard_documents(odd, 0)


def test_pipeline_equals_brute_force(spark, sf, texts):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    rules = fertility_rules.measure([r.text for r in rows], [r.lang for r in rows], fertility_rules.fit_bands(docs, table(spark, sf, "labels")))
    fluent = {r.doc_id: r.text for r, k in zip(rows, rules["kept"], strict=True) if k}
    single = {d: t for d, t in fluent.items() if groups(fluent, 5, 80)[d][1] == d} if len(fluent) < 50 else None
    if single is None:
        found = groups(fluent, 5, 80)
        single = {d: t for d, t in fluent.items() if found[d][1] == d}
    bad = {d for d, _ in leaks(single, {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}, 80)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(single) - bad and len(out) == len(single) - len(bad)
    assert {r.shard for r in out} == set(range(8))


def test_stages_on_odd_rows(spark, odd, empty, sf):
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_schedule_starts_no_python_workers(spark):
    """The plan of the mix comes as an Arrow table and is folded on the executors."""
    segments = list(pfair_mixing.plan_segments({"a": 40, "b": 9}, {"a": 3, "b": 1}, 16))
    df = pfair_mixing.schedule(spark, segments)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Exchange" in plan
    rows = df.collect()
    assert sorted(x.slot for x in rows) == list(range(49)) and all(x.release <= x.slot < x.deadline for x in rows)
    assert pfair_mixing.schedule(spark, []).collect() == []
