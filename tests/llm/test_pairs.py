"""Near-duplicates and decontamination against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexigrid.llm import odd_minhash, simhash_leaks
from lexigrid.llm.components import connected_components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])


def groups(texts, n, percent):
    sets = {d: frozenset(shingles(words(t), n)) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(d for d in sets if sets[d]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def family(seed, n, length, edits):
    """Copies of one text, each with some words changed, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(*edits)):
            own[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def check(spark, texts, n, percent):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = odd_minhash.near_duplicates(df, n, percent).collect()
    want = groups(texts, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_near_duplicates_equal_brute_force(spark, texts):
    check(spark, texts, 3, 85)


@pytest.mark.parametrize("seed", range(2))
def test_families_around_the_threshold(spark, seed):
    made = family(seed, 330, 120, (0, 12)) + family(seed + 50, 40, 30, (0, 4)) + family(seed + 90, 30, 4, (0, 1)) + ["two words", "two words", "TWO words", "", "one"]
    check(spark, dict(enumerate(made)), 3, 85)


@pytest.mark.parametrize(("block", "parts"), [(16, 4096), (8, 40)])
def test_large_families_are_compared_in_blocks(spark, monkeypatch, block, parts):
    """Many blocks of one family: groups that meet in no block, pairs on both sides of the threshold."""
    monkeypatch.setattr(odd_minhash, "BLOCK", block)
    monkeypatch.setattr(odd_minhash, "SKETCHES", parts)
    made = family(3, 150, 100, (0, 10)) + family(4, 60, 40, (0, 3))
    r = random.Random(5)
    chain = [f"c{r.randrange(10**6)}" for _ in range(80)]
    for k in range(70):  # each like the one before, the ends unlike
        chain = [*chain]
        chain[k] = f"d{k}"
        made.append(" ".join(chain))
    check(spark, dict(enumerate(made)), 3, 85)


def test_sets_travel_once(spark, monkeypatch):
    """A family of 3,000 distinct texts in 94 blocks: between blocks sketches move, and full sets for few pairs only."""
    monkeypatch.setattr(odd_minhash, "BLOCK", 32)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(3000):
        own = list(base)
        own[r.randrange(150)], own[r.randrange(150)] = f"x{i}", f"y{i}"
        texts[i] = " ".join(own)
    compare = odd_minhash._compare
    shipped = spark.sparkContext.accumulator(0)

    def counting(percent, bits):
        inner = compare(percent, bits)

        def run(rows):
            shipped.add(len(rows))
            return inner(rows)

        return run

    monkeypatch.setattr(odd_minhash, "_compare", counting)
    got = odd_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in got} == {0}
    assert shipped.value <= 3000 * 1.2, "each set once, and hardly any for blocks that are not settled"


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = odd_minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert {by[10 + i].component_id for i in range(6)} == {10} and by[20].kept
    kept = odd_minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert odd_minhash.near_duplicates(empty).collect() == [] and odd_minhash.drop_near_duplicates(empty).collect() == []


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    for changed in (0, 20, 60, 150):
        other = base.copy()
        other[:changed] = r.integers(0, 2**63, changed, dtype=np.uint64)
        true = (400 - changed) / (400 + changed)
        a, b = (odd_minhash.odd_sketches(odd_minhash.minhash(x)[None, :]) for x in (base, other))
        p = int(np.bitwise_count(a ^ b).sum())
        estimate = 1 + odd_minhash.SKETCH_BITS / (4 * odd_minhash.HASHES) * np.log(1 - 2 * p / odd_minhash.SKETCH_BITS)
        assert abs(estimate - true) < 0.16
        assert true < 0.85 or p <= odd_minhash.most_bits(0.85)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(60)}


def leaks(texts, items, percent):
    out = set()
    for i, t in items.items():
        w = words(t)
        own, size = Counter(shingles(w, 5)), len(w)
        for d, text in texts.items():
            v = words(text)
            for a in range(max(1, len(v) - size + 1)):
                c = Counter(shingles(v[a : a + size], 5))
                if own and c and 100 * sum((c & own).values()) >= percent * sum((c | own).values()):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark, sf, texts):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    got = simhash_leaks.leaks(spark.read.parquet(f"{sf}/documents.parquet"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(texts, items, 80) and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_edited_passages(spark):
    r = random.Random(3)
    items = {i: " ".join(f"q{r.randrange(500)}" for _ in range(r.choice([6, 15, 40, 59]))) for i in range(12)} | {50: "short item", 51: None, 52: ""}
    docs = {}
    for k in range(90):
        own = words(items[k % 12])
        for _ in range(k % 4):
            at = r.randrange(len(own))
            own[at : at + 1] = r.choice([[], ["zz"], [own[at], "yy"]])
        docs[k] = " ".join([f"f{r.randrange(99)}" for _ in range(r.randint(0, 30))] + own + [f"g{r.randrange(99)}" for _ in range(r.randint(0, 30))])
    docs |= {200: "short item", 201: "a short item here", 202: None, 203: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in simhash_leaks.leaks(df, bench).collect()} == leaks({d: t for d, t in docs.items() if d != 201}, items, 80)


def test_passages_with_moved_parts(spark):
    own = [f"q{i}" for i in range(59)]
    filler = lambda c: [f"{c}{i}" for i in range(40)]
    moved = {1: own[30:] + own[:30], 2: own[15:] + own[:15], 3: own[20:40] + own[:20] + own[40:], 4: own[12:] + own[:12] * 2, 5: own[40:50] + own[:8]}
    docs = {k: " ".join(filler("f") + v + filler("g")) for k, v in moved.items()} | {6: " ".join(moved[1]), 7: " ".join(filler("f") + moved[2]), 8: " ".join(moved[1][:56])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(own[:40]))], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in simhash_leaks.leaks(df, bench).collect()}
    assert set(got) == leaks(docs, {1: " ".join(own), 2: " ".join(own[:40])}, 80) >= {(1, 1), (2, 1), (6, 1), (7, 1)}
    assert got[1, 1].window_start == 40 and got[1, 1].hamming == 0 and got[1, 1].similarity == 51 / 59


def test_the_radius_loses_no_similar_window(spark):
    """Recall, measured: passages with edits up to the threshold, against a search without fingerprints."""
    r = random.Random(11)
    items, docs = {}, {}
    for i in range(60):
        items[i] = [f"v{int(r.random() ** 2 * 400)}" for _ in range(r.choice([20, 45, 90, 150]))]
        for k in range(4):
            own, run = list(items[i]), max(1, len(items[i]) // 18)
            at = r.randrange(len(own) - run)
            own[at : at + run] = [f"z{r.randrange(9)}" for _ in range(run)]
            docs[i * 4 + k] = " ".join([f"f{r.randrange(99)}" for _ in range(12)] + own + [f"g{r.randrange(99)}" for _ in range(12)])
    texts = {i: " ".join(w) for i, w in items.items()}
    own = {i: {d: t for d, t in docs.items() if d // 4 == i} for i in items}
    want = {pair for i in items for pair in leaks(own[i], {i: texts[i]}, 80)}
    got = simhash_leaks.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()
    assert len(want) > 60 and {(x.doc_id, x.item_id) for x in got} == want
    assert max(x.hamming for x in got) <= simhash_leaks.RADIUS - 4, "the radius has room"


def test_rows_without_an_id_are_judged_by_their_text(spark):
    passage = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(None, passage), (None, "something clean that nobody asks about"), (0, "another clean text of a document"), (5, passage), (5, "clean copy of that id")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (None, "another clean text of a document")], "item_id long, text string")
    assert sorted((r.doc_id is None, r.item_id) for r in simhash_leaks.leaks(docs, bench).collect()) == [(False, 1), (True, 1)]
    assert {r.text for r in simhash_leaks.drop_leaks(docs, bench).collect()} == {"something clean that nobody asks about", "another clean text of a document"}


def test_leaks_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text for all of these rows, twelve words long in fact yes", "x"), (2, None, "x")], "item_id long, text string, doc_id string")
    got = simhash_leaks.leaks(odd, bench).collect()
    assert {(r.doc_id, r.item_id, r.window_start, r.similarity) for r in got} == {(10 + i, 1, 0, 1.0) for i in range(6)}
    clean = simhash_leaks.drop_leaks(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 6
    assert simhash_leaks.leaks(empty, bench).collect() == [] and simhash_leaks.leaks(odd, bench.limit(0)).collect() == []
