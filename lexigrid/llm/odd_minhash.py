"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

1. Each text gets the set of its word shingles, HASHES MinHash values, BANDS band
   keys and an odd sketch: value i of the MinHash toggles one bit of a bitmap, so
   the XOR of two bitmaps holds the values in which two texts differ, and its
   population count estimates their Jaccard similarity.
2. Equal sets form classes; one representative of each goes on.
3. Each band bucket links its members to its smallest member, its head, only. The
   components of these links are *families*: two texts that share any bucket are in one family.
4. Families are cut into blocks of about BLOCK representatives. Within a block the
   sketches rule out pairs, full sets confirm the rest, and only a spanning forest of
   the confirmed links leaves the task. Each set travels once.
5. Between blocks, sketches alone are compared: of each two parts that may be similar
   the nearest pair is looked at on full sets. Where that joined them, as it nearly
   always does, nothing else of them needs to be compared. Whatever may still be similar
   is then confirmed as within a block, for those pairs of blocks alone.
6. The components of the confirmed links are the near-duplicate groups.

Pairs at the threshold share no bucket with probability (1 - t**ROWS)**BANDS
(4e-7 at 0.85), and the sketch filter allows for SIGMAS standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, join_small, release, table
from lexigrid.llm.components import connected_components
from lexigrid.llm.words import shingle_set, split_words

HASHES, ROWS, BANDS = 128, 5, 25
SKETCH_BITS = 1024
#: Representatives of a block, shingles that a block holds at most (a text at least), and representatives whose sketches a task compares.
BLOCK, BLOCK_SHINGLES, SKETCHES = 256, 4_000_000, 4096
SIGMAS = 5.0
SIG_SCHEMA = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary"

_RNG = np.random.default_rng(20_240_607)
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_BAND = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_SLOT = np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SEED = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over a set of 64-bit hashes; long sets are taken in slices."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None] ^ _XOR
        part *= _MUL
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima to (texts, BANDS) keys; the band number is part of a key."""
    banded = mins[:, : ROWS * BANDS].reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    keys = (banded * _BAND).sum(axis=2, dtype=np.uint64) + _SEED
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima to (texts, SKETCH_BITS / 8) bytes: each value toggles the bit it hashes to."""
    x = mins.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _SLOT
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bits = (x >> np.uint64(40)) % np.uint64(SKETCH_BITS)
    flat = (np.arange(len(mins), dtype=np.uint64)[:, None] * np.uint64(SKETCH_BITS) + bits).ravel().astype(np.int64)
    odd = np.bincount(flat, minlength=len(mins) * SKETCH_BITS).reshape(len(mins), SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def most_bits(threshold: float) -> int:
    """The largest XOR population count at which two texts may still reach the threshold, less SIGMAS deviations."""
    least = threshold - SIGMAS * sqrt(threshold * (1 - threshold) / HASHES)
    return int(SKETCH_BITS / 2 * (1 - exp(-4 * HASHES * (1 - least) / SKETCH_BITS)))


def _signatures(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at : at + 1024]
                sets = [shingle_set(split_words(t, lower=True), size) for t in part["text"]]
                mins = np.stack([minhash(s) for s in sets])
                bands, sketches = band_keys(mins), odd_sketches(mins)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "n_shingles": [len(s) for s in sets], "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": [b if len(s) else b[:0] for b, s in zip(bands, sets, strict=True)], "sketch": [k.tobytes() for k in sketches],
                })
        release()

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 512):
                part = rows.iloc[at : at + 512]
                sets = [shingle_set(split_words(t, lower=True), size).tobytes() for t in part["text"]]
                yield pd.DataFrame({"rep": part["doc_id"].array, "set_id": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets})
        release()

    return run


def confirmed_links(sketches: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, bits: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (indexes; the same array: within it). Rows with equal labels are joined already."""
    root = list(range(len(sets)))
    if labels is not None:
        first: dict[int, int] = {}
        root = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes, links = np.array([len(s) for s in sets]), []
    within = left is right
    for k, i in enumerate(left):
        others = right[k + 1 :] if within else right
        if not len(others):
            continue
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        near = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= bits
        home = find(i)
        rest = [j for j in others[near & (100 * small >= percent * large)] if find(j) != home]
        if not rest:
            continue
        joined = np.concatenate([sets[j] for j in rest])
        spot = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
        shared = np.add.reduceat((sets[i][spot] == joined).astype(np.int64), np.cumsum([0, *[sizes[j] for j in rest[:-1]]]))
        for j, both in zip(rest, shared, strict=True):
            if 100 * both >= percent * (sizes[i] + sizes[j] - both) and find(j) != find(i):
                root[find(j)] = find(i)
                links.append((i, j))
    return links


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _compare(percent: int, bits: int):
    """Links within (family, lo, hi): between blocks lo and hi, or within the one block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, family in rows.groupby(["family", "lo", "hi"], sort=False):
            sets = [np.frombuffer(b, np.uint64) for b in family["shingles"]]
            reps, block = family["rep"].to_numpy(), family["block"].to_numpy()
            lo, hi = family["lo"].iloc[0], family["hi"].iloc[0]
            left = np.flatnonzero(block == lo)
            right = left if lo == hi else np.flatnonzero(block == hi)
            found += [(reps[i], reps[j]) for i, j in confirmed_links(_sketches(family["sketch"]), sets, left, right, percent, bits, family["label"].to_numpy())]
        sets = []
        release()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _survivors(rows: pd.DataFrame, percent: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row i, rows of other blocks that may be similar but have another label, and the bits in which their sketches differ."""
    sketches, sizes, labels, part, block = _sketches(rows["sketch"]), *(rows[c].to_numpy() for c in ("n_shingles", "label", "part", "block"))
    lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
    left = np.flatnonzero(part == lo)
    right = left if lo == hi else np.flatnonzero(part == hi)
    for k, i in enumerate(left):
        others = right[k + 1 :] if lo == hi else right
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(labels[others] != labels[i]) & (block[others] != block[i]) & (100 * small >= percent * large)]
        differ = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1)
        near = differ <= bits
        if near.any():
            yield i, others[near], differ[near]


def _nearest(percent: int, bits: int):
    """The nearest pair of each two labels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reps, labels = rows["rep"].to_numpy(), rows["label"].to_numpy()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, others, differ in _survivors(rows, percent, bits):
            order = np.argsort(differ, kind="stable")
            _, first = np.unique(labels[others[order]], return_index=True)
            for j, d in zip(others[order][first].tolist(), differ[order][first].tolist(), strict=True):
                key = (min(labels[i], labels[j]), max(labels[i], labels[j]))
                if key not in best or d < best[key][0]:
                    best[key] = (d, reps[i], reps[j])
        return pd.DataFrame([(a, b) for _, a, b in best.values()], columns=["a", "b"], dtype="int64")

    return run


def _unsettled(percent: int, bits: int):
    """Members that may be similar to one of another label, with the two blocks in which that is."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reps, block, family = rows["rep"].to_numpy(), rows["block"].to_numpy(), rows["family"].iloc[0]
        found: set[tuple[int, int, int]] = set()
        for i, others, _ in _survivors(rows, percent, bits):
            lo, hi = np.minimum(block[i], block[others]), np.maximum(block[i], block[others])
            found.update(zip(reps[others].tolist(), lo.tolist(), hi.tolist(), strict=True))
            found.update((int(reps[i]), int(a), int(b)) for a, b in set(zip(lo.tolist(), hi.tolist(), strict=True)))
        out = pd.DataFrame(sorted(found), columns=["rep", "lo", "hi"], dtype="int64")
        release()
        return out.assign(family=family)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in rows[c]] for c in ("x", "y"))
            both = np.array([np.isin(p, q, assume_unique=True, kind="sort").sum() for p, q in zip(x, y, strict=True)], np.int64)
            either = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - both
            yield rows.loc[100 * both >= percent * either, ["a", "b"]]
        release()

    return run


def _links(members: DataFrame, sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """(a, b): links that connect just those members (family, rep, set_id, n_shingles, sketch) of a family that similar pairs connect."""
    totals = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("held"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    members = members.join(totals, "family").withColumn("n_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    members = members.withColumn("n_parts", F.ceil(F.col("members") / SKETCHES).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n_parts")).cast("int"))
    placed = cut(members.join(sets, ["rep", "set_id"]), "members")  # whatever needs no set reads none

    # within blocks: small families share a task call
    packs = max(1, *(x or 0 for x in placed.agg((F.count(F.lit(1)) / BLOCK).cast("long"), (F.sum("n_shingles") / BLOCK_SHINGLES).cast("long")).first()))
    pack = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.xxhash64("family", "block"))
    within = placed.select("rep", "family", "sketch", "shingles", "block", F.col("block").alias("lo"), F.col("block").alias("hi"), F.col("rep").alias("label"), pack.alias("pack"))
    links = cut(within.groupBy("pack").applyInPandas(_compare(percent, bits), "a long, b long"), "links")
    large = placed.filter("n_blocks > 1")
    if large.isEmpty():
        return links

    def labelled() -> DataFrame:
        """Members of large families with their component so far, a copy for each two parts they are in."""
        known = connected_components(links.join(large.select(F.col("rep").alias("a")), "a", "left_semi"))
        own = large.select("rep", "family", "n_shingles", "sketch", "block", "part", "n_parts").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        return cut(each.selectExpr("rep", "family", "n_shingles", "sketch", "block", "label", "part", "least(part, other) AS lo", "greatest(part, other) AS hi"), "labelled")

    def sets_of(reps: DataFrame) -> DataFrame:
        """(rep, shingles) of few members: only their sets are shuffled afterwards."""
        return join_small(large.select("rep", "shingles"), reps.select("rep").distinct(), ["rep"], "left_semi")

    near = labelled().groupBy("family", "lo", "hi").applyInPandas(_nearest(percent, bits), "a long, b long")
    pairs = cut(near.distinct(), "nearest")
    asked = cut(sets_of(pairs.selectExpr("a AS rep").union(pairs.selectExpr("b AS rep"))), "asked")
    of = lambda c, name: asked.select(F.col("rep").alias(c), F.col("shingles").alias(name))
    links = cut(links.union(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").mapInPandas(_confirm(percent), "a long, b long")), "links")

    rows = labelled()
    open_ = cut(rows.groupBy("family", "lo", "hi").applyInPandas(_unsettled(percent, bits), "rep long, lo int, hi int, family long").distinct(), "unsettled")
    own = join_small(rows.select("rep", "family", "sketch", "block", "label").distinct(), open_.select("rep").distinct(), ["rep"], "left_semi")
    whole = open_.join(own, ["rep", "family"]).join(sets_of(open_), "rep").select("rep", "family", "sketch", "shingles", "block", "lo", "hi", "label")
    return links.union(whole.groupBy("family", "lo", "hi").applyInPandas(_compare(percent, bits), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z); a text with fewer than ``size`` words is one
    shingle; one without words (or null) has none and is linked with nothing. Rows
    that repeat an id belong to one document, and all of them are kept or none. Rows
    without an id have their number of shingles, belong to no group and are kept. Extra
    columns are ignored; an empty table gives an empty result.
    """
    bits = most_bits(percent / 100)
    sig = cut(docs.select("doc_id", "text").mapInPandas(_signatures(size), SIG_SCHEMA), "signatures")
    first = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("x"))
    classes = cut(first.select("set_id", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.bands", "x.sketch"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).filter("head <> last").select("key", "head")
    # a member keeps one link, to the smallest of its heads, and its other heads (at most BANDS) are linked with that one
    own = banded.join(heads, "key").filter("rep <> head").groupBy("rep").agg(F.collect_set("head").alias("heads")).withColumn("least", F.array_min("heads"))
    others = F.transform("heads", lambda h: F.when(h == F.col("least"), F.struct(F.col("rep").alias("a"), h.alias("b"))).otherwise(F.struct(h.alias("a"), F.col("least").alias("b"))))
    loose = own.select(F.inline(others)).distinct()
    families = connected_components(loose).withColumnRenamed("node", "rep").withColumnRenamed("label", "family")
    members = cut(families.join(classes.select("rep", "set_id", "n_shingles", "sketch"), "rep"), "families")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = join_small(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi").mapInPandas(_sets(size), "rep long, set_id binary, shingles binary").dropDuplicates(["rep", "set_id"])
    groups = connected_components(cut(_links(members, sets, percent, bits), "links"))

    known = classes.select("set_id", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("label", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_id").join(known, "set_id", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay (the smallest id of each group), with the columns they came with."""
    gone = cut(near_duplicates(docs, size, percent).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return join_small(docs, gone, ["doc_id"], "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
