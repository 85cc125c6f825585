"""Token ids in ORC: whole texts encoded by a public tokenizer, in ascending document order.

Each file holds a range of document ids in order; ids are integer run-length
encoded, stripes are read in parallel, and row indexes and Bloom filters on the
document id let a reader skip stripes and row groups.

Pre-tokens of a byte-level BPE never span a single space or line feed between two
other characters, so a batch of texts is cut there, its distinct pieces are found in
Arrow, and a worker encodes those that it has not met yet. A text with any other use
of spaces and line feeds is encoded as a whole.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm._shared import cut, release, shared_dir, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces a worker remembers.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at a time (one text at least); it bounds what a worker holds besides its pieces.
SLICE = 6_000_000
#: How the files are laid out; the stripe size is in bytes, the stride in rows.
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": "67108864", "orc.row.index.stride": "2000"}

_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space at an end of the text, or beside a space or line feed.
_NOT_SINGLE = rf"[ \n]{_WHITE}|{_WHITE}[ \n]|^{_WHITE}|{_WHITE}$|^$"


class _Pieces:
    """Pieces and their ids, end to end. They are held as an Arrow array, so a worker can remember very many.

    A piece that begins with a line feed stands for itself, any other for itself
    with a space before it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self.encode(["\n"])[0]
        #: A stop or comma behind a letter or digit is a pre-token of its own.
        self.tails = {c: i[0] for c in ".,;:!?" if len(i := self.encode([c])[0]) == 1}
        self.tail = rf"([\p{{L}}\p{{N}}])[{''.join(self.tails)}]$"
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.count = np.zeros(1, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and first place and number of each line's (none of which holds a line feed): many are joined by line feeds in a call."""
        if len(self.feed) == 1:
            feed = np.array(self.feed, np.int32)
            flat = np.concatenate([x for ids in self.encode(["\n".join(lines[at : at + 256]) for at in range(0, len(lines), 256)]) for x in (np.array(ids, np.int32), feed)])
            cuts = np.flatnonzero(flat == feed[0])
            if len(cuts) == len(lines):
                starts = np.concatenate([[0], cuts[:-1] + 1])
                return flat, starts, cuts - starts
        each = [np.array(x, np.int32) for x in self.encode(lines)]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate(each), np.cumsum(counts) - counts, counts

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The row of each of these distinct pieces; those that are new are encoded."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.reset()
        rows = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new = pieces.take(pa.array(fresh))
            words = new.to_pylist()
            flat, starts, counts = self._encode_lines([w[1:] if w[0] == "\n" else " " + w for w in words])
            # the line feed that begins a piece comes first
            head = np.fromiter((w[0] == "\n" for w in words), bool, len(words)) * len(self.feed)
            source = np.concatenate([np.array(self.feed, np.int32), flat])
            widths = np.stack([head, counts], axis=1)
            total = widths.sum(axis=1)
            rows[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(total) - total).astype(np.int32)])
            self.count = np.concatenate([self.count, total.astype(np.int32)])
            self.flat = np.concatenate([self.flat, source[_spread(widths.ravel(), np.stack([np.zeros_like(starts), starts + len(self.feed)], axis=1).ravel())]])
        return rows


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    import public_tokenizers

    return _Pieces(path if "/" in path else public_tokenizers.path(path))


def only_single_spaces(texts: pa.Array) -> np.ndarray:
    """Whether every space and line feed of a text has a character other than white space on both sides."""
    return ~pc.match_substring_regex(texts, _NOT_SINGLE).to_numpy(zero_copy_only=False)


def _spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of runs: run i has sizes[i] places from starts[i] on."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _encode_regular(pieces: _Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, end to end, and their number for each text; END_ID is behind each.

    A line feed is put before every text, so that its first piece is one that begins a line.
    """
    lines = pc.binary_join_element_wise(pa.scalar("", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("\n", texts.type))
    split = pc.split_pattern(lines, " ")
    pieces_of = pc.dictionary_encode(split.values)
    stems = pc.replace_substring_regex(pieces_of.dictionary, pieces.tail, r"\1")
    cut = pc.not_equal(stems, pieces_of.dictionary).to_numpy(zero_copy_only=False)
    known = pc.dictionary_encode(stems)
    row = pieces.rows(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)]
    tail = np.full(len(row), -1, np.int32)
    tail[cut] = [pieces.tails[p[-1]] for p in pieces_of.dictionary.filter(pa.array(cut)).to_pylist()]
    own = pieces_of.indices.to_numpy(zero_copy_only=False)
    counts = (pieces.count[row] + cut)[own]
    ids = np.concatenate([pieces.flat, pieces.flat[:1]])[_spread(counts, pieces.start[row][own])]
    ends = np.cumsum(counts)
    behind = cut[own]
    ids[ends[behind] - 1] = tail[own[behind]]
    ends = np.concatenate([[0], ends])[split.offsets.to_numpy()]
    # the first id of a text's line feed makes room for END_ID, any further ones go
    extra = len(pieces.feed) - 1
    if extra:
        ids = np.delete(ids, (ends[:-1, None] + 1 + np.arange(extra)).ravel())
        ends = ends - extra * np.arange(len(ends))
    out = np.empty(len(ids), np.int32)
    out[:-1] = ids[1:]
    out[ends[1:] - 1] = END_ID
    return out, np.diff(ends)


def encode_texts(texts: pa.Array, tokenizer: str = TOKENIZER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of the texts (null as empty): all their ids, end to end, with END_ID behind each text, and how many a text has."""
    pieces = _pieces(tokenizer)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy()
    part_of = (np.cumsum(sizes) - sizes) // SLICE
    for part in np.unique(part_of):
        first, last = np.searchsorted(part_of, [part, part + 1])
        own = texts.slice(first, last - first)
        regular = only_single_spaces(own)
        counts = np.zeros(len(own), np.int64)
        ids, counts[regular] = _encode_regular(pieces, own.filter(pa.array(regular))) if regular.any() else (np.empty(0, np.int32), 0)
        if not regular.all():
            whole = [np.array([*x, END_ID], np.int32) for x in pieces.encode(own.filter(pa.array(~regular)).to_pylist())]
            counts[~regular] = [len(x) for x in whole]
            starts, both = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
            both[_spread(counts[regular], starts[regular])] = ids
            both[_spread(counts[~regular], starts[~regular])] = np.concatenate(whole)
            ids = both
        yield ids, counts


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, counts in encode_texts(batch.column("text"), tokenizer):
                part = batch.slice(at, len(counts))
                at += len(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), lists], names=["doc_id", "row", "ids"])
        release()

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Write (doc_id, row, ids) in ascending order of doc_id: file names and rows in a file follow it.

    A null id comes first; rows that repeat an id keep the order that ``row`` records.
    A null or empty text has END_ID alone; extra columns are ignored; an empty table
    gives no rows.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    numbered = ordered.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    numbered.mapInArrow(_encode(tokenizer), "doc_id long, row long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        raw = memoryview(flat.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("file"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files.

    A file's first position is the sum of the files before it in the order of their
    rows (one narrow row a file); within a file rows are summed in their order, a task for each file.
    """
    stored = spark.read.schema("doc_id long, row long, ids array<int>").orc(path).select("doc_id", "row", "ids", F.col("_metadata.file_name").alias("file"))
    rows = cut(stored.mapInArrow(_digest, "doc_id long, row long, file string, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("row").alias("first")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(files, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lexigrid/tokens-{uuid.uuid4().hex}"
    write_token_orc(table(spark, sf_dir, "documents"), path)
    return read_token_orc(spark, path)
