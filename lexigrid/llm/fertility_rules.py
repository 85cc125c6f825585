"""Quality rules: base counts and tokeniser fertility.

Public vocabularies encode every word of a text by itself. Measures follow: for each
vocabulary the characters per token and the share of byte-fallback tokens (byte pieces,
or pieces that are no whole characters), and for the first one the entropy of the text's
tokens, as a share of the most that so many tokens could have. A text outside the bands
of its language, else of its script, is rejected.

The bands of a language are fitted on all of its labelled good rows: for each
octave of token counts, the range of every measure among the good rows of about that
length, and a little slack. So short and long texts are held against texts like them, by
one rule for all sizes. Scripts have wide bands that are stated here.

Words are measured once for each batch of texts and looked up from then on; the table is
bounded and is emptied when full and after the batch, which changes no result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm._shared import join_small, release, table

#: The vocabularies: one of sentence pieces with byte fallback, one of bytes.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: Words that are remembered within a batch.
REMEMBERED = 250_000
#: Bytes of text that are measured at a time (one text at least).
SLICE = 500_000
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Labelled good rows of a language that its bands are fitted on, at least; else it has none of its own.
FIT_LEAST = 40
#: What a band is wider than the range of the good rows: a share of characters per token, and shares themselves.
SLACK, SLACK_SHARE = 0.03, 0.02
#: A band: least and most characters per token, most byte share (first, then second vocabulary), least entropy share,
#: and the binary logarithm of the token count beyond which a text's entropy need not grow any more.
MEASURES = ("chars_per_token", "byte_share", "chars_per_token_2", "byte_share_2", "entropy_share")

#: Wide bands by the script of most letters; "*" is for a text without any.
BANDS = {
    "latin": (1.15, 9.0, 0.15, 1.15, 9.0, 0.15, 0.45, 9.0),
    "cyrillic": (0.90, 8.0, 0.20, 0.60, 8.0, 0.30, 0.45, 9.0),
    "greek": (0.60, 6.0, 0.50, 0.40, 6.0, 0.60, 0.45, 9.0),
    "arabic": (0.60, 6.0, 0.50, 0.40, 6.0, 0.60, 0.45, 9.0),
    "hebrew": (0.50, 6.0, 0.60, 0.40, 6.0, 0.60, 0.45, 9.0),
    "devanagari": (0.40, 6.0, 0.80, 0.25, 6.0, 0.90, 0.40, 9.0),
    "han": (0.25, 4.0, 0.95, 0.25, 4.0, 0.95, 0.40, 9.0),
    "kana": (0.25, 4.0, 0.95, 0.25, 4.0, 0.95, 0.40, 9.0),
    "hangul": (0.25, 4.0, 0.98, 0.25, 4.0, 0.98, 0.40, 9.0),
    "*": (0.25, 9.0, 0.98, 0.20, 9.0, 0.98, 0.40, 9.0),
}

#: First and last code point of the letters that tell scripts apart.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, "
    "chars_per_token double, byte_share double, chars_per_token_2 double, byte_share_2 double, entropy_share double, band string, kept boolean"
)

#: Bands by language: first octave, and a band for each octave from it on.
Bands = Mapping[str, tuple[int, list[tuple]]]


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class _Pieces:
    """Sentence pieces: tokens of words, and which tokens are bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words end to end, and their number."""
        return _joined(self.model.encode(words, num_threads=1))


class _Bytes:
    """A byte-level vocabulary; a token that is no whole characters counts as a byte."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[rank] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words end to end, and their number. Many words are encoded in a call, a line feed between them, which is a token of its own."""
        feed = self.model.encode_ordinary("\n")
        alone = np.fromiter((bool(_SPACE.search(w)) for w in words), bool, len(words))
        lines = [w for w, other in zip(words, alone, strict=True) if not other]
        flat = np.concatenate([np.empty(0, np.int32), *(np.array(self.model.encode_ordinary("\n".join(lines[at : at + 512]) + "\n"), np.int32) for at in range(0, len(lines), 512))])
        cuts = np.flatnonzero(flat == feed[0])
        if len(feed) != 1 or len(cuts) != len(lines):
            return _joined([self.model.encode_ordinary(w) for w in words])
        others, counts_of_others = _joined([self.model.encode_ordinary(w) for w, other in zip(words, alone, strict=True) if other])
        counts, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        ends = np.concatenate([[-1], cuts])
        counts[~alone], starts[~alone] = np.diff(ends) - 1, ends[:-1] + 1
        counts[alone], starts[alone] = counts_of_others, len(flat) + np.cumsum(counts_of_others) - counts_of_others
        place = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return np.concatenate([flat, others])[place], counts


#: White space that a word may hold; it would run together with the line feed behind it.
_SPACE = re.compile(r"\s")


def _joined(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter((t for own in tokens for t in own), np.int32, int(counts.sum())), counts


def _tokens(model: _Pieces | _Bytes, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the words end to end, their number, and that of bytes among them."""
    flat, counts = model.encode(words)
    running, ends = np.concatenate([[0], np.cumsum(model.is_byte[flat])]), np.cumsum(counts)
    return flat, counts, running[ends] - running[ends - counts]


@dataclass
class _Table:
    """Words as an Arrow array, and a row of measures for each; ``flat`` holds the first vocabulary's tokens, end to end."""

    models: tuple
    known: pa.Array = field(default_factory=lambda: pa.array([], pa.large_binary()))
    start: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    rows: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int32))  # tokens, bytes, tokens and bytes of the second vocabulary, characters
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))

    def forget(self) -> None:
        self.__init__(self.models)

    def places(self, words: pa.Array) -> np.ndarray:
        """The row of each of these distinct words; those that are new are measured."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        out = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            plain = [w.decode("utf-8", "replace") for w in new.to_pylist()]
            flat, counts, bytes_ = _tokens(self.models[0], plain)
            _, counts_2, bytes_2 = _tokens(self.models[1], plain)
            out[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)])
            self.rows = np.concatenate([self.rows, np.stack([counts, bytes_, counts_2, bytes_2, np.fromiter(map(len, plain), np.int64, len(plain))], axis=1).astype(np.int32)])
            self.flat = np.concatenate([self.flat, flat])
        return out


@lru_cache(maxsize=2)
def _table(vocabularies: tuple[str, str]) -> _Table:
    return _Table((_Pieces(_path(vocabularies[0])), _Bytes(_path(vocabularies[1]))))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs that end where ``ends`` says."""
    running = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return np.diff(running[np.concatenate([[0], ends])], axis=0)


def repeated_words(ids: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``window`` words which its text holds twice or more. ``text`` is the text of each word, ascending."""
    out = np.zeros(len(ids), bool)
    n = len(ids) - window + 1
    if n < 2:
        return out
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    mixed = text[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    order = inside[np.argsort(mixed[inside], kind="stable")]
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return out
    a, b = order[1:][same], order[:-1][same]
    twice = np.zeros(n, bool)
    if (text[a] == text[b]).all() and all((ids[a + k] == ids[b + k]).all() for k in range(window)):
        twice[a] = twice[b] = True
    else:  # two windows share a hash: compare the windows themselves
        whole = np.column_stack([text[:n], np.lib.stride_tricks.sliding_window_view(ids, window)])[inside]
        _, inverse, counts = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
        twice[inside] = counts[inverse.ravel()] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def script_of(text: str) -> str:
    """The script of most letters, '*' without any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = [int(((points >= lo) & (points <= hi)).sum()) for _, lo, hi in SCRIPTS]
    best = int(np.argmax(counts))
    return SCRIPTS[best][0] if counts[best] else "*"


def _entropies(tokens: np.ndarray, text: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the entropy of its tokens as a share of the most that so many could have; 1 for fewer than two."""
    each, n = np.unique(text.astype(np.int64) << 32 | tokens, return_counts=True)
    sums = np.bincount(each >> 32, weights=n * np.log2(n), minlength=len(counts))
    size = np.maximum(counts, 2)
    return np.where(counts < 2, 1.0, np.clip((np.log2(size) - sums / size) / np.log2(size), 0.0, 1.0))


def octave(n_tokens: float) -> int:
    return int(np.log2(max(1, n_tokens)))


def _band(bands: Bands, lang: str | None, text: str | None, n_tokens: int) -> tuple[str, tuple]:
    if lang in bands:
        first, own = bands[lang]
        return lang, own[min(max(octave(n_tokens) - first, 0), len(own) - 1)]
    script = script_of(text or "")
    return script, BANDS[script]


def measure(texts: list[str | None] | pa.Array, langs: list[str | None], bands: Bands = {}, vocabularies: tuple[str, str] = VOCABULARIES) -> pd.DataFrame:  # noqa: B006
    """The columns of SCHEMA for texts; a null text has no words, and a text without words fails the base rules."""
    known = _table(vocabularies)
    column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part_of, out = (np.cumsum(sizes) - sizes) // SLICE, []
    for part in np.unique(part_of):
        first, last = np.searchsorted(part_of, [part, part + 1])
        own = pc.fill_null(column.slice(first, last - first).cast(pa.large_string()), "")  # only a slice is ever copied
        split = pc.ascii_split_whitespace(own.cast(pa.large_binary()).cast(pa.large_string()))
        distinct = pc.dictionary_encode(split.values)
        index, offsets = distinct.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
        text = np.repeat(np.arange(len(own)), np.diff(offsets))
        blank = pc.equal(distinct.dictionary, "").to_numpy(zero_copy_only=False)
        if blank.any():  # what a split leaves at the ends of a text
            word = ~blank[index]
            index, text = index[word], text[word]
        ids = known.places(distinct.dictionary.cast(pa.large_binary()))[index] if len(index) else np.empty(0, np.int32)
        ends = np.searchsorted(text, np.arange(len(own)), side="right")
        n_words = np.diff(np.concatenate([[0], ends]))
        sums = _sums(known.rows[ids], ends)
        repeats = _sums(repeated_words(ids, text), ends)
        widths = known.rows[ids, 0]
        tokens = known.flat[np.arange(int(widths.sum())) + np.repeat(known.start[ids] - (np.cumsum(widths) - widths), widths)]
        entropy = _entropies(tokens, np.repeat(text, widths), sums[:, 0])
        failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
        per, per_2 = sums[:, 4] / np.maximum(1, sums[:, 0]), sums[:, 4] / np.maximum(1, sums[:, 2])
        share, share_2 = sums[:, 1] / np.maximum(1, sums[:, 0]), sums[:, 3] / np.maximum(1, sums[:, 2])
        size = np.log2(np.maximum(2, sums[:, 0]))
        plain = own.to_pylist()
        named = [_band(bands, g, t, n) for g, t, n in zip(langs[first:last], plain, sums[:, 0], strict=True)]
        b = np.array([x for _, x in named]).reshape(-1, 8)
        fits = (b[:, 0] <= per) & (per <= b[:, 1]) & (share <= b[:, 2]) & (b[:, 3] <= per_2) & (per_2 <= b[:, 4]) & (share_2 <= b[:, 5]) & (entropy * size >= b[:, 6] * np.minimum(size, b[:, 7]))
        lines = [_dup_lines(t) for t in plain]
        symbols = pc.count_substring_regex(own, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
        out.append(pd.DataFrame({
            "n_words": n_words, "word_chars": sums[:, 4], "n_symbols": symbols.astype(np.int64), "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": failed, "n_tokens": sums[:, 0],
            "chars_per_token": per, "byte_share": share, "chars_per_token_2": per_2, "byte_share_2": share_2, "entropy_share": entropy, "band": [n for n, _ in named], "kept": fits & ~failed,
        }))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measured(texts: pa.Array, langs: pa.Array, bands: Bands, vocabularies: tuple[str, str]) -> pa.StructArray:
    """The struct of SCHEMA for a batch as it arrived; its texts become neither Python objects nor another column."""
    out = measure(texts, langs.to_pylist(), bands, vocabularies)
    _table(vocabularies).forget()
    release()
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in SCHEMA.split(", ")]
    return pa.StructArray.from_arrays([pa.array(out[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def fertility(text: Column, lang: Column, bands: Bands = {}, vocabularies: tuple[str, str] = VOCABULARIES) -> Column:  # noqa: B006
    """The struct of SCHEMA for a text and its language (which may be null)."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return _measured(texts, langs, bands, vocabularies)

    return run.asNondeterministic()(text.cast("string"), lang.cast("string"))


def bands_of(ranges: pd.DataFrame) -> dict[str, tuple[int, list[tuple]]]:
    """Bands from the ranges of good rows (lang, octave, n, least and most of the MEASURES). An octave with few rows is fitted on those of its neighbours too."""
    out = {}
    for lang, own in ranges.groupby("lang"):
        at, n = own["octave"].to_numpy(), own["n"].to_numpy()
        least, most = (own[[f"{end}_{c}" for c in MEASURES]].to_numpy() for end in ("least", "most"))
        if n.sum() < FIT_LEAST:
            continue
        rows = []
        for o in range(at.min(), at.max() + 1):
            near = next(near for width in range(64) if n[near := np.abs(at - o) <= width].sum() >= FIT_LEAST)
            lo, hi = least[near].min(axis=0), most[near].max(axis=0)
            rows.append((lo[0] * (1 - SLACK), hi[0] * (1 + SLACK), hi[1] + SLACK_SHARE, lo[2] * (1 - SLACK), hi[2] * (1 + SLACK), hi[3] + SLACK_SHARE, lo[4] - SLACK_SHARE, at.max() + 1))
        out[lang] = (int(at.min()), [tuple(map(float, r)) for r in rows])
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, vocabularies: tuple[str, str] = VOCABULARIES) -> dict[str, tuple[int, list[tuple]]]:
    """Bands of the languages of ``docs`` (doc_id, text, lang) from all rows that ``labels`` (doc_id, quality) call good and that pass the base rules.

    Spark sums the rows up to the ranges of each language and octave of token counts,
    and only those of languages with FIT_LEAST rows come to the driver. Without good
    rows there are no bands, and scripts decide.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    texts = join_small(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL"), good, ["doc_id"], "left_semi")
    measured = texts.select("lang", fertility(F.col("text"), F.col("lang"), {}, vocabularies).alias("m")).filter("NOT m.base_failed")
    octaves = (F.length(F.bin(F.greatest("m.n_tokens", F.lit(1)))) - 1).alias("octave")
    ends = [f(f"m.{c}").alias(f"{end}_{c}") for end, f in (("least", F.min), ("most", F.max)) for c in MEASURES]
    ranges = measured.groupBy("lang", octaves).agg(F.count(F.lit(1)).alias("n"), *ends)
    enough = ranges.withColumn("_lx_all", F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("_lx_all") >= FIT_LEAST).drop("_lx_all")
    return bands_of(enough.toPandas())  # a few narrow rows a language


def keep_fluent(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with; no text is shuffled.

    A null or empty text fails; rows that repeat an id are judged each; without labels,
    scripts decide.
    """
    name, bands = "_lx_rules", fit_bands(docs, labels) if labels is not None else {}
    return docs.withColumn(name, fertility(F.col("text"), F.col("lang"), bands)).filter(F.col(f"{name}.kept")).drop(name)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bands = fit_bands(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", fertility(F.col("text"), F.col("lang"), bands).alias("m")).select("doc_id", "m.*")
