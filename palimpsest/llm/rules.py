"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow
from .words import Words, mix64, slices

#: Buckets of the hashed multinomials of single words and of pairs; what a pass sends to the driver is one row per bucket at most.
WORD_BITS, PAIR_BITS = 16, 18
#: Pseudo-occurrences of every bucket in the raw corpus. In the target a word's have the target's share, a pair's the
#: ratio of its two words: a pair seen seldom says what its words say.
SMOOTH = 16.0
#: A document is kept at this log-likelihood ratio per n-gram, or above; chosen on the labelled rows of one table, see the README.
LEAST_RATIO = -0.2
#: Trusted ids that may be broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def text_stats(w: Words, texts: pa.Array) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = w.rows
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])
    space = np.isin(w.data, np.array([0x20, 9, 10, 11, 12, 13], np.uint8))
    repeat = np.zeros(n, np.int64)
    hashes, rows = w.ngrams(5)
    if len(hashes):
        key = hashes ^ mix64(rows.astype(np.uint64) + np.uint64(1))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        # the window's first word: windows of a row follow each other, four fewer than its words
        counts = np.bincount(rows, minlength=n)
        starts = w.first[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))
        edge = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edge, starts[twice], 1)
        np.add.at(edge, starts[twice] + 5, -1)
        repeat = np.bincount(w.row[np.cumsum(edge[:-1]) > 0], minlength=n)
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": per_row(((w.data & 0xC0) != 0x80) & ~space).astype(np.int64),
        "n_symbols": per_row(_SYMBOLS[w.data]).astype(np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeat.astype(np.int64),
    }


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and, behind all words' buckets, of every pair of words."""
    words, row = w.ngrams(1)
    pairs, pair_row = w.ngrams(2)
    at = np.concatenate([words >> np.uint64(64 - WORD_BITS), (pairs >> np.uint64(64 - PAIR_BITS)) + np.uint64(1 << WORD_BITS)])
    return at.astype(np.int64), np.concatenate([row, pair_row])


SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS)


class Ratios:
    """log(p_target / p_raw) of n-grams, from counts of their buckets."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        cut = 1 << WORD_BITS
        self.share = target[:cut].sum() / max(1.0, raw[:cut].sum())
        if self.share:
            self.words = np.log((target[:cut] + SMOOTH * self.share) / ((raw[:cut] + SMOOTH) * self.share))
            self.raw, self.target = raw[cut:] + SMOOTH, target[cut:] / self.share

    def means(self, w: Words) -> np.ndarray:
        """Each row's mean over its words and mean over its pairs of words, in equal parts; a single word counts alone."""
        if not self.share:
            return np.zeros(w.rows)
        at, rows = buckets(w)
        n = len(w.start)
        one = self.words[at[:n]]
        first = np.flatnonzero(w.row[:-1] == w.row[1:]) if n else np.zeros(0, np.int64)
        pair = at[n:] - (1 << WORD_BITS)
        back = SMOOTH * np.exp((one[first] + one[first + 1]) / 2)
        two = np.log((self.target[pair] + back) / self.raw[pair])
        by_word = np.bincount(w.row, one, minlength=w.rows) / np.maximum(w.count, 1)
        by_pair = np.bincount(rows[n:], two, minlength=w.rows) / np.maximum(w.count - 1, 1)
        return np.where(w.count > 1, (by_word + by_pair) / 2, by_word)


def _counts(ids: np.ndarray | None):
    """ids: sorted trusted doc_ids, or None if the rows carry a column ``trusted``."""

    def run(batches):
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                if ids is None:
                    trusted = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
                else:
                    trusted = np.isin(part.column("doc_id").fill_null(0).to_numpy(), ids) & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                at, rows = buckets(Words(part.column("text")))
                raw += np.bincount(at, minlength=len(raw))
                target += np.bincount(at[trusted[rows]], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def log_ratios(documents: DataFrame, trusted: DataFrame) -> Ratios:
    """Counts come from every document; at most one row per bucket reaches the driver."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    if ids.count() <= BROADCAST_IDS:
        known = np.sort(np.array(ids.toArrow().column("doc_id"), np.int64))
    else:
        known = None
        docs = docs.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    counts = map_in_arrow(docs, _counts(known), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    at = np.array(counts.column("bucket"), np.int64)
    raw[at], target[at] = np.array(counts.column("raw"), float), np.array(counts.column("target"), float)
    return Ratios(raw, target)


def _judge(ratios: Ratios, least: float, carry: tuple[str, ...]):
    more = ("text", *carry) if carry else ()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                w = Words(texts)
                stats = text_stats(w, texts)
                mean = np.round(ratios.means(w), 9)
                failed = base_failed(stats)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, stats.values()), pa.array(failed), pa.array(mean), pa.array(~failed & (mean >= least)), *(part.column(c) for c in more)],
                    ["doc_id", *stats, "base_failed", "ratio", "kept", *more],
                )

    return run


def judge(documents: DataFrame, trusted: DataFrame, *, least: float = LEAST_RATIO, carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics and verdict of every row (doc_id, text); ``trusted`` (doc_id) names the target documents.

    Two multinomials over hashed words and pairs of words are counted, one
    over the trusted documents, one over all. A row's ratio is the mean of
    log(p_target / p_raw) over its words and that over its pairs, in equal
    parts; a rare pair falls back on its words. Kept: not base_failed (fewer
    than 10 words, or over a fifth of the words in repeated 5-word windows)
    and ratio >= ``least``, a tie included. No sampling: equal texts get equal
    verdicts.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, ratio, kept, and text with the columns named
    in ``carry`` if there are any. Null or empty text: zeros,
    base_failed. Null doc_id: judged, never trusted. Repeated rows: each on
    its own. Empty table: empty; no trusted rows: ratio 0. Other
    columns are ignored.
    """
    ratios = log_ratios(documents, trusted)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    rows = documents.select(F.col("doc_id").cast("long"), "text", *carry)
    if carry:
        schema += "".join(f", {c} {kind}" for c, kind in rows.dtypes[1:])
    return map_in_arrow(rows, _judge(ratios, least, carry), schema)
