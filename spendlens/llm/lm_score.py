"""Stupid-backoff language model scores, computed relationally.

Documents are dealt into blocks by a hash of their row.  Every block lists its
n-grams once (hash and times), partitioned by hash range; a range's rows are
summed into its part of the count table; the counts go back to the blocks that
asked; and a block scores its documents.  A document is scored by the counts of
all *other* documents: its own occurrences are taken off, otherwise every
n-gram would have been seen.

An n-gram of three words or more can only occur in another document if both
shorter n-grams it is made of do.  So words and pairs are asked for first, and
longer n-grams, order by order, only where both parts have been found elsewhere.
All others have a count of zero without being asked for.

``S(w | h) = c(h w) / c(h)`` if ``c(h w) > 0``, else ``0.4 * S(w | shorter h)``,
down to ``c(w) / N``; a word no other document has scores ``0.4 / (N + 1)``.

Scale: what is shuffled is less than eight bytes and a small count per n-gram that a
block asks for, and the texts once (all steps read the same exchange).  A frequent
n-gram is one entry per block, so the hottest word adds as many entries to its
range as there are blocks.  Blocks and ranges are sized in bytes and n-grams,
not in number, so tasks stay the same size as the corpus grows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, text_or_empty
from .tokens import find_words, hash_words, mix, slices, text_buffer, windows

ORDER = 3
BACKOFF = 0.4
#: N-grams of up to so many words are all asked for at once.
FIRST_ASKED = 2
#: Bytes of text in a block; n-grams of a range.
BLOCK_BYTES, RANGE_GRAMS = 8 << 20, 1 << 20


class _Grams:
    """N-grams of a block's documents, in the order of their rows."""

    def __init__(self, column, order: int):
        data, offsets = text_buffer(column)
        hashes, lengths = [], []
        for i, j in slices(offsets):
            piece = data[offsets[i]:offsets[j]]
            starts, ends, first = find_words(piece, offsets[i:j + 1] - offsets[i])
            hashes.append(hash_words(piece, starts, ends))
            lengths.append(np.diff(first))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(words)) - np.repeat(self.first, self.lengths)
        #: By order n: distinct hashes, each word's n-gram (the one it ends) among them, or -1.
        self.distinct, self.index, self.times = [], [], []
        for n in range(1, order + 1):
            grams = mix(windows(words, n) + np.uint64(n))
            at = np.full(len(words), -1, np.int64)
            ends = np.flatnonzero(self.place >= n - 1)
            distinct, inverse, times = np.unique(grams[ends - (n - 1)], return_inverse=True, return_counts=True)
            at[ends] = inverse
            self.distinct.append(distinct)
            self.index.append(at)
            self.times.append(times)

    def own(self, n: int) -> np.ndarray:
        """How often the word's document has the n-gram that ends at the word."""
        at = self.index[n - 1]
        has = at >= 0
        pair = self.doc[has] * max(1, len(self.distinct[n - 1])) + at[has]
        _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
        out = np.zeros(len(at), np.int64)
        out[has] = times[inverse]
        return out


def _ranges(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins among sorted hashes."""
    borders = np.array([(r << 64) // ranges for r in range(ranges)], dtype=np.uint64)
    return np.r_[np.searchsorted(distinct, borders), len(distinct)]


def _planes(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed: high bytes that are mostly
    zero and counts that are mostly one lie together and nearly vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.data, codec="zstd", asbytes=True)


def _values(planes: bytes, kind) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(planes[:8], "little")
    raw = pa.decompress(planes[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _asks(grams: _Grams, block: int, orders, asked: list, ranges: int) -> pa.Table:
    """A block's n-grams of the given orders by hash range."""
    out = {"block": [], "n": [], "range": [], "grams": [], "times": []}
    for n in orders:
        distinct, times = grams.distinct[n - 1][asked[n - 1]], grams.times[n - 1][asked[n - 1]]
        edges = _ranges(distinct, ranges)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[r], edges[r + 1])
            out["block"].append(block)
            out["n"].append(n)
            out["range"].append(r)
            # Sorted hashes travel as differences.
            out["grams"].append(_planes(np.diff(distinct[part], prepend=np.uint64(0))))
            out["times"].append(_planes(times[part].astype(np.uint32)))
    return pa.table({"block": pa.array(out["block"], pa.int64()), "n": pa.array(out["n"], pa.int32()),
                     "range": pa.array(out["range"], pa.int64()), "grams": pa.array(out["grams"], pa.binary()),
                     "times": pa.array(out["times"], pa.binary())})


def _others(grams: _Grams, answers: pa.Table, order: int) -> tuple[list, list]:
    """By order: which distinct n-grams are asked for, and how often each word's
    n-gram occurs in other documents.  The first list has one order more than
    the answers given, that of the n-grams to ask for next."""
    found: dict[int, list] = {}
    for n, r, wide, counts in zip(*(answers.column(k).to_pylist() for k in ("n", "range", "wide", "counts"))):
        found.setdefault(n, []).append((r, _values(counts, np.uint64 if wide else np.uint32)))
    asked, others = [], []
    for n in range(1, order + 1):
        at = grams.index[n - 1]
        mask = np.ones(len(grams.distinct[n - 1]), bool)
        if n >= FIRST_ASKED + 1:
            shorter = others[n - 2] > 0
            both = shorter & np.r_[False, shorter[:-1]] if len(shorter) else shorter
            mask[:] = False
            mask[at[both & (at >= 0)]] = True
        asked.append(mask)
        counts = np.zeros(len(mask), np.int64)
        if n in found:
            counts[mask] = np.concatenate([c for _, c in sorted(found[n], key=lambda x: x[0])])
        here = np.where(at >= 0, counts[at] - grams.own(n), 0) if len(counts) else np.zeros(len(at), np.int64)
        # What was not asked for has no occurrence elsewhere; its own are not to be taken off.
        others.append(np.maximum(here, 0))
    return asked, others


def _ask_first(rows: pa.Table, order: int, ranges: int) -> pa.Table:
    """A block's words and pairs."""
    grams = _Grams(rows.column("text"), order)
    return _asks(grams, rows.column("block")[0].as_py(), range(1, order + 1), [slice(None)] * order, ranges)


def _asker(n: int, ranges: int):
    """Asks for a block's n-grams of ``n`` words whose parts are found in other documents."""
    def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Grams(rows.column("text"), n)
        return _asks(grams, rows.column("block")[0].as_py(), [n], _others(grams, answers, n)[0], ranges)
    return ask


def _sum(rows: pa.Table) -> pa.Table:
    """One range of the count table, answered to the blocks that asked."""
    grams = [np.cumsum(_values(x.as_py(), np.uint64), dtype=np.uint64) for x in rows.column("grams")]
    times = [_values(x.as_py(), np.uint32) for x in rows.column("times")]
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(distinct)).astype(np.uint64)
    wide = total.max() > 0xFFFFFFFF
    answers = np.split(total[inverse].astype(np.uint64 if wide else np.uint32), np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": rows.column("block"), "n": rows.column("n"), "range": rows.column("range"),
                     "wide": pa.array([bool(wide)] * len(grams)), "counts": pa.array([_planes(a) for a in answers], pa.binary())})


def _score(rows: pa.Table, answers: pa.Table, order: int, total: int, backoff: float) -> pa.Table:
    """Scores of a block's documents from the counts of all."""
    grams = _Grams(rows.column("text"), order)
    size = len(grams.doc)
    _, others = _others(grams, answers, order)
    rest = np.repeat(total - grams.lengths, grams.lengths)
    # From the lowest order up: a seen longer n-gram replaces the backed-off score.
    score = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), np.log(backoff) - np.log(rest + 1.0))
    depth = np.where(others[0] > 0, 1, 0)
    for n in range(2, order + 1):
        context = np.zeros(size, np.int64)
        context[1:] = others[n - 2][:-1]
        # The document's own count of a context at its last word is taken off like any other.
        able = grams.index[n - 1] >= 0
        seen = able & (others[n - 1] > 0)
        score = np.where(seen, np.log(np.maximum(others[n - 1], 1)) - np.log(np.maximum(context, 1)),
                         np.where(able, np.log(backoff) + score, score))
        depth = np.where(seen, n, depth)
    sums = np.bincount(grams.doc, weights=score, minlength=len(grams.lengths))
    longest = np.bincount(grams.doc, weights=depth == order, minlength=len(grams.lengths))
    words = grams.lengths
    mean = [None if w == 0 else s / w for s, w in zip(sums.tolist(), words.tolist())]
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(words, pa.int64()), "log_score": pa.array(sums, pa.float64()),
                     "mean_log_score": pa.array(mean, pa.float64()), "n_longest": pa.array(longest.astype(np.int64))})


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Scores of every document under the counts of all other documents.

    Input: ``doc_id, text`` (others are ignored).  Output, one row per input
    row: ``doc_id, n_words, log_score`` (natural log, summed), ``mean_log_score``
    (per word), ``n_longest`` (words whose n-gram of ``order`` words is found
    elsewhere).  A-Z is lower-cased.

    Null and empty texts have no words, a score of 0 and a null mean.  Repeated
    rows are documents of their own and find each other.  An empty table gives
    an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    blocks = (size["bytes"] or 0) // BLOCK_BYTES + 1
    total = int(size["words"] or 0)
    ranges = total * order // RANGE_GRAMS + 1
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asks_kind, answers_kind = "block long, n int, range long, grams binary, times binary", "block long, n int, range long, wide boolean, counts binary"

    def answered(asks: DataFrame) -> DataFrame:
        return asks.groupBy("n", "range").applyInArrow(_sum, answers_kind)

    first = min(order, FIRST_ASKED)
    answers = answered(dealt.groupBy("block").applyInArrow(lambda t: _ask_first(t, first, ranges), asks_kind))
    for n in range(first + 1, order + 1):
        longer = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_asker(n, ranges), asks_kind)
        answers = answers.unionByName(answered(longer))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda left, right: _score(left, right, order, total, backoff),
        "doc_id long, n_words long, log_score double, mean_log_score double, n_longest long")


def op1_stupid_backoff(spark, sf_dir):
    """Scores of all documents."""
    return stupid_backoff(table(spark, sf_dir, "documents"))
