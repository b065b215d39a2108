"""Toxicity by weak supervision.

1. A lexicon of words and word beginnings is mined from a bounded sample of labelled rows
   (``SAMPLE_ROWS``, outside the held-out fold).  It has every entry that marks the class; those
   behind the first ``BITS`` share their bits.
2. Many voters -- shares of the lexicon, and patterns such as shouting -- vote on
   every document of the corpus.
3. A generative label model estimates from the votes alone how often each
   voter fires on toxic and on other documents (the off-diagonal vote
   covariance has rank one if voters are independent given the class) and
   which voters are correlated beyond that; those share their weight.
4. A linear classifier over the lexicon and pattern features is trained on the
   model's posterior labels of the sample and scores every document.

Labels, language, source and id are never inputs of a score.

Scale: the texts are read once; a document becomes ``BITS`` bits and a
few numbers (about 60 bytes), stored.  Vote moments are sums of small matrices, one
per batch.  The driver holds the sample's features (``SAMPLE_ROWS`` rows), the
lexicon (8 bytes per entry, of the sample's words only) and the moments.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, table, text_or_empty
from .tokens import find_words, hash_prefixes, slices, text_buffer

#: Labelled rows used at most, bits that a document's lexicon entries are told by, and folds of which the first is held out.
SAMPLE_ROWS, BITS, FOLDS = 20_000, 256, 5
#: Beginnings of words that are lexicon candidates, in bytes.
CUTS = (4, 5, 6, 7)
LEXICON_VOTERS = 12
SLICE = 1 << 20

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False


def _entries(data, offsets):
    """Per slice of texts: (row range, documents of entries, hashes of entries, words per document)."""
    for i, j in slices(offsets, SLICE):
        piece, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = find_words(piece, own, _NOT_LETTER)
        n = np.diff(first)
        doc = np.repeat(np.arange(j - i), n)
        yield i, j, piece, own, doc, hash_prefixes(piece, starts, ends, CUTS), n


def _mine(batches):
    """Documents of each class that hold a word or word beginning, by slice."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, _, _, doc, hashes, _ in _entries(data, offsets):
            h = np.concatenate(hashes)
            d = np.concatenate([doc] * len(hashes))
            d, h = d[h != 0], h[h != 0]
            order = np.lexsort((d, h))
            d, h = d[order], h[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
            d, h = d[once], h[once]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            bad = toxic[i:j][d].astype(np.int64)
            total = np.diff(np.r_[first, len(h)])
            pos = np.add.reduceat(bad, first) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(pos), pa.array(total - pos)], ["entry", "pos", "neg"])


def _describe(batches, lexicon):
    """A document's lexicon bits (entry ``k`` sets bit ``k mod BITS``), hits, words and pattern numbers."""
    lexicon_sorted = np.sort(lexicon)
    rank = np.argsort(lexicon, kind="stable")
    maybe = np.zeros(1 << 16, bool)
    maybe[(lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        n = len(batch)
        bits, hits, words, shout, marks = np.zeros((n, BITS // 8), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for i, j, piece, own, doc, hashes, count in _entries(data, offsets):
            words[i:j] = count
            hit_words = np.zeros(len(doc), bool)
            present = np.zeros((j - i, BITS), bool)
            for h in hashes:
                k = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                if len(k) and len(lexicon):
                    at = np.searchsorted(lexicon_sorted, h[k]).clip(0, len(lexicon) - 1)
                    ok = lexicon_sorted[at] == h[k]
                    present[doc[k[ok]], rank[at[ok]] % BITS] = True
                    hit_words[k[ok]] = True
            hits[i:j] = np.bincount(doc[hit_words], minlength=j - i)
            bits[i:j] = np.packbits(present, axis=1)
            size = np.maximum(np.diff(own), 1)
            for out, what in ((shout, upper[piece]), (marks, piece == 0x21)):
                running = np.r_[0, np.cumsum(what)]
                out[i:j] = (running[own[1:]] - running[own[:-1]]) / size
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(hits), pa.array(words), pa.array(shout), pa.array(marks)],
            ["doc_id", "row_key", "bits", "hits", "words", "shout", "marks"])


def _columns(batch):
    """Lexicon bits and (hits, words, shout, marks) of described documents."""
    raw = b"".join(batch.column("bits").to_pylist())
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(batch), BITS // 8), axis=1) if len(batch) else np.zeros((0, BITS), np.uint8)
    return bits, *(batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("hits", "words", "shout", "marks"))


def votes(bits, hits, words, shout, marks) -> np.ndarray:
    """Which voters fire: shares of the lexicon (bit ``k`` belongs to share
    ``k mod LEXICON_VOTERS``), several hits, dense hits, shouting, exclamation, long text."""
    shares = [bits[:, k::LEXICON_VOTERS].any(axis=1) for k in range(LEXICON_VOTERS)]
    patterns = [hits >= 2, hits >= 4, hits > 0.01 * words, shout > 0.3, marks > 0.01]
    return np.stack([*shares, *patterns], axis=1).astype(float)


VOTERS = LEXICON_VOTERS + 5


def _moments(batches):
    total = np.zeros((VOTERS, VOTERS))
    n = 0
    for batch in batches:
        v = votes(*_columns(batch))
        total += v.T @ v
        n += len(v)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sums"])


class LabelModel:
    """Firing rates of the voters by class, and their shared weights, from vote moments.

    ``cov(i, j) = p (1 - p) d_i d_j`` for voters independent given the class,
    with ``d`` the difference of a voter's firing rates; pairs whose covariance
    is far from that are correlated and leave the fit."""

    def __init__(self, n: int, second: np.ndarray, prior: float, rounds: int = 60, loose: float = 0.25):
        mean = np.diag(second) / max(n, 1)
        cov = second / max(n, 1) - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        free = ~np.eye(len(mean), dtype=bool)
        d = scale / np.sqrt(prior * (1 - prior)) * 0.5
        spread = prior * (1 - prior)
        for k in range(rounds):
            for i in range(len(d)):
                others = free[i]
                low = spread * (d[others] ** 2).sum()
                d[i] = (cov[i, others] * d[others]).sum() / low if low > 1e-12 else 0.0
            d = np.clip(d, -1.0, 1.0)
            rest = (cov - spread * np.outer(d, d)) / np.outer(scale, scale)
            if k % 20 == 19:  # the pairs that do not fit, while enough are left for each voter
                far = (np.abs(rest) > loose) & ~np.eye(len(d), dtype=bool)
                free = ~np.eye(len(d), dtype=bool) & ~far
                free |= (free.sum(axis=1) < 3)[:, None] & ~np.eye(len(d), dtype=bool)
        self.prior = prior
        self.on = np.clip(mean + (1 - prior) * d, 1e-4, 1 - 1e-4)
        self.off = np.clip(mean - prior * d, 1e-4, 1 - 1e-4)
        np.fill_diagonal(rest, 0.0)
        #: Residual correlations; a voter shares its weight with those it goes along with.
        self.correlation = rest
        self.weight = 1 / (1 + np.maximum(rest, 0.0).sum(axis=1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        fired = np.log(self.on / self.off) * self.weight
        silent = np.log((1 - self.on) / (1 - self.off)) * self.weight
        logit = np.log(self.prior / (1 - self.prior)) + v @ fired + (1 - v) @ silent
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _inputs(bits, hits, words, shout, marks) -> np.ndarray:
    """Features of the linear classifier."""
    return np.column_stack([bits, np.log1p(np.minimum(hits, 50)), hits >= 1, hits >= 2, hits >= 3, np.sqrt(np.minimum(hits / np.maximum(words, 1), 0.2)),
                            shout, np.minimum(marks * 10, 1), np.log1p(words) / 10, np.ones(len(hits))]).astype(float)


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - l2 * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


def _score(batches, weights):
    for batch in batches:
        z = _inputs(*_columns(batch)) @ weights
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column("hits")],
            ["doc_id", "row_key", "score", "predicted", "hits"])


def _fold(column):
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(FOLDS))


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())


def _lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """All entries that mark the toxic class, those in most toxic documents first.
    They occur in a bounded sample, each in several of its documents."""
    if not n_pos or not n_neg:
        return np.zeros(0, np.uint64)
    counted = sample.mapInArrow(_mine, "entry long, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    rows = (counted.where((F.col("pos") >= max(3, n_pos // 200)) & (odds > 3.0)).orderBy(F.desc("pos"), "neg", "entry")
            .select("entry").collect())
    return np.array([r["entry"] for r in rows], np.int64).view(np.uint64)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity scores of all documents.

    Input: ``doc_id, text`` and ``doc_id, toxic`` (others are ignored).  Output, one
    row per input row: ``doc_id, held_out, score, predicted, hits, row_key`` (a hash of id and text).  Only
    labelled rows with ``crc32(doc_id) mod 5 <> 0`` are learnt from, ``sample_rows``
    of them at most, those of smallest id hash.

    Null and empty texts are scored like any other (no hits).  Null labels and
    labels without a document teach nothing; of several labels of an id the largest
    counts; repeated rows have equal scores.  Without labelled rows of both
    classes every score is the prior, 0.  Empty tables give an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), text_or_empty().alias("text"))
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .where(_fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    chosen = stored(chosen, "toxic-labels")
    # Broadcast: ``sample_rows`` rows of two numbers at most.
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxic-sample")
    n_pos, n_neg = (sample.where(F.col("toxic") == c).count() for c in (1, 0))
    lexicon = _lexicon(sample, n_pos, n_neg)
    held_out = _fold(F.col("doc_id")) == 0
    described = stored(texts.mapInArrow(lambda it: _describe(it, lexicon),
                                        "doc_id long, row_key long, bits binary, hits long, words long, shout double, marks double"), "toxic-described")
    parts = described.mapInArrow(_moments, "n long, sums array<double>")
    sums = parts.groupBy().agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(VOTERS * VOTERS)]).first()
    if not n_pos or not n_neg or not len(lexicon):
        return described.select("doc_id", held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "hits", "row_key")
    model = LabelModel(sums["n"], np.array(sums[1:], float).reshape(VOTERS, VOTERS), n_pos / (n_pos + n_neg))
    rows = described.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).drop("toxic").toArrow().combine_chunks()
    weights = _train(model, rows)
    return described.mapInArrow(lambda it: _score(it, weights), "doc_id long, row_key long, score double, predicted int, hits long").select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "hits", "row_key")


def _train(model: LabelModel, rows: pa.Table) -> np.ndarray:
    """The linear classifier, on the label model's posteriors of the sample."""
    columns = _columns(rows)
    return fit_linear(_inputs(*columns), model.posterior(votes(*columns)))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept; rows without an id
    are judged by their text like any other."""
    bad = stored(score_toxicity(docs, labels).where("predicted = 1").select("row_key").distinct(), "toxic-rows")
    return docs.join(bad, _row_key() == bad["row_key"], "left_anti")


def op2_weak_toxicity(spark, sf_dir):
    """Scores of all documents."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
