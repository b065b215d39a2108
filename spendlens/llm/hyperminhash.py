"""Near-duplicate documents from HyperMinHash sketches.

A document is a set of word-shingle hashes.  The first bits of a hash name one
of 256 buckets; of the least hash in each bucket a register of 16 bits is kept:
the number of its leading zeros and the ten bits after its first one.  Equal sets have
equal registers, and two registers of different hashes are equal by chance once in
some thousands, for which the estimate is corrected.

1. Documents with equal sets are one representative.
2. Registers are banded, six to a band; documents that share a band, and whose
   sizes share a power of two, are one list.  In a small set most buckets are
   empty; for the bands an empty one borrows the register of another bucket, the same for every document.
3. The members of a list are compared with its first (``linking``): by the corrected
   estimate of the registers, which drops a pair only if it is seven standard
   deviations below the threshold, and then on the full sets.
4. Lists that are not one component after that are compared within tasks, in blocks
   of bounded size: pairs across components by the estimate and, where it is not
   too low, on the full sets.  Links leave the task, pairs never do.

What banding can miss: at similarity 0.85 a band agrees with probability
0.85 ** 6 = 0.38, and all 42 bands differ with probability 2e-9.  The estimate drops
a pair at the threshold with probability 1e-8.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, table
from .components import components
from .linking import COMPONENTS_SQL, confirmed, link_lists, token_sets
from .tokens import mix, shingle_sets, slices, text_buffer

WIDTH, PERCENT = 3, 85
#: Buckets by the first bits of a hash, bits kept after the first one, registers of a band.
BUCKET_BITS, MANTISSA, BAND = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
#: Standard deviations below the threshold at which an estimate drops a pair.
MARGIN = 7.0
#: Tokens of a list in one block; two blocks are compared in one task.
BLOCK_TOKENS = 1 << 20
#: Other buckets that an empty one is tried with before it takes the next one in order.
TRIES = 64
SLICE = 8 << 20
_REST = 64 - BUCKET_BITS
_OTHERS = (mix(np.arange(1, TRIES * BUCKETS + 1, dtype=np.uint64)) >> np.uint64(_REST)).astype(np.int64).reshape(TRIES, BUCKETS)


def registers(tokens: np.ndarray) -> np.ndarray:
    """The registers of sorted distinct 64-bit hashes; 0 for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(tokens):
        return out
    bucket = (tokens >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # the least hash of each bucket, for they are sorted
    rest = tokens[first] & np.uint64((1 << _REST) - 1)
    length = np.zeros(len(rest), np.int64)
    some = rest > 0
    length[some] = np.frexp(rest[some].astype(np.float64))[1].clip(1, _REST)
    zeros = _REST - length
    after = ((rest << zeros.astype(np.uint64)) >> np.uint64(_REST - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | after).astype(np.uint16)
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Rows of registers, none all empty, with each empty one taken from another bucket."""
    out = sketches.copy()
    for others in _OTHERS:
        rows = np.flatnonzero((out == 0).any(axis=1))
        if not len(rows):
            return out
        out[rows] = np.where(out[rows] == 0, sketches[rows][:, others], out[rows])
    for row in np.flatnonzero((out == 0).any(axis=1)):
        some, none = np.flatnonzero(out[row]), np.flatnonzero(out[row] == 0)
        out[row, none] = out[row, some[np.searchsorted(some, none) % len(some)]]
    return out


def band_keys(sketches: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """For each row of registers a key for each band and each power of two that
    a similar document of the same or a larger size can have."""
    out = [np.zeros(0, np.int64)] * len(sketches)
    rows = np.flatnonzero(sizes > 0)
    banded = filled(sketches[rows])[:, :BANDS * BAND].reshape(len(rows), BANDS, BAND).astype(np.uint64)
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(rows), 1))
    for k in range(BAND):
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + banded[:, :, k])
    for row, k, n in zip(rows, key, sizes[rows].tolist()):
        low, high = n.bit_length(), (100 * n // percent).bit_length()
        own = mix(k + np.uint64(low))
        out[row] = (np.concatenate([own, mix(k + np.uint64(high))]) if high > low else own).view(np.int64)
    return out


def _level_shares(n: np.ndarray) -> np.ndarray:
    """Per set size, the chance of each number of leading zeros in a bucket's register."""
    edge = np.r_[1.0, 0.5 ** np.arange(1, _REST + 1), 0.0]
    none_below = (1.0 - edge[None, :] / BUCKETS) ** n[:, None]
    return none_below[:, 1:] - none_below[:, :-1]


def estimates(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for equal registers of
    different hashes, and the number of buckets in use."""
    either, both = (left > 0) | (right > 0), (left > 0) & (right > 0)
    used, equal = either.sum(axis=1), (both & (left == right)).sum(axis=1)
    chance = (_level_shares(n_left) * _level_shares(n_right)).sum(axis=1) / (1 << MANTISSA)
    by_chance = chance * both.sum(axis=1)
    return np.maximum(equal - by_chance, 0) / np.maximum(used - by_chance, 1), used


def _sketch(batches, width, percent):
    """Per document: size and identity of its set, registers and band keys."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
            sketches = np.stack([registers(s) for s in sets])
            keys = band_keys(sketches, np.array([len(s) for s in sets]), percent)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in sketches], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["doc_id", "n", "same", "registers", "bands"])


def _not_too_low(left, right, n_left, n_right, percent):
    """Whether the estimates leave it open that pairs are similar.  The buckets in
    use are a sample without replacement of the union, whose size at the threshold is known."""
    share = percent / 100
    found, used = estimates(left, right, n_left, n_right)
    union = (n_left + n_right) / (1 + share)
    spread = np.sqrt(share * (1 - share) / np.maximum(used, 1) * np.maximum(union - used, 1) / np.maximum(union - 1, 1))
    return found >= share - MARGIN * spread


def _likely(batches, percent):
    """Pairs whose estimate does not rule out that they are similar."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("registers", "other")]
        sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("n", "n_other")]
        yield batch.select(["rep", "leader"]).filter(pa.array(_not_too_low(*rows, *sizes, percent)))


def _link_blocks(rows: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of a list (or within one) across components, as a spanning forest."""
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in rows.column("tokens")]
    n = np.array([len(s) for s in sets])
    rep, label, block = (rows.column(c).to_numpy() for c in ("rep", "label", "block"))
    order = np.lexsort((rep, n))
    rep, label, block, n, sets = rep[order], label[order], block[order], n[order], [sets[k] for k in order]
    sketch = np.stack([registers(s) for s in sets])
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    right = np.flatnonzero(block == high)
    size = n.astype(np.float64)
    found = []
    for k in np.flatnonzero(block == low).tolist():
        # Partners of a similar size; within one block, those after it.
        a, b = np.searchsorted(n[right], [-(-percent * n[k] // 100), 100 * n[k] // percent + 1])
        at = right[max(a, int(np.searchsorted(right, k, "right"))) if low == high else a:b]
        at = at[label[at] != label[k]]
        if len(at):
            at = at[_not_too_low(sketch[k][None, :], sketch[at], np.full(len(at), size[k]), size[at], percent)]
        for m in at.tolist():
            if label[m] == label[k]:  # connected by now
                continue
            near = np.searchsorted(sets[m], sets[k]).clip(0, n[m] - 1)
            shared = int((sets[m][near] == sets[k]).sum())
            if 100 * shared >= percent * (n[k] + n[m] - shared):
                found.append((max(rep[k], rep[m]), min(rep[k], rep[m])))
                label[label == label[m]] = label[k]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _left_links(texts: DataFrame, left: DataFrame, width: int, percent: int, block_tokens: int) -> DataFrame:
    """Links within the lists' rows (``key, rep, n, label``), block by block."""
    # Most copies share many bands: lists with the same members are one.
    alike = (left.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.sum("n").alias("tokens"))
             .groupBy("members", "who", "tokens").agg(F.min("key").alias("key")))
    lists = stored(alike.select("key", F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks")), "lists-distinct")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    # Block i goes to the tasks (i, j) and (j, i), i <= j.
    sent = stored(left.select("key", "rep", "label").distinct().join(lists, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
                  .select("key", "rep", "label", "block", other)
                  .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other"), "lists-dealt")
    involved = stored(sent.select(F.col("rep").alias("doc_id")).distinct(), "lists-members")
    tokens = (texts.join(involved, "doc_id", "left_semi").mapInArrow(lambda it: token_sets(it, width), "rep long, tokens binary")
              .repartition("rep").dropDuplicates(["rep", "tokens"]))
    return stored(tokens.join(sent, "rep").groupBy("key", "low", "high").applyInArrow(lambda t: _link_blocks(t, percent), "a long, b long"), "lists-linked")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Near-duplicate components of documents.

    Input: ``doc_id, text`` (others are ignored).  Output, one row per input
    row: ``doc_id, n_shingles, component_id`` (the smallest id reachable over
    links, ``100 * intersection >= percent * union`` of the shingle sets) and ``kept``
    (the document is its component's smallest).

    A text of fewer than ``width`` words is one shingle, its whole sequence;
    null texts and texts without words are empty and link with nothing.  Rows
    without an id link with nothing and have a null component and verdict.
    Repeated rows have equal results; rows of one id with different texts keep
    a row each and are one node.  An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = stored(texts.mapInArrow(lambda it: _sketch(it, width, percent), "doc_id long, n long, same binary, registers binary, bands array<long>"), "sketches")
    known = sketches.where("doc_id is not null and n > 0")
    reps = stored(known.groupBy("same").agg(F.min("doc_id").alias("rep")), "sketch-reps")
    single = stored(known.join(reps, "same").where("doc_id = rep").dropDuplicates(["same"]).select("rep", "n", "registers", "bands"), "sketch-single")
    lists = single.select(F.explode("bands").alias("key"), "rep", "n")

    def check(pairs):
        other = single.select(F.col("rep").alias("leader"), F.col("n").alias("n_other"), F.col("registers").alias("other"))
        sized = (pairs.join(single.select("rep", "n", "registers"), "rep").join(other, "leader")
                 .where(F.least("n", "n_other") * 100 >= F.greatest("n", "n_other") * percent))
        likely = sized.mapInArrow(lambda it: _likely(it, percent), "rep long, leader long").distinct()
        return confirmed(texts, likely, single, width, percent)

    links, found, left = link_lists(lists, check, rounds=1)
    if not left.isEmpty():
        more = _left_links(texts, left, width, percent, block_tokens)
        found = components(more if links is None else links.unionByName(more))
    named = sketches.join(reps, "same", "left")
    if found is None:
        component = F.col("rep")
    else:
        named = named.join(found, named["rep"] == found["node"], "left")
        component = F.coalesce("component", "rep")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op11_hyperminhash(spark, sf_dir):
    """Components over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = COMPONENTS_SQL.format(width=WIDTH, percent=PERCENT, more=", doc_id = component_id AS kept")
