"""Filter interaction audit over radix text tries.

Five filters judge every text; the audit tells, for every order in which they
could be applied, what each one removes, what it would have removed anyway and
what only it finds.  Four filters look at one text.  The fifth, exact copies
of a text with a smaller id, needs equal texts to meet:

* Every text gets an adaptive prefix: the shortest of its prefixes of 8, 32,
  128, ... characters that few texts share.  Texts are range-partitioned by it.
* A task inserts the full texts of one prefix into a compressed (radix) trie.
  A terminal holds the least id that ended there; walking a text's path to its
  terminal gives its flag.
* A small trie over each incoming batch goes before the shuffle.  A row that
  is no first copy within its own batch is flagged there and its text stays
  behind, so a text that fills a third of the table travels once per batch.

All later work is on masks of five bits: counts by part and mask, then for
each set ``S`` of filters the number of texts that pass all of ``S``.  Every
column of the report is a difference of two such numbers.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, table, text_or_empty
from .tokens import find_words, hash_words, slices, text_buffer

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
SYMBOLS = "#$%&*|"
COPY = 1 << LETTERS.index("E")
#: Lengths of prefixes in characters; the last is beyond any text Spark can hold.
PREFIXES = [8 * 4 ** k for k in range(14)]
#: A prefix whose texts have more bytes (and 256 for each text) is made longer: the size of one trie.
GROUP_BYTES = 16 << 20
#: The bound grows with the table so that no more prefixes than this exceed it on one
#: length (eight bytes of each are sent to the tasks).
HEAVY_KEPT = 1 << 20
SLICE = 8 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


class _Node:
    __slots__ = ("edges", "least")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.least: int | None = None


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    at = int(differs.argmax()) if n else 0
    return at if n and differs[at] else n


class RadixTrie:
    """A compressed trie over byte strings whose terminals hold the least id inserted there."""

    def __init__(self):
        self.root = _Node()

    def insert(self, text: bytes, ident: int) -> _Node:
        """Inserts a full text and returns its terminal."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = _Node()
                node.edges[text[at]] = (text[at:], leaf)
                node, at = leaf, len(text)
                break
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            # The text leaves the edge inside its label: a node is put there.
            same = _common(label, text[at:at + len(label)])
            middle = _Node()
            middle.edges[label[same]] = (label[same:], child)
            node.edges[text[at]] = (label[:same], middle)
            node, at = middle, at + same
        if node.least is None or ident < node.least:
            node.least = ident
        return node


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags (one for each byte) in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the four filters that look at one text alone, for consecutive texts."""
    starts, ends, first = find_words(data, offsets)
    hashes = hash_words(data, starts, ends, fold=False)
    n_words = np.diff(first)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], np.int64)
    points = _per_text((data & 0xC0) != 0x80, offsets)
    upper = _per_text((data >= 65) & (data <= 90), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    fails = (n_words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n_words, 100 * upper > UPPER_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _judge(batches, heavy):
    """Per row: its mask, and its text and prefix level if a smaller id may still hold the same text."""
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
        data, offsets = text_buffer(texts)
        masks = np.concatenate([text_masks(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                                for i, j in slices(offsets, SLICE)] or [np.zeros(0, np.int32)]).astype(np.int32)
        keys = batch.column("keys")
        sizes = np.diff(keys.offsets.to_numpy())
        flat = keys.flatten().to_numpy()
        light = ~np.isin(flat, heavy)
        ends = np.cumsum(sizes)
        # The first light level; a text all of whose prefixes are heavy keeps the longest.
        level = [int(light[e - n:e].argmax()) if light[e - n:e].any() else int(n) - 1 for e, n in zip(ends, sizes)]
        trie = RadixTrie()
        ends_at = [None if d is None else trie.insert(data[a:b].tobytes(), d)
                   for d, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist())]
        first = np.array([n is not None and n.least == d for n, d in zip(ends_at, ids)], bool)
        copy = np.array([n is not None and n.least < d for n, d in zip(ends_at, ids)], bool)
        masks[copy] |= COPY
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(masks), pa.array(level, pa.int32()),
             pa.array([t if f else None for t, f in zip(texts.to_pylist(), first)], pa.string())],
            ["doc_id", "part", "mask", "level", "text"])


def _flag(batches):
    """Masks of rows sorted by prefix, each prefix's texts in a trie of their own."""
    prefix = trie = None
    for batch in batches:
        masks = batch.column("mask").to_pylist()
        for k, (p, t, d) in enumerate(zip(batch.column("prefix").to_pylist(), batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())):
            if trie is None or p != prefix:
                prefix, trie = p, RadixTrie()
            # Ids come in ascending order, so the least one is at the terminal by now.
            if trie.insert(t.encode(), d).least < d:
                masks[k] |= COPY
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32())], ["doc_id", "part", "mask"])


def filter_masks(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, part, mask`` for each row of ``docs`` (``doc_id, text, source``, others are ignored).

    Bit k of ``mask`` is set if the text fails filter ``LETTERS[k]``.  Null
    texts are empty; empty texts equal each other.  A null source and an empty
    one are the same part.  Rows without an id are no copies and make none;
    repeated rows have the same id, so none is a copy of the other.
    """
    text = text_or_empty()
    weight = F.octet_length("text") + F.lit(256)
    # A level counts only if the text may be longer than the level before: else it is the same prefix.
    keys = F.array_compact(F.array(*[F.when(F.lit(k == 0) | (F.octet_length("text") > PREFIXES[k - 1]), F.xxhash64(F.lit(k), F.left("text", F.lit(n))))
                                     for k, n in enumerate(PREFIXES)]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    levels = rows.select(weight.cast("long").alias("weight"), F.explode(keys).alias("key"))
    total = rows.agg(F.sum(weight.cast("long"))).first()[0] or 0
    limit = max(group_bytes, -(-total // HEAVY_KEPT))
    heavy = np.sort(levels.groupBy("key").agg(F.sum("weight").alias("weight")).where(F.col("weight") > limit).select("key")
                    .toArrow().column("key").to_numpy())
    judged = stored(rows.withColumn("keys", keys).mapInArrow(
        lambda it: _judge(it, heavy), "doc_id long, part string, mask int, level int, text string"), "audit-judged")
    prefix = F.expr(f"left(text, element_at(array({', '.join(map(str, PREFIXES))}), level + 1))")
    flagged = (judged.where("text is not null").withColumn("prefix", prefix).repartitionByRange("prefix").sortWithinPartitions("prefix", "doc_id")
               .select("doc_id", "part", "mask", "text", "prefix").mapInArrow(_flag, "doc_id long, part string, mask int"))
    return flagged.unionByName(judged.where("text is null").select("doc_id", "part", "mask"))


def _bits(letters: str) -> int:
    return sum(1 << LETTERS.index(c) for c in letters)


def filter_audit(docs: DataFrame, labels: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """What each filter does at each step of each order, by part.

    Output, 600 rows (120 orders of 5 steps) per part: ``part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``.  ``labels`` (``doc_id, quality, toxic``) marks good and toxic
    documents; an id counts as marked if any of its labels says so, and one
    without labels is neither.  See ``filter_masks`` for nulls, empty texts
    and repeated rows; an empty table gives an empty result.
    """
    masks = stored(filter_masks(docs, group_bytes), "audit-masks")
    marks = stored(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                   .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "audit-marks")
    counts = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # passing[S]: documents that fail none of the filters in S.
    sets = range(1 << len(LETTERS))
    passing = counts.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in sets]).alias(c) for c in ("n", "good", "toxic")])

    def fails_first(f: int, weight) -> F.Column:
        """Sum over the sets S before filter f of weight(|S|) times what f removes after S."""
        bit = 1 << f
        terms = [weight(s.bit_count()) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | bit))) for s in sets if not s & bit and weight(s.bit_count())]
        return sum(terms[1:], terms[0])

    last = len(LETTERS) - 1
    each = range(len(LETTERS))
    per_part = passing.withColumns({
        "failing": F.array(*[fails_first(f, lambda k: int(k == 0)) for f in each]),
        "alone": F.array(*[fails_first(f, lambda k: int(k == last)) for f in each]),
        "all_orders": F.array(*[fails_first(f, lambda k: math.factorial(k) * math.factorial(last - k)) for f in each])})
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(LETTERS)])
    steps = (per_part.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in each]))))
    place = {c: F.instr("filter_order", c) for c in LETTERS}
    before = sum((F.when(place[c] < F.col("step"), _bits(c)).otherwise(0) for c in LETTERS), F.lit(0))
    f = sum((F.when(place[c] == F.col("step"), LETTERS.index(c)).otherwise(0) for c in LETTERS), F.lit(0))
    steps = steps.withColumns({"before": before, "f": f}).withColumn("after", F.col("before") + F.expr("shiftleft(1, f)"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"),
        (F.get("failing", F.col("f")) - lost("n")).alias("redundant"), F.get("alone", F.col("f")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("all_orders", F.col("f")).alias("shapley"))


def op13_filter_audit(spark, sf_dir):
    """The audit over all documents and labels."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 200)::INT AS a,
         (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id),
masks AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter,
         ascii(substr(filter_order, step, 1)) - 64 AS place,
         list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: ascii(x) - 64) AS earlier
  FROM orders, range(1, 6) s(step)),
judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, f[place] = 1 AS fails,
         len(list_filter(earlier, lambda k: k > 0 AND f[k] = 1)) > 0 AS gone, list_sum(f) AS n_fails
  FROM masks, steps),
report AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM report
"""
