"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid on a line in a pseudo-random order and the
line is cut into blocks of equally many words.  The mix is a schedule of slots
of one block each: slot ``i`` has the golden-ratio point ``frac(i * phi)``,
mapped through the sources' cumulative target weights to a source, and the
slot's rank among its source's slots names the block (ranks beyond the last
block start the source's next epoch).  Joining slots to blocks gives the words
the mix takes of every document.

Scale: running positions and slot ranks are prefix sums over pseudo-random
ranges (``_running``), so a source with most of the rows is spread over all tasks;
blocks are joined on ``(source, block)``, where a hot source is many keys.  The
number of slots is a fixed resolution and the block grows with the corpus.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPREAD, column, content_key, spread_key, stored, table, text_or_empty, word_count

PHI = 0.6180339887498949
#: Weights of the sources in code point order, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: Words of the mix against words of the corpus; most epochs of a source.
SHARE, EPOCHS = 1.5, 2
#: Slots of the schedule (a block has the mix's words over this, 1 at least).
SLOTS = 1 << 20
#: About so many rows share one range of the pseudo-random key.
RANGE_ROWS = 1000
BINS = 1024
SLOT_CHUNK = 4096


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source_no, source, source_size, target`` from ``source, source_size``.

    The sources share ``share`` of all words by weight; a source above
    ``epochs`` times its size stops there and the excess goes to the others.
    The result is ``min(level * weight, cap)`` for the one level at which the
    targets add up, found by ordering the sources by ``cap / weight``.
    One row per source passes through the windows.
    """
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_code_point) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("source_no") % len(cycle) + 1).cast("int"))
    s = (sizes.withColumn("source_no", no.cast("long")).withColumn("weight", weight)
         .withColumn("cap", (F.col("source_size") * epochs).cast("double")))
    filling = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
         # The first source (by cap / weight) that its level does not fill sets the level of all later ones.
         .withColumn("free", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))))
    level = F.first("free", ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (s.withColumn("level", level)
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap"))))
            .select("source_no", "source", "source_size", "target"))


def _running(df: DataFrame, group: list[str], part: Column, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``amount`` over the rows of the group before this
    one, in the order of (``part``, ``order``), and ``rn``, the row's number in its
    part: sums of the parts first, then a window inside each part."""
    df = df.withColumn("part", part)
    offsets = (df.groupBy(*group, "part").agg(F.sum(amount).alias("amount_"))
               .withColumn("before_", F.coalesce(F.sum("amount_").over(
                   W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
               .drop("amount_"))
    inside = W.partitionBy(*group, "part").orderBy(*order)
    rows = (df.withColumn("rn", F.row_number().over(inside))
            .withColumn("upto_", F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))))
    return (rows.join(offsets, [*group, "part"])
            .withColumn(name, (F.col("before_") + F.col("upto_") - F.col(amount)).cast("long"))
            .drop("before_", "upto_"))


def mix(docs: DataFrame, cycle=CYCLE, share: float = SHARE, epochs: int = EPOCHS, slots: int = SLOTS,
        keep: list[str] | None = None) -> DataFrame:
    """Words the mix takes of every document.

    Input: ``doc_id, text, source`` (other columns are ignored).  Output, one
    row per input row: ``doc_id, source, size, source_size, target, taken,
    first_slot, last_slot, text_key`` (the slots of the document's first and last use, null if
    unused) and the input columns named in ``keep``.

    Null texts and texts without words have size 0 and ``taken`` 0; null
    sources are one source, the last; repeated rows are documents of their
    own; ties of the pseudo-random order fall by id, then by text.  An empty
    table gives an empty result.
    """
    digest = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(text_or_empty()).alias("size"),
        spread_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("text_key"), *(keep or [])), "mix-docs")
    sources = stored(source_targets(
        digest.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n")), cycle, share, epochs)
        , "mix-sources")
    totals = sources.agg(F.sum("target").alias("words")).first()
    # The targets add up to a whole or a half number of words, but for rounding errors.
    words = math.floor((totals["words"] or 0.0) + 0.25)
    block = max(1, -(-words // slots))
    n_slots = max(1, -(-words // block))
    parts = digest.count() // RANGE_ROWS + 1

    # Needs of each source: whole epochs, then a remainder that ends inside a block.
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * epochs)
    needs = (sources.withColumn("quota", quota)
             .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
             .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
             .withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
             .withColumn("needed", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block)).cast("long")))
    upto = F.sum("target").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.nullif(F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0))
    needs = (needs.withColumn("to", upto / total).withColumn("from", (upto - F.col("target")) / total)
             .withColumn("to", F.when(upto >= total, F.lit(1.0)).otherwise(F.col("to"))))
    needs = stored(needs, "mix-needs")

    # The schedule: points -> sources -> ranks.  Points and intervals meet in
    # equal bins, so the range condition is checked against few intervals.
    spark = docs.sparkSession
    points = (spark.range(n_slots).withColumnRenamed("id", "slot")
              .withColumn("u", F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI)))
              .withColumn("bin", F.floor(F.col("u") * BINS)))
    intervals = (needs.where("target > 0")
                 .select("source_no", "from", "to", F.explode(F.sequence(
                     F.floor(F.col("from") * BINS), F.least(F.floor(F.col("to") * BINS), F.lit(BINS - 1)))).alias("bin")))
    scheduled = (points.join(intervals, "bin").where("u >= from and u < to").select("source_no", "slot"))
    ranked = _running(scheduled.withColumn("one", F.lit(1)), ["source_no"],
                      F.floor(F.col("slot") / SLOT_CHUNK), ["slot"], "one", "rank").select("source_no", "slot", "rank")
    ranked = stored(ranked, "mix-slots")
    # Points that fell short of a source's need are closed by slots at the end.
    short = (needs.join(ranked.groupBy("source_no").agg(F.count("*").alias("got")), "source_no", "left")
             .withColumn("got", F.coalesce("got", F.lit(0))).where("got < needed")
             .select("source_no", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("rank"))
             .select("source_no", (F.lit(n_slots) + F.col("rank")).alias("slot"), "rank"))
    last = F.col("rest") - (F.ceil(F.col("rest") / F.lit(block)).cast("long") - 1) * F.lit(block)
    uses = (ranked.unionByName(short).join(needs.select("source_no", "blocks", "needed", "rest"), "source_no")
            .where("rank < needed")
            .select("source_no", (F.col("rank") % F.col("blocks")).alias("block"), "slot",
                    F.when((F.col("rank") == F.col("needed") - 1) & (F.col("rest") > 0), last)
                    .otherwise(F.lit(block)).alias("limit")))

    # Documents on their source's line, cut at the block borders.
    numbered = digest.join(F.broadcast(sources) if _few(sources) else sources,
                           digest["source"].eqNullSafe(sources["source"])).select(
        digest["doc_id"], digest["source"], "size", "key", "text_key", "source_no", "source_size", "target", *(keep or []))
    placed = _running(numbered, ["source_no"], F.floor(F.col("key") / F.lit(SPREAD // parts + 1)),
                      ["key", "doc_id", "text_key"], "size", "start")
    placed = stored(placed, "mix-placed")
    pieces = (placed.where("size > 0")
              .select("source_no", "part", "rn", "start", "size", F.explode(F.sequence(
                  F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
              .withColumn("offset", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
              .withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
                          - F.greatest("start", F.col("block") * block)))
    taken = (pieces.join(uses, ["source_no", "block"])
             .withColumn("n", F.greatest(F.lit(0), F.least(F.col("limit") - F.col("offset"), F.col("n"))))
             .where("n > 0").groupBy("source_no", "part", "rn")
             .agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")))
    return (placed.join(taken, ["source_no", "part", "rn"], "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", "text_key", *(keep or [])))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows, in its order: every document as often as the mix takes it, its
    words taken over its size rounded to whole copies; all columns kept.

    The first copy stands where the schedule first uses the document, further ones where
    it last does; rows are range-partitioned and sorted by these slots.  Documents without words
    are not taken; rows equal in all columns share their copies; columns of any
    name and type pass through.  An empty table gives an empty result.
    """
    key = content_key(docs)
    taken = mix(docs.select("doc_id", "text", "source", key.alias("row_key")), keep=["row_key"], **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    wanted = stored(taken.groupBy("row_key").agg(F.sum(copies).cast("int").alias("copies"), F.count("*").alias("rows"),
                                                 F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
                    .where("copies > 0"), "mix-copies")
    # The row travels as one column, so no name of its own can clash.
    keyed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), key.alias("row_key")).join(wanted, "row_key")
    # Rows equal in all columns share their copies; only those are compared.
    rows = keyed.where("rows = 1").unionByName(keyed.where("rows > 1").dropDuplicates(["row_key"]))
    slot = F.expr("if(copy = 1, first_slot, last_slot)")
    each = rows.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row", slot.alias("slot"), "copy", "row_key")
    return each.repartitionByRange("slot", "row_key").sortWithinPartitions("slot", "row_key", "copy").select("row.*")


def _few(sources: DataFrame, rows: int = 10_000) -> bool:
    """Whether the source table is small enough to send to every task."""
    return sources.limit(rows + 1).count() <= rows


def op5_mix_sources(spark, sf_dir):
    """Digest of :func:`mix` over all documents; ``first_slot`` is where the mix first uses a document."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The words a source's quota covers of a document that begins at ``start`` of its line, and the
#: slot of the schedule that has the rank of the block it begins in.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key, text
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
t AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no, least((SELECT min_by(lev, cap / weight) FROM l WHERE lev * weight < cap) * weight, cap) AS target FROM l),
b AS (
  SELECT *, greatest(1, CAST(ceil(words / n_blocks) AS BIGINT)) AS block
  FROM (SELECT CAST(floor(sum(target) + 0.25) AS BIGINT) AS words, 1048576::DOUBLE AS n_blocks FROM t)),
n AS (SELECT block, greatest(1, CAST(ceil(words / block::DOUBLE) AS BIGINT)) AS n_slots FROM b),
bounds AS (
  SELECT no, source, target, sum(target) OVER (ORDER BY no) AS upto, sum(target) OVER () AS total FROM t),
shares AS (
  SELECT no, source, (upto - target) / total AS low, CASE WHEN upto >= total THEN 1.0::DOUBLE ELSE upto / total END AS high
  FROM bounds WHERE target > 0),
points AS (
  SELECT i AS slot, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS u
  FROM n, range(0, (SELECT n_slots FROM n)) r(i)),
slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank
  FROM points JOIN shares ON u >= low AND u < high),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 2 * t.source_size) AS quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN coalesce(slot, n_slots + start // block) END AS first_slot
FROM (SELECT p.*, CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) AS BIGINT) AS taken FROM p) p
CROSS JOIN n LEFT JOIN slots ON slots.source IS NOT DISTINCT FROM p.source AND slots.rank = p.start // n.block
"""
