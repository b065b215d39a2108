"""Sharding along a Hilbert curve over metadata dimensions.

Source, language and text size are quantised to equally filled levels, each
document gets the Hilbert index of its cell, documents are ordered by cell,
and the order is cut into shards of equally many rows; ``write_shards`` moves
whole rows into files of one shard each.  A file therefore spans a small box of
every dimension and its statistics prune filters on any of them.

Scale: the global rank is a prefix sum over cells plus one over pseudo-random
ranges inside the cell plus a rank in the range, so neither one cell with most
rows nor one huge group of copies meets in one task.  Only the per-cell counts
(``LEVELS ** 3`` at most) pass through a single window.  Texts are read twice
and shuffled twice, to their places and into the ranges that become files; both
sides of the first are stored, so nothing else of their size is kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import shared_path
from .common import SPREAD, column, content_key, spread_key, stored, table, text_or_empty

BITS = 4
LEVELS = 1 << BITS
DIMS = ("source", "lang", "size_bin")
#: About so many rows share one range of the pseudo-random key.
RANGE_ROWS = 1000
#: Bytes of text in a file, about.
FILE_BYTES = 64 << 20
PLACE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def curve(bits: int = BITS, dims: int = len(DIMS)) -> list[int]:
    """Hilbert index of every cell, the cell numbered by its coordinates as
    base-``2**bits`` digits, first dimension first.

    Built by recursion on the curve's defining property: a cube's sub-cubes are
    visited in Gray-code order, each entered at a corner next to the last one's
    exit, with its axes rotated accordingly.
    """
    corner = lambda i: i ^ (i >> 1)  # noqa: E731  Gray code
    full = (1 << dims) - 1
    turn = lambda x, k: ((x << k) | (x >> (dims - k))) & full if k else x
    order = [0] * (1 << (bits * dims))
    count = 0

    def entry(i: int) -> int:
        return 0 if i == 0 else corner(2 * ((i - 1) // 2))

    def axis(i: int) -> int:
        if i == 0:
            return 0
        flip = i if i % 2 else i - 1
        return ((~flip & (flip + 1)).bit_length() - 1) % dims

    def visit(level: int, at: tuple[int, ...], enter: int, along: int) -> None:
        nonlocal count
        if level < 0:
            cell = 0
            for c in at:
                cell = cell * (1 << bits) + c
            order[cell] = count
            count += 1
            return
        for i in range(1 << dims):
            sub = turn(corner(i), along + 1 if along + 1 < dims else 0) ^ enter
            nxt = enter ^ turn(entry(i), along + 1 if along + 1 < dims else 0)
            visit(level - 1, tuple(c | (((sub >> k) & 1) << level) for k, c in enumerate(at)),
                  nxt, (along + axis(i) + 1) % dims)

    visit(bits - 1, (0,) * dims, 0, 0)
    return order


def _levels(df: DataFrame, column: str) -> DataFrame:
    """``column, <column>_level``: values in order (null last) cut into levels of
    about equally many rows.  One row per distinct value passes through the window."""
    w = W.orderBy(F.col(column).asc_nulls_last())
    n = F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("n") / 2) / n
    return (df.groupBy(column).agg(F.count("*").alias("n"))
            .withColumn(f"{column}_level", F.least(F.floor(middle * LEVELS), F.lit(LEVELS - 1)))
            .select(F.col(column).alias(f"{column}_value"), f"{column}_level"))


#: Columns that the files have besides those of the rows.
FILE_COLUMNS = ("slot", "curve_index", "shard")


def _own_names(names: list[str]) -> list[str]:
    """Names of the rows' columns in the files: one that is also a name of a place
    (in any case) gets ``_1`` appended until it is free."""
    used, out = {c.lower() for c in FILE_COLUMNS}, []
    others = [c.lower() for c in names]
    for name in names:
        new = name
        while new.lower() in used or (new != name and new.lower() in others):
            new += "_1"
        used.add(new.lower())
        out.append(new)
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document.

    Input: ``doc_id, text, source, lang`` (others are ignored).  Output, one row
    per input row: ``doc_id, size`` (UTF-8 bytes + 1), ``text_crc32, law``
    (``rows``), ``shard, slot, grown_shard`` (null), ``curve_index``.

    Row counts of the shards differ by one at most.  Null texts count as empty;
    null sources and languages are values after all others; repeated rows keep
    places of their own; ties fall by id, then by text.  An empty table gives an
    empty result.
    """
    return _places(docs, shards).select("doc_id", *PLACE)


def _places(docs: DataFrame, shards: int) -> DataFrame:
    """The columns of :func:`shard` and each row's ``mark``."""
    text = text_or_empty()
    digest = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        spread_key(F.col("doc_id")).alias("key"), content_key(docs).alias("mark")
    ).withColumn("size_bin", F.floor(F.log2("size") * 8)), "shard-docs")
    n = digest.count()
    parts = n // RANGE_ROWS + 1
    cells = digest
    for d in DIMS:
        level = stored(_levels(digest, d), f"shard-{d}")
        cells = (cells.join(level, cells[d].eqNullSafe(level[f"{d}_value"])).drop(f"{d}_value"))
    cell = sum((F.col(f"{d}_level") * (LEVELS ** (len(DIMS) - 1 - k)) for k, d in enumerate(DIMS)), F.lit(0))
    index = (docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, curve()))), ",")))
             .select(F.col("pos").cast("long").alias("cell"), F.col("col").cast("long").alias("curve_index")))
    cells = (cells.withColumn("cell", cell.cast("long")).join(F.broadcast(index), "cell")  # LEVELS ** 3 rows
             .withColumn("part", F.floor(F.col("key") / F.lit(SPREAD // parts + 1)))
             .select("doc_id", "size", "text_crc32", "key", "mark", "curve_index", "part"))
    cells = stored(cells, "shard-cells")

    before = W.rowsBetween(W.unboundedPreceding, -1)
    in_parts = cells.groupBy("curve_index", "part").agg(F.count("*").alias("n"))
    part_start = in_parts.withColumn("part_start", F.coalesce(
        F.sum("n").over(W.partitionBy("curve_index").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    cell_start = (cells.groupBy("curve_index").agg(F.count("*").alias("n"))
                  .withColumn("cell_start", F.coalesce(F.sum("n").over(W.orderBy("curve_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                  .drop("n"))
    starts = stored(part_start.join(cell_start, "curve_index")
                    .select("curve_index", "part", (F.col("part_start") + F.col("cell_start")).alias("start")), "shard-starts")
    inside = W.partitionBy("curve_index", "part").orderBy("key", "doc_id", "size", "text_crc32", "mark")
    rank = F.col("start") + F.row_number().over(inside) - 1
    ranked = cells.join(starts, ["curve_index", "part"]).withColumn("rank", rank.cast("long"))
    return (ranked.withColumn("shard", F.expr(f"int(rank * {shards} div {max(n, 1)})"))
            .select("doc_id", "mark", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("rank") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "curve_index"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Writes whole rows as Parquet, one folder ``shard=<k>`` per shard, each file
    a range of slots in order, and returns a reader of them.

    The files have the columns of ``docs`` and ``slot, curve_index``; a column of
    ``docs`` that is named like one of these or like ``shard`` gets ``_1`` appended.  Rows meet
    their places by id and content; the k-th of equal rows takes the k-th place.
    Nulls and empty texts are as in :func:`shard`; columns of any type pass
    through; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    places = stored(_places(docs, shards).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", F.struct("shard", "slot", "curve_index").alias("place"), "size"), "shard-places")
    size = places.agg(F.sum("size")).first()[0] or 0
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), content_key(docs).alias("mark"),
                       F.struct(*[column(c).alias(n) for c, n in zip(docs.columns, _own_names(docs.columns))]).alias("row"))
    both = rows.unionByName(places.drop("size"), allowMissingColumns=True)
    turn = W.partitionBy("id", "mark", F.col("place").isNull()).orderBy("place")
    # One shuffle by id and mark serves the numbers and the pairs.
    pairs = (both.repartition("id", "mark").withColumn("k", F.row_number().over(turn)).groupBy("id", "mark", "k")
             .agg(F.first("row", True).alias("row"), F.first("place", True).alias("place")))
    placed = pairs.select("row.*", "place.slot", "place.curve_index", "place.shard")
    files = shards * (size // (shards * FILE_BYTES) + 1)
    (placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path))
    return spark.read.schema(placed.schema).parquet(path)


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The columns of :func:`shard`, derived from the files of :func:`write_shards`
    in the shared folder; nulls, repeated rows, empty tables and further columns are as there."""
    out = write_shards(docs, shared_path(docs.sparkSession, "shards"), shards)
    text = text_or_empty()
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                      F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def op6_hilbert_shards(spark, sf_dir):
    """Digest of the files of :func:`write_shards` over all documents."""
    return sharded(table(spark, sf_dir, "documents"))
