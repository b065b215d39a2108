"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the question is containment:
which share of an item's word shingles occurs in a document.  Items are
partitioned by shingle count, by powers of two; partition ``c`` asks for ``1 + c // 2``
common MinHash values (``_votes``).  An item of ``n`` shingles of a partition that
asks for ``v`` is sketched by its ``n - ceil(t * n) + v`` smallest shingle hashes,
the MinHash values of one permutation.  A document that contains a share ``t`` of
the item misses ``n - ceil(t * n)`` shingles at most, so it holds ``v`` sketch
values: the search finds every such document, and one that shares a single
sentence with a long item is no candidate.  A document looks up only hashes below
the largest sketch value of all size partitions.  Every candidate pair is then
verified by exact shingle containment.

Scale: documents are scanned, exploded and looked up without a shuffle while
the sketch's stored files are under the broadcast threshold, and shuffled by
shingle hash beyond it.  Only candidate documents are read a second time.
Items with equal shingle sets are searched once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, stored, table, text_or_empty, words

WIDTH = 5
THRESHOLD = 0.8


def _shingles(df: DataFrame, width: int, short: bool) -> DataFrame:
    """``df`` (with ``w``, the lower-cased words) with ``g``: distinct hashes of
    the ``width``-word windows; ``short``: of the whole sequence if it has fewer words."""
    cells = ", ".join(f"w[i + {k}]" for k in range(width))
    whole = "WHEN size(w) > 0 THEN array(xxhash64(concat_ws(' ', w)))" if short else ""
    return df.withColumn("g", F.expr(
        f"CASE WHEN size(w) >= {width} THEN array_distinct(transform(sequence(0, size(w) - {width}), i -> xxhash64({cells}))) {whole} END"))


def _lookup(df: DataFrame, width: int, short: list[int]) -> DataFrame:
    """``df`` with ``g``: hashes of its windows, and of its shorter windows of the
    lengths that some item has as a whole."""
    df = _shingles(df, width, False)
    for n in short:
        df = df.withColumn("g", F.expr(
            f"CASE WHEN size(w) >= {n} THEN concat(coalesce(g, array()), array_distinct(transform(sequence(0, size(w) - {n}),"
            f" i -> xxhash64(concat_ws(' ', slice(w, i + 1, {n})))))) ELSE g END"))
    return df


def _votes(size_class, needed):
    """Sketch values that a document must share with an item of a size partition, at most as many as it shares shingles."""
    return F.least(F.lit(1) + F.floor(size_class / F.lit(2)), needed).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Pairs of a document and a test item it contains.

    Input: ``doc_id, text`` and ``item_id, text`` (others are ignored).
    Output: ``doc_id, item_id, n_shared, n_item, containment``; ``item_id`` is
    the smallest of the items with the same shingle set.  Words are compared
    with A-Z lower-cased.

    Null texts, empty texts and items without words match nothing; an item
    of fewer than ``width`` words is one shingle, its whole word sequence.
    Repeated rows (same id and text) give one result; rows of one id with
    different texts are searched separately and may each give a pair.  Empty
    tables give an empty result.
    """
    bench = _shingles(items.select(F.col("item_id").cast("long").alias("item_id"),
                                   words(ascii_lower(text_or_empty())).alias("w")), width, True).where("g IS NOT NULL")
    bench = stored(bench.groupBy(F.sort_array("g").alias("g")).agg(F.min("item_id").alias("item_id"), F.min(F.size("w")).alias("n_words"))
                   .withColumn("n_item", F.size("g")), "bench-items")
    short = [r["n_words"] for r in bench.where(F.col("n_words") < width).select("n_words").distinct().orderBy("n_words").collect()]
    needed = F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    sketch = stored(bench.withColumn("size_class", F.floor(F.log2("n_item")).cast("int")).withColumn("needed", needed)
                    .withColumn("votes", _votes(F.col("size_class"), F.col("needed")))
                    .select("item_id", "size_class", "votes", F.explode(F.slice("g", 1, F.col("n_item") - F.col("needed") + F.col("votes"))).alias("h")),
                    "bench-sketch")
    # How far any size partition looks into the hash order: a longer partition's sketch ends earlier in it.
    reach = sketch.groupBy("size_class").agg(F.max("h").alias("reach")).agg(F.max("reach")).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .withColumn("key", F.xxhash64("doc_id", "text"))
    looked = _lookup(texts.withColumn("w", words(ascii_lower(F.col("text")))), width, short).select("doc_id", "key", "g")
    reach = -(1 << 63) if reach is None else reach
    hits = (looked.select("key", F.explode(F.filter("g", lambda x: x <= F.lit(reach))).alias("h"))
            .join(sketch.select("h", "item_id", "votes"), "h"))
    # Repeated rows vote again: more candidates, which the verification sorts out.
    candidates = stored(hits.groupBy("key", "item_id").agg(F.count("*").alias("shared"), F.first("votes").alias("votes"))
                        .where("shared >= votes").select("key", "item_id"), "bench-candidates")

    item_grams = bench.select("item_id", "n_item", F.explode("g").alias("h"))
    again = texts.join(candidates.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    grams = (_lookup(again.withColumn("w", words(ascii_lower(F.col("text")))), width, short)
             .select("doc_id", "key", F.explode("g").alias("h")))
    shared = (grams.join(item_grams, "h").groupBy("doc_id", "key", "item_id")
              .agg(F.count("*").alias("n_shared"), F.first("n_item").cast("long").alias("n_item")))
    return (shared.join(candidates, ["key", "item_id"], "left_semi")
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") >= needed)
            .select("doc_id", "item_id", "n_shared", "n_item", "containment"))


def op8_contained_items(spark, sf_dir):
    """All contaminated documents with the items they contain."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item, all columns kept.  Rows
    without an id are compared by text like any other."""
    key = F.xxhash64(F.col("text"))
    # The text's hash stands in for the id, so equal texts are searched once and rows without an id are judged too.
    found = contained_items(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("text_key_")).distinct()
    found = stored(found, "bench-found")
    return docs.join(found, key == F.col("text_key_"), "left_anti")


_WINDOWS = r"""
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
bn AS (SELECT item_id, count(*) AS n_item, list_sort(list(g)) AS gs FROM bg GROUP BY item_id),
bc AS (SELECT min(item_id) AS item_id, n_item, gs FROM bn GROUP BY gs, n_item),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
dg AS (SELECT DISTINCT row, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
m AS (SELECT dg.row, dg.doc_id, bc.item_id, n_item, count(*) AS n_shared FROM dg JOIN bg ON dg.g = bg.g JOIN bc ON bc.item_id = bg.item_id GROUP BY ALL)
"""
SQL = ("WITH " + _WINDOWS.replace("{t}", "text") +
       "SELECT DISTINCT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m WHERE n_shared >= ceil(0.8 * n_item - 1e-9)")
