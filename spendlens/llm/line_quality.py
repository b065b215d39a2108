"""Quality rules from cross-document line frequency.

Lines are normalised and hashed; for every host (the ``source`` column) the
documents that hold a line are counted; lines above the limits are taken out,
and a document that loses too many of its words is rejected.  Per-document
rules (word count, repeated 3-word windows) are computed in the same pass.

Scale: the stored digest has counts and one ``(place, hash)`` entry per line.
Line counts are pre-aggregated per task; the frequent lines are a stored table
of their own, so the join back is a plain two-sided join whose hot keys AQE
splits (or a broadcast when that table's files are small).  The lines to take
out go back to the texts by document and text hash: the texts are read a second
time and shuffled once at most, and nothing else of their size is written.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, SPACE_CHARS, WORD, stored, table, text_or_empty, word_count, words

#: Fixed value: the symbols the contract counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is boilerplate if more documents than this, and more than this share of the host's, hold it.
MAX_DOCS, MAX_SHARE = 10, 0.0
#: A document is kept if at least this share of its words is outside such lines.
MIN_LEFT = 0.5


def _mark() -> Column:
    """Tells a document's rows of different texts or hosts apart; equal rows lose equal lines."""
    return F.xxhash64("source", F.col("source").isNull(), text_or_empty())


def _digest(docs: DataFrame) -> DataFrame:
    """Counts of every document and its normalised lines with their places."""
    text = F.col("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"),
                       text_or_empty().alias("text"), _mark().alias("mark"))
    # Windows of three words by hash; a window's place is kept, so windows found
    # again are those with an equal neighbour once sorted by hash.
    grams = (base.withColumn("w", words(text))
             .withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
             .withColumn("n_words", F.size("w").cast("long"))
             .withColumn("h", F.expr(
                 "CASE WHEN n_words > 2 THEN transform(sequence(0, int(n_words) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
             .drop("w"))
    placed = (grams.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
              .withColumn("s", F.expr("CASE WHEN again THEN sort_array(transform(h, (x, i) -> struct(x, i))) END"))
              .drop("h", "again"))
    found = placed.withColumn("p", F.expr(
        "sort_array(transform(filter(s, (e, j) -> (j > 0 AND s[j - 1].x = e.x) OR (j < size(s) - 1 AND s[j + 1].x = e.x)), e -> e.i))")
    ).drop("s")
    covered = F.expr("coalesce(aggregate(transform(p, (x, j) -> CASE WHEN j < size(p) - 1 THEN least(3, p[j + 1] - x) ELSE 3 END),"
                     " 0L, (a, x) -> a + x), 0L)")
    norm = F.expr(rf"filter(transform(split(text, '\n'), (l, i) -> struct(i AS at, CASE WHEN l RLIKE '{WORD}' THEN"
                  rf" xxhash64(trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0'), '[{SPACE}]+', ' '))) END AS line)),"
                  " x -> x.line IS NOT NULL)".replace("\\", "\\\\"))
    return found.select(
        "doc_id", "host", "mark", "n_words",
        F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), norm.alias("lines"))


def line_quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE,
                 min_left: float = MIN_LEFT) -> DataFrame:
    """Takes the lines above the limits out of every document and judges it.

    Input: ``doc_id, text, source`` (others are ignored).  Output, one row per
    input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, boiler_words, text``.  ``text`` is what
    remains: the lines that are not above the limits, blank ones included, in
    order and unchanged; the counts but ``boiler_words`` are of the text as it came.

    Null and empty texts have zero counts and fail (no words); null hosts are
    one host; repeated rows count as documents of their own; lines are compared
    lower-cased with runs of digits as one 0 and runs of spaces as one.  An
    empty table gives an empty result.
    """
    # The row number only ties a stored row to its lines; it is fixed once written.
    digest = stored(_digest(docs).withColumn("row", F.monotonically_increasing_id()), "lines-digest")
    lines = digest.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.at")
    distinct = digest.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    limits = digest.groupBy("host").agg(F.greatest(F.lit(float(max_docs)), F.count("*") * F.lit(max_share)).alias("limit"))
    counted = distinct.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    if max_share > 0:
        counted = (counted.join(limits.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
                   .where("n_docs > limit").select("host", "line", "n_docs"))
    frequent = stored(counted.select(F.xxhash64("host", F.col("host").isNull(), "line").alias("key")), "lines-frequent")
    gone = (lines.select("row", "at", F.xxhash64("host", F.col("host").isNull(), "line").alias("key"))
            .join(frequent, "key").groupBy("row").agg(F.collect_list("at").alias("gone")))
    # One row for equal rows of a document; stored, so the texts meet a plain exchange.
    judged = stored(digest.drop("lines", "host").join(gone, "row", "left").drop("row").dropDuplicates(["doc_id", "mark"]), "lines-judged")
    left_lines = F.expr("transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i])")
    rest = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left_lines, "\n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _mark().alias("m"), text_or_empty().alias("text"))
    left = (texts.join(judged, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))
            .withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("text", "\n"))).withColumn("text", rest)
            .withColumn("n_left", word_count(F.col("text"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (left.withColumn("base_failed", failed).withColumn("boiler_words", F.col("n_words") - F.col("n_left"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= F.lit(min_left) * F.col("n_words")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "boiler_words", "text"))


def op4_line_quality(spark, sf_dir):
    """Verdict of :func:`line_quality` on all documents; words taken out are counted on the texts it leaves."""
    return line_quality(table(spark, sf_dir, "documents")).drop("text")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
h AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS c FROM h) WHERE c > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row),
ls AS (SELECT row, host, unnest(lines) AS l FROM d),
nl AS (SELECT row, host, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
              len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM ls),
f AS (SELECT host, line FROM nl GROUP BY host, line HAVING count(DISTINCT row) > 10),
b AS (SELECT nl.row, sum(words) AS n FROM nl JOIN f ON nl.host IS NOT DISTINCT FROM f.host AND nl.line = f.line GROUP BY nl.row),
r AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS boiler_words
  FROM d LEFT JOIN covered c USING (row) LEFT JOIN b USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - boiler_words >= 0.5 * n_words AS kept, boiler_words
FROM r
"""
