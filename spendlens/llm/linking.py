"""Links between the members of lists, without all pairs of a list.

A list holds documents that may be similar.  Only components are wanted, so
a pair that is already connected needs no look.  Each round, a few members of a
list lead: every other member of another component is compared with them, and
then the leaders leave the list, all their pairs being settled.  Lists whose
members are one component are finished, so a list of near copies of one text
is short after the first round.  What is left is returned, for the caller to finish.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import components
from .tokens import shingle_sets, slices, text_buffer, trimmed

#: Tokens of the documents compared with one leader in one task.
TASK_TOKENS = 1 << 20
#: Leaders of a list in the second round, and their growth from round to round.
LEADERS, GROWTH = 8, 4
SLICE = 8 << 20


@trimmed
def token_sets(batches, width):
    """Ids and sorted shingle hashes of documents, a few megabytes of text at a time."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "tokens"])


def _compare(rows: pa.Table, percent: int) -> pa.Table:
    """Members that are similar to the leader of their group."""
    ids, leads = rows.column("rep").to_pylist(), rows.column("leads").to_pylist()
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in rows.column("tokens")]
    tops = [s for s, lead in zip(sets, leads) if lead]
    home = rows.column("home")[0].as_py()
    linked = set()
    for ident, lead, s in zip(ids, leads, sets):
        for top in tops if not lead else ():
            at = np.searchsorted(top, s).clip(0, len(top) - 1)
            shared = int((top[at] == s).sum())
            if 100 * shared >= percent * (len(s) + len(top) - shared):
                linked.add(ident)
    found = sorted(linked)
    return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([home] * len(found), pa.int64())})


def confirmed(texts: DataFrame, pairs: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (``rep, leader``) whose full sets reach ``percent``, as ``a, b``.

    ``texts``: ``doc_id, text``; ``sizes``: ``rep, n``.  A leader with many
    members is compared in parts of bounded size."""
    left = sizes.select("rep", "n")
    right = sizes.select(F.col("rep").alias("leader"), F.col("n").alias("n_leader"))
    near = stored(pairs.join(left, "rep").join(right, "leader")
                  .where((F.least("n", "n_leader") * 100 >= F.greatest("n", "n_leader") * percent))
                  .select("rep", F.col("leader").alias("home"), "n"), "pairs-sized")
    parts = stored(near.groupBy("home").agg(F.ceil(F.sum("n") / TASK_TOKENS).cast("long").alias("parts")), "pairs-parts")
    leads = parts.select("home", F.col("home").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
    roles = stored(near.join(parts, "home").select("home", "rep", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(False).alias("leads"))
                   .unionByName(leads), "pairs-roles")
    involved = stored(roles.select(F.col("rep").alias("doc_id")).distinct(), "pairs-involved")
    tokens = (texts.join(involved, "doc_id", "left_semi").mapInArrow(lambda it: token_sets(it, width), "rep long, tokens binary")
              .repartition("rep").dropDuplicates(["rep", "tokens"]))
    return stored(tokens.join(roles, "rep").groupBy("home", "part").applyInArrow(lambda t: _compare(t, percent), "a long, b long"), "pairs-linked")


def link_lists(lists: DataFrame, check: Callable[[DataFrame], DataFrame], rounds: int, leaders: int = LEADERS,
               growth: int = GROWTH) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Links between members of ``lists`` (``key, rep, n``, distinct rows) that ``check``
    finds in some rounds, the components they make (``node, component``), and
    the rows of lists not settled by then, with each member's ``label``.  Links and
    components are None if there is no link.

    ``check`` takes distinct ``rep, leader`` and returns links ``a, b``.  Every pair of
    a list is checked, lies in one component or is in the rows returned."""
    several = lists.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).where("leader <> most").drop("most")
    met = stored(lists.join(stored(several, "lists-first"), "key").where("rep <> leader"), "lists-open")
    pairs, rest = stored(met.select("rep", "leader").distinct(), "pairs"), met.drop("leader")
    links = labels = None
    done = 0
    while True:
        if not pairs.isEmpty():
            found = check(pairs)
            links = found if links is None else stored(links.unionByName(found), "links-all")
            labels = components(links)
        done += 1
        named = rest.withColumn("label", F.col("rep")) if labels is None else (
            rest.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"))
        named = stored(named, "lists-named")
        still = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).where("low < high")
        named = stored(named.join(stored(still.select("key", "members"), "lists-still"), "key"), "lists-left")
        if done >= rounds or named.isEmpty():
            return links, labels, named.drop("members")
        # A member leads if its hash is in the round's share of the list.
        lead = F.pmod(F.xxhash64("rep", F.lit(done)), F.lit(1 << 40)) * F.col("members") < F.lit(leaders * growth ** (done - 1)) * F.lit(1 << 40)
        open_ = stored(named.withColumn("leads", lead).drop("members"), "lists-open")
        tops = open_.where("leads").select("key", F.col("rep").alias("leader"), F.col("label").alias("top"))
        fresh = open_.join(tops, (open_["key"] == tops["key"]) & (open_["label"] != tops["top"]) & (~open_["leads"] | (open_["rep"] > tops["leader"])))
        pairs = stored(fresh.select("rep", "leader").distinct(), "pairs")
        rest = open_.where("not leads").select("key", "rep", "n")


#: Components over links of shingle sets, for DuckDB; ``width``, ``percent`` and the last columns are filled in.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {width} - 1), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width} + 1, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT node, b FROM reach JOIN edges ON other = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{more}
FROM w LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = doc_id
"""
