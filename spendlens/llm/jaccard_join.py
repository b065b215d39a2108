"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word-shingle hashes ("tokens").  Similar documents (equal
smallest token, sizes within the threshold's ratio) form groups.  A group
stores the union of its members' tokens -- its row of the token-group matrix --
and the overlap of a query document with that union bounds the overlap with
every member.  Only groups whose bound reaches the threshold are opened and
their members compared exactly.

Which groups a query meets at all comes from prefixes: with tokens in one
global order, two sets with Jaccard ``t`` share a token among the first
``n - ceil(t * n) + 1`` of each.  The order puts frequent tokens last (any
order is correct; frequencies only keep the lists short), so passages shared
by many documents do not bring those documents together.

Only components are wanted, so a group whose members all lie in the query's own
component stays closed.  In a cluster of near copies the lists of shared tokens are
long; the members of a long list are first compared with one of them, which
usually makes the list one component, before any of its groups is looked at.

Scale: equal sets are one representative; frequencies are counted over all
documents in hash-partitioned counters; the joins are on tokens and on groups,
and a group is split so that its members and its queries each stay within a fixed
number of tokens.  A group task returns a spanning forest of the links it finds,
never pairs.  Token sets are recomputed from the texts for the documents that
have candidates, instead of being kept.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, table
from .components import components
from .linking import COMPONENTS_SQL, confirmed, link_lists
from .tokens import shingle_sets, slices, text_buffer, trimmed

WIDTH, PERCENT = 4, 85
#: Words of a shingle and percent of similarity where documents are dropped as near duplicates.
DROP_WIDTH, DROP_PERCENT = 5, 80
#: A token in more documents than this counts as frequent; the most frequent
#: ones, so many at most (four bytes each), are sent to every task.  The bound affects only the order.
FREQUENT, FREQUENT_KEPT = 2, 1 << 22
#: Tokens of a group's members, or of the queries of one opening, in one task.
GROUP_TOKENS = 1 << 20
#: Lists of tokens that more documents than this hold are met by a join, which splits them over tasks.
LIST_ROWS = 1 << 13
#: Lists longer than this are first compared with a leader, in so many rounds (with more leaders in a second).
LED_ROWS, LED_ROUNDS = 1 << 5, 1
SLICE = 4 << 20
_KEY = np.uint64(32)


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sets(batches, width):
    """Ids and token sets of the documents, a few megabytes of text at a time."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in slices(offsets, SLICE):
            yield ids.slice(i, j - i), shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)


def _arrays(arrays, kind=pa.int64()):
    """A list column from numpy arrays."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind) if flat.dtype != np.int64 else pa.array(flat))


@trimmed
def _tally(batches, width, buckets):
    """Tokens of some documents (each document once), 32 bits each, by bucket of the
    counters: those that occur once, and the others with their counts."""
    for _, sets in _sets(batches, width):
        if not any(map(len, sets)):
            continue
        keys, times = np.unique((np.concatenate(sets) >> _KEY).astype(np.uint32), return_counts=True)
        limits = ((np.arange(buckets + 1, dtype=np.uint64) << _KEY) // np.uint64(buckets)).clip(0, (1 << 32) - 1).astype(np.uint32)
        once, often, counts = keys[times == 1], keys[times > 1], times[times > 1].astype(np.uint32)
        cut = [np.searchsorted(k, limits) for k in (once, often)]
        cut[0][-1], cut[1][-1] = len(once), len(often)
        some = np.flatnonzero(np.diff(cut[0]) + np.diff(cut[1]))
        piece = lambda k, e: pa.array([k[e[b]:e[b + 1]].tobytes() for b in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), piece(once, cut[0]), piece(often, cut[1]), piece(counts, cut[1])],
                                         ["bucket", "once", "often", "counts"])


def _count(rows: pa.Table, least: int) -> pa.Table:
    """Tokens of one bucket that more than ``least`` documents hold."""
    keys, often, counts = (np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in rows.column(c)]) for c in ("once", "often", "counts"))
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    times, keys = np.diff(np.r_[first, len(keys)]), keys[first]
    if len(often):
        more, of = np.unique(often, return_inverse=True)
        total = np.bincount(of, weights=counts).astype(np.int64)
        at = np.searchsorted(keys, more).clip(0, max(len(keys) - 1, 0))
        known = keys[at] == more if len(keys) else np.zeros(len(more), bool)
        times[at[known]] += total[known]
        keys, times = np.r_[keys[times > least], more[~known]], np.r_[times[times > least], total[~known]]
    many = times > least
    return pa.table({"token": keys[many].astype(np.int64), "times": times[many].astype(np.int64)})


def _least_times(counts: DataFrame) -> int:
    """The least count such that ``FREQUENT_KEPT`` tokens at most reach it."""
    log = F.floor(F.log2("times") * 8)
    steps = counts.groupBy(log.alias("step")).agg(F.min("times").alias("least"), F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for row in steps:
        total += row["n"]
        if total > FREQUENT_KEPT:
            break
        least = row["least"]
    return least


@trimmed
def _prefixes(batches, width, percent, frequent):
    """Per document: size, identity of the set, home group and prefix."""
    for ids, sets in _sets(batches, width):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        short = (flat >> _KEY).astype(np.uint32)
        if len(frequent):
            at = np.searchsorted(frequent, short).clip(0, len(frequent) - 1)
            often = frequent[at] == short
        else:
            often = np.zeros(len(flat), bool)
        sizes, same, home, prefix, pos = [], [], [], [], 0
        for s in sets:
            n, late = len(s), often[pos:pos + len(s)]
            pos += n
            sizes.append(n)
            same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
            band = int(np.log(n) / np.log(100 / percent)) if n else 0
            home.append(int((int(s[0]) * 0x9E3779B97F4A7C15 + band * 0xD1B54A32D192ED03) % (1 << 64)) - (1 << 63) if n else None)
            p = n - _least_overlap(n, percent) + 1
            rare = s[~late]
            prefix.append((rare[:p] if len(rare) >= p else np.concatenate([rare, s[late][:p - len(rare)]])).view(np.int64) if n else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(home, pa.int64()), _arrays(prefix)],
            ["doc_id", "n", "same", "home", "prefix"])


@trimmed
def _meet(batches, led):
    """From rows sorted by token: (query, group) of documents that share a token
    with a member of a group numbered below their own, or with one of their own.
    Lists of more than ``led`` documents come out as they are."""
    held = None
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("token", "home", "rep")])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        last = int(np.searchsorted(rows[0], rows[0, -1], "left"))
        held, rows = rows[:, last:], rows[:, :last]
        yield from _lists(rows, led)
    if held is not None:
        yield from _lists(held, led)


def _lists(rows, led):
    token, home, rep = rows
    if len(token) < 2:
        return
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    again[:-1] |= again[1:]
    token, home, rep = token[again], home[again], rep[again]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(token)] if len(token) else starts
    long = np.repeat(ends - starts > led, ends - starts)
    if long.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (token, home, rep)], ["token", "home", "rep"])
    queries, groups = [], []
    for a, b in zip(starts, ends):
        if b - a > led:
            continue
        h, r = home[a:b], rep[a:b]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        for k in range(len(edge) - 1):
            # The group's own members here, if several, and all documents of later groups.
            since = edge[k] if edge[k + 1] - edge[k] > 1 else edge[k + 1]
            if since < len(r):
                queries.append(r[since:])
                groups.append(np.full(len(r) - since, h[edge[k]]))
    if queries:
        both = np.unique(np.stack([np.concatenate(queries), np.concatenate(groups)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.nulls(both.shape[1], pa.int64()), pa.array(both[1]), pa.array(both[0])], ["token", "home", "rep"])


def _met(listed: DataFrame, counts: DataFrame, list_rows: int, led_rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (query, group) from the short ones of the tokens' lists of
    (group, document), and the rows of the long ones.

    Lists of up to ``list_rows`` documents are read by one task each.  A
    longer one never is: it goes on as rows dealt by the joins that follow."""
    # One row per such list: ``list_rows`` times fewer than there are tokens.
    long = stored(counts.where(F.col("times") > list_rows).select(F.col("token").alias("short")), "long-lists")
    listed = listed.withColumn("short", F.shiftrightunsigned("token", 32))
    cold = stored(listed.join(long, "short", "left_anti").select("token", "home", "rep").repartition("token").sortWithinPartitions("token", "home")
                  .mapInArrow(lambda it: _meet(it, led_rows), "token long, home long, rep long"), "met-short")
    hot = listed.join(long, "short", "left_semi").select("token", "home", "rep")
    led = stored(cold.where("token is not null").unionByName(hot), "listed-long")
    return cold.where("token is null").select("rep", "home").distinct(), led


def _regrouped(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups for the members of lists that leaders have not made one component, and who asks them.

    Their groups by smallest token are many, for they differ by an edit here and there.  Here a
    group is made of the members whose lists begin with the same document, in parts of
    bounded size: ``home, rep, n, label`` and distinct ``rep, home``."""
    firsts = left.groupBy("key").agg(F.min("rep").alias("first"))
    members = stored(left.join(stored(firsts, "led-firsts"), "key").groupBy("rep", "n", "label").agg(F.min("first").alias("first")), "led-members")
    parts = members.groupBy("first").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("long").alias("parts"))
    grouped = stored(members.join(stored(parts, "led-parts"), "first")
                     .withColumn("home", F.xxhash64(F.lit("again"), "first", F.pmod(F.xxhash64("rep"), "parts"))).select("home", "rep", "n", "label"), "led-grouped")
    # A group is asked by the members of other components that share a list with it; its own
    # largest component need not ask it, for everyone else of the group does.
    largest = grouped.groupBy("home", "label").agg(F.count("*").alias("held")).groupBy("home").agg(F.max_by("label", "held").alias("largest"))
    listed = stored(left.select("key", "rep", "label").join(grouped.select("rep", "home"), "rep"), "led-listed")
    groups = listed.groupBy("key", "home").agg(F.min("label").alias("low"), F.max("label").alias("high")).withColumnRenamed("home", "group")
    pairs = (listed.join(groups, "key").where("low <> high or low <> label").select("rep", "label", "home", "group").distinct()
             .join(largest.withColumnRenamed("home", "group"), "group").where("home <> group or label <> largest"))
    return grouped, pairs.select("rep", F.col("group").alias("home"))


@trimmed
def _tokens(batches, width):
    for ids, sets in _sets(batches, width):
        yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "tokens"])


def _open(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the queries and the members of one group, as a spanning forest."""
    ids = rows.column("rep").to_pylist()
    is_query = rows.column("query").to_pylist()
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in rows.column("tokens")]
    members = [k for k, q in enumerate(is_query) if not q]
    flat = np.concatenate([sets[k] for k in members]) if members else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(members)), [len(sets[k]) for k in members])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    union = flat[first]
    until = np.r_[first[1:], len(flat)] if len(flat) else first
    sizes = np.array([len(sets[k]) for k in members])
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for k, q in enumerate(is_query):
        if not q or not len(union):
            continue
        s = sets[k]
        at = np.searchsorted(union, s).clip(0, len(union) - 1)
        at = at[union[at] == s]
        if len(at) < _least_overlap(len(s), percent):
            continue  # the union holds too little of the query: the group stays closed
        counts = until[at] - first[at]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(first[at], counts)
        shared = np.bincount(owner[places], minlength=len(members))
        for m in np.flatnonzero(100 * shared >= percent * (len(s) + sizes - shared)):
            a, b = root(ids[k]), root(ids[members[m]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(ids[k])
                right.append(ids[members[m]])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, list_rows: int = LIST_ROWS, led_rows: int = LED_ROWS) -> DataFrame:
    """Near-duplicate components by exact Jaccard similarity.

    Input: ``doc_id, text`` (others are ignored).  Output, one row per input
    row: ``doc_id, n_shingles, component_id``, the smallest id reachable over links
    (``100 * intersection >= percent * union`` of the shingle sets).

    A text of fewer than ``width`` words is one shingle, its whole sequence;
    null texts and texts without words are empty and link with nothing.  Rows
    without an id link with nothing and have a null component.  Repeated rows
    have equal results; rows of one id with different texts keep a row each.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Some 16 MB of text per bucket of counters at most.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 12 + size // (16 << 20)
    counts = (texts.where("doc_id is not null").mapInArrow(lambda it: _tally(it, width, buckets), "bucket int, once binary, often binary, counts binary")
              .groupBy("bucket").applyInArrow(lambda t: _count(t, FREQUENT), "token long, times long"))
    counts = stored(counts, "token-counts")
    frequent = np.sort(counts.where(F.col("times") >= _least_times(counts)).select("token").toArrow()
                       .column("token").to_numpy().astype(np.uint32))

    sets = stored(texts.mapInArrow(lambda it: _prefixes(it, width, percent, frequent),
                                   "doc_id long, n long, same binary, home long, prefix array<long>"), "sets")
    known = sets.where("doc_id is not null and n > 0")
    reps = stored(known.groupBy("same").agg(F.min("doc_id").alias("rep")), "reps")
    single = known.join(reps, "same").where("doc_id = rep").dropDuplicates(["same"]).select("rep", "n", "home", "prefix")
    crowded = stored(single.groupBy("home").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > GROUP_TOKENS)
                     .select("home", F.ceil(F.col("tokens") / GROUP_TOKENS).cast("long").alias("parts")), "crowded")
    grouped = stored(single.join(crowded, "home", "left").withColumn(
        "home", F.when(F.col("parts").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")))
    ).drop("parts"), "grouped")

    listed = grouped.select(F.explode("prefix").alias("token"), "home", "rep")
    met, led = _met(listed, counts, list_rows, led_rows)
    led_links, labels, left = link_lists(led.select(F.col("token").alias("key"), "rep").join(grouped.select("rep", "n"), "rep"),
                                         lambda pairs: confirmed(texts, pairs, grouped, width, percent), rounds=LED_ROUNDS)
    known_as = grouped.select("home", "rep", "n")
    if labels is not None:
        known_as = known_as.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    else:
        known_as = known_as.withColumn("label", F.col("rep"))
    again, asked_again = _regrouped(left)
    met = stored(met.unionByName(asked_again).distinct(), "met")
    known_as = stored(known_as, "grouped-named")
    names, grouped = known_as.select("rep", "n", "label"), known_as.unionByName(again)
    # Queries of a group in parts of bounded size; its members go to each part.
    # A pair of sizes that cannot reach the threshold, or of one component, is dropped here.
    ranges = grouped.groupBy("home").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high"))
    sized = stored(met.join(names, "rep").join(ranges, "home")
                   .where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
                          & ((F.col("low") != F.col("high")) | (F.col("low") != F.col("label"))))
                   .select("home", "rep", "n"), "sized")
    parts = stored(sized.groupBy("home").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("long").alias("parts")), "openings")
    members = grouped.join(parts, "home").select("home", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = sized.join(parts, "home").select("home", "rep", F.pmod(F.xxhash64("rep"), "parts").alias("part"))
    roles = stored(members.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True))), "roles")
    involved = stored(roles.select(F.col("rep").alias("doc_id")).distinct(), "involved")
    # Dealt by id once, for dropping repeated rows and for the join.
    tokens = (texts.join(involved, "doc_id", "left_semi").mapInArrow(lambda it: _tokens(it, width), "rep long, tokens binary")
              .repartition("rep").dropDuplicates(["rep", "tokens"]))
    links = stored(tokens.join(roles, "rep").groupBy("home", "part")
                   .applyInArrow(lambda t: _open(t, percent), "a long, b long"), "links-found")
    found = components(links if led_links is None else links.unionByName(led_links))
    named = sets.join(reps, "same", "left")
    return (named.join(found, named["rep"] == found["node"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).alias("component_id")))


def one_of_each(docs: DataFrame, width: int = DROP_WIDTH, percent: int = DROP_PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id, all
    columns kept; rows without an id stay."""
    found = stored(jaccard_components(docs, width, percent), "found")
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # Only ids that occur more than once need their rows compared.
    again = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = docs.join(gone, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_anti")
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).select(docs.columns)


def op10_token_groups(spark, sf_dir):
    """Components over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = COMPONENTS_SQL.format(width=WIDTH, percent=PERCENT, more="")
