"""Z-fast trie over conversations: which beginnings do conversations share?

A conversation is a sequence of turns; the trie has a node for every distinct
beginning.  It is held compacted: only nodes that branch or end a conversation
are kept, each with the edge of single-child nodes above it.  A compacted node
on the edge ``(above, depth]`` is found by its handle, the hash of the
beginning whose length is the 2-fattest number of that interval (the one with
the most trailing zero bits).

* The hash of a beginning is the exclusive or of hashes of (position, turn), two
  words of 64 bits, so beginnings of a conversation that spans several tasks are
  joined up by one value per task.
* Distinct sequences are inserted in batches of growing size.  For each sequence a fat
  binary search over handles, one equi-join per halving, finds the deepest node
  it passes whole; only turns below that node, and the one edge it may leave
  inside, are looked at again.  Grouping those rows by the hash of their
  parent tells which of them branch.
* Counts over subtrees are sums over the sequences below a node; edges
  are expanded last, each from its smallest conversation.

All tables are rows per turn, per sequence or per node; none holds a
conversation or a node's members in one value.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, table

#: Conversations that share their first turns, and the number of lengths of that shared part.
FAMILY, HEADS = 100, 6
#: Hashes of so many depths of a sequence are in one row of the search (a power of two).
BLOCK = 1 << 10
#: Each batch is so many times as large as those before it together.
GROWTH, BATCHES = 4, 3
#: Joins of the search in one job.
ROUNDS = 6
#: Characters of an id list that are one row on the way to its hash.
PIECE = 1 << 16
#: A node of the trie; keys are two words of the hash of a beginning.
_NODE = "x1 long, x2 long, depth long, above long, sample long, p1 long, p2 long, c1 long, c2 long, h1 long, h2 long"


def _empty_hash() -> str:
    return hashlib.sha256(b"").hexdigest()


# -- turns in order ------------------------------------------------------------

def _firsts(keys: np.ndarray, last) -> np.ndarray:
    """Index of the first row of each row's key, or -1 if the key began before this batch."""
    new = np.r_[len(keys) > 0 and (last is None or keys[0] != last), keys[1:] != keys[:-1]][:len(keys)]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))


def _scan(batches, key, sums, xors):
    """From rows sorted by ``key``: running sums and exclusive ors within each key (of this task)."""
    last, held = None, {c: 0 for c in (*sums, *xors)}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        first = _firsts(keys, last)
        columns = {name: batch.column(name) for name in batch.schema.names}
        for names, scan, undo in ((sums, np.cumsum, np.subtract), (xors, np.bitwise_xor.accumulate, np.bitwise_xor)):
            for name in names:
                run = scan(columns[name].to_numpy().astype(np.int64))
                before = np.r_[np.int64(0), run[:-1]]
                out = np.where(first < 0, run + held[name] if undo is np.subtract else run ^ np.int64(held[name]), undo(run, before[np.maximum(first, 0)]))
                held[name] = int(out[-1])
                columns[f"{name}_run"] = pa.array(out)
        last = keys[-1]
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _running(df: DataFrame, key: str, order: list, name: str, sums=(), xors=()) -> DataFrame:
    """``df`` stored with running values ``<column>_run`` over the rows of each ``key``.

    ``order[0]`` deals the rows of one key over tasks, so a key may span several;
    what its earlier tasks add is one row per task and is added after."""
    dealt = (df.repartitionByRange(key, order[0]).sortWithinPartitions(key, *order)
             .withColumn("task", F.spark_partition_id()))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema] + [f"{c}_run long" for c in (*sums, *xors)])
    run = stored(dealt.mapInArrow(lambda it: _scan(it, key, sums, xors), schema), name)
    # Keys at the edges of tasks, two a task at most.
    edges = run.groupBy("task").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("task").collect()
    split = sorted({a["high"] for a, b in zip(edges, edges[1:]) if a["high"] == b["low"]})
    if not split:
        return run.drop("task")
    parts = run.where(F.col(key).isin(split)).groupBy(key, "task").agg(
        *[F.sum(c).alias(f"{c}_add") for c in sums], *[F.bit_xor(c).alias(f"{c}_add") for c in xors])
    before = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    adds = parts.select(key, "task", *[F.sum(f"{c}_add").over(before).alias(f"{c}_add") for c in sums],
                        *[F.bit_xor(F.col(f"{c}_add")).over(before).alias(f"{c}_add") for c in xors])
    both = run.join(F.broadcast(adds), [key, "task"], "left")
    for c in sums:
        both = both.withColumn(f"{c}_run", F.col(f"{c}_run") + F.coalesce(f"{c}_add", F.lit(0)))
    for c in xors:
        both = both.withColumn(f"{c}_run", F.col(f"{c}_run").bitwiseXOR(F.coalesce(f"{c}_add", F.lit(0))))
    return stored(both.drop("task", *[f"{c}_add" for c in (*sums, *xors)]), name)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the rebuilt conversations.

    Every conversation ``c`` begins with the first ``h`` turns of ``c - c % 100``, ``h``
    given by its id, and goes on with its own turns after its first ``h``.
    Turns: ``conv, d, t1, t2, len`` (hashes and code points of the turn at
    depth ``d``); ids: ``conv``, those without turns included.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("pos"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    turns = (_running(rows, "conv", order, "trie-turns", sums=["pos"])
             .select("conv", F.col("pos_run").alias("pos"), F.xxhash64("role", "text").alias("t1"),
                     F.xxhash64(F.lit("t"), "text", "role").alias("t2"), F.char_length("text").cast("long").alias("len")))
    heads = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("long")
    family = F.col("conv") - F.col("conv") % FAMILY
    ids = stored(turns.groupBy("conv").agg(F.lit(True).alias("any")).select("conv", family.alias("family"), heads.alias("h")), "trie-ids")
    # At most HEADS - 1 turns for each first conversation of a family, and that conversation for at most 2 * FAMILY others.
    shared = stored(turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)), "trie-heads")
    head = (ids.join(shared.withColumnRenamed("conv", "family"), "family").where("pos <= h")
            .select("conv", F.col("pos").alias("d"), "t1", "t2", "len"))
    sizes = shared.groupBy(F.col("conv").alias("family")).agg(F.max("pos").alias("n"))
    own = (turns.withColumn("h", heads).where("pos > h").withColumn("family", family)
           .join(stored(sizes, "trie-head-sizes"), "family", "left")
           .select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("d"), "t1", "t2", "len"))
    return head.unionByName(own), ids.select("conv")


def beginnings(turns: DataFrame) -> DataFrame:
    """``conv, d, x1, x2, p1, p2, len, until``: each beginning's hash, that of the one a
    turn shorter, the code points of its last turn and of all its turns."""
    rows = turns.select("conv", "d", "len", F.xxhash64("d", "t1", "t2").alias("x1"), F.xxhash64("t2", "d", "t1").alias("x2"))
    run = _running(rows, "conv", [F.asc("d")], "trie-beginnings", sums=["len"], xors=["x1", "x2"])
    return run.select("conv", "d", F.col("x1_run").alias("x1"), F.col("x2_run").alias("x2"),
                      F.expr("x1_run ^ x1").alias("p1"),
                      F.expr("x2_run ^ x2").alias("p2"), "len", F.col("len_run").alias("until"))


# -- the trie --------------------------------------------------------------------

def _fattest(low: str, high: str) -> str:
    """SQL: the 2-fattest number of ``(low, high]``, ``low < high``."""
    shift = f"cast(floor(log2({low} ^ {high})) as int)"
    return f"shiftleft(shiftright({high}, {shift}), {shift})"


def _halve(state: DataFrame, handles: DataFrame, block: str) -> DataFrame:
    """One step of the fat binary search with the hashes at hand: ``hashes`` holds depths ``base + step, base + 2 * step``, ..."""
    probing = f"low < high and ({block})"
    at = state.withColumn("f", F.expr(f"if({probing}, {_fattest('low', 'high')}, cast(null as long))"))
    at = at.withColumn("key", F.expr("get(hashes, cast((f - base) div step - 1 as int))"))
    # Sequences that have ended get keys of their own, which no handle has, so that they do not meet in one task.
    at = at.withColumn("h1", F.expr("coalesce(key.x1, s)")).withColumn("h2", F.expr("coalesce(key.x2, xxhash64(s, 'ended'))"))
    found = at.join(handles.select("h1", "h2", F.col("depth").alias("to"), F.col("above").alias("to_above")), ["h1", "h2"], "left")
    return found.select(
        "s", "length", "base", "step", "hashes",
        F.expr("case when f is null or to is null then low when to <= length then to else to_above end").alias("low"),
        # A handle on an edge that goes deeper than the sequence: it ends on that edge.
        F.expr("case when f is null then high when to is null then f - 1 when to <= length then high else to_above end").alias("high"),
        F.expr("case when f is not null and to <= length then to_above else came end").alias("came"))


def _locate(batch: DataFrame, nodes: DataFrame, rows: DataFrame, longest: int, block: int) -> DataFrame:
    """``s, a``: depth of the deepest node that each sequence of ``batch`` passes whole."""
    state = batch.select("s", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"), F.lit(0).cast("long").alias("came"))
    arranged = lambda r: F.transform(F.array_sort(F.collect_list(F.struct("d", "x1", "x2"))), lambda x: F.struct(x["x1"].alias("x1"), x["x2"].alias("x2"))).alias("hashes")

    def rounds(state, span, condition):
        left = int(span).bit_length() + 1
        while left > 0:
            for _ in range(min(left, ROUNDS)):
                state = _halve(state, nodes, condition)
            left -= ROUNDS
            state = stored(state, "trie-search")
        return state.drop("base", "step", "hashes")

    if longest >= block:
        # First by the hashes at whole blocks: the 2-fattest number is one of them while there is one.
        marks = rows.where(F.col("d") % block == 0).groupBy("s").agg(arranged(rows))
        state = rounds(state.join(marks, "s", "left").withColumns({"base": F.lit(0).cast("long"), "step": F.lit(block).cast("long")}),
                       longest // block, f"low div {block} <> high div {block}")
    blocks = rows.groupBy("s", F.expr(f"(d - 1) div {block} * {block}").alias("base")).agg(arranged(rows))
    state = rounds(state.withColumn("base", F.expr(f"low div {block} * {block}")).join(blocks, ["s", "base"], "left")
                   .withColumn("step", F.lit(1).cast("long")), min(longest, block), "true")
    # A handle only shows that the beginning up to it is shared; the node found last is looked at whole.
    ends = rows.select("s", F.col("d").alias("low"), "x1", "x2")
    whole = nodes.select("x1", "x2", F.lit(True).alias("whole"))
    return (state.join(ends, ["s", "low"], "left").join(whole, ["x1", "x2"], "left")
            .select("s", F.expr("if(low = 0 or whole, low, came)").alias("a")))


def _insert(batch: DataFrame, nodes: DataFrame | None, rows: DataFrame, longest: int, block: int) -> DataFrame:
    """The nodes of the trie after the sequences of ``batch`` are inserted."""
    if nodes is None:
        below = stored(rows.join(batch.select("s", "length"), "s").select("s", F.lit(0).cast("long").alias("a"), "d", "x1", "x2", "p1", "p2", F.expr("d = length").alias("stop")), "trie-below")
    else:
        found = stored(_locate(batch, nodes, rows, longest, block).join(batch.select("s", "length"), "s"), "trie-located")
        new = stored(rows.join(found, "s").where("d > a").select("s", "a", "d", "x1", "x2", "p1", "p2", F.expr("d = length").alias("stop")), "trie-new")
        # The edge on which a sequence may leave the trie begins with the sequence's next turn.
        left = stored(nodes.join(new.where("d = a + 1").select(F.col("x1").alias("c1"), F.col("x2").alias("c2")).distinct(), ["c1", "c2"])
                      .select("sample", "above", "depth", "x1", "x2"), "trie-left")
        edge = (left.withColumnsRenamed({"sample": "s", "x1": "n1", "x2": "n2"}).join(rows, "s").where("d > above and d <= depth")
                .select("s", F.col("above").alias("a"), "d", "x1", "x2", "p1", "p2", F.expr("d = depth").alias("stop")))
        below = stored(new.unionByName(edge), "trie-below")
    branching = (below.where("d > a + 1").groupBy("p1", "p2")
                 .agg(*[f(c).alias(f"{n}_{c}") for c in ("x1", "x2") for n, f in (("low", F.min), ("high", F.max))])
                 .where("low_x1 < high_x1 or low_x2 < high_x2").select(F.col("p1").alias("x1"), F.col("p2").alias("x2")))
    keys = stored(branching.unionByName(below.where("stop").select("x1", "x2")).distinct(), "trie-keys")
    on_path = below.join(keys, ["x1", "x2"]).select("s", "a", "d", "x1", "x2")
    above = Window.partitionBy("s").orderBy("d")
    made = (on_path.withColumn("above", F.coalesce(F.lag("d").over(above), "a"))
            # Equal rows of a sequence and of an edge's sample: any one of them will do.
            .where("above < d").groupBy("x1", "x2").agg(F.min("s").alias("sample"), F.max("d").alias("depth"), F.max("above").alias("above")))
    made = stored(made, "trie-made")
    wanted = made.select("x1", "x2", F.col("sample").alias("s"), F.explode(F.array(
        F.struct(F.lit("c").alias("what"), F.expr("above + 1").alias("d")),
        F.struct(F.lit("h").alias("what"), F.expr(_fattest("above", "depth")).alias("d")))).alias("w")).select("x1", "x2", "s", "w.what", "w.d")
    at = rows.select("s", "d", F.col("x1").alias("k1"), F.col("x2").alias("k2"), "p1", "p2")
    pick = lambda what, c, out: F.max(F.when(F.col("what") == what, F.col(c))).alias(out)
    named = (wanted.join(at, ["s", "d"]).groupBy("x1", "x2").agg(
        pick("c", "p1", "p1"), pick("c", "p2", "p2"), pick("c", "k1", "c1"), pick("c", "k2", "c2"), pick("h", "k1", "h1"), pick("h", "k2", "h2")))
    made = made.join(named, ["x1", "x2"]).select(*[c.split()[0] for c in _NODE.split(", ")])
    if nodes is not None:
        made = made.unionByName(nodes.join(left.select("x1", "x2"), ["x1", "x2"], "left_anti").select(made.columns))
    return stored(made, "trie-nodes")


def compacted_trie(sequences: DataFrame, rows: DataFrame, batches: int = BATCHES, growth: int = GROWTH, block: int = BLOCK) -> DataFrame:
    """The compacted nodes but the root, from distinct sequences (``s, length``) and
    their beginnings (``s, d, x1, x2, p1, p2``)."""
    longest = sequences.agg(F.max("length")).first()[0] or 0
    some = sequences.where("length > 0")
    # Shares of the batches: 1, growth - 1, growth * (growth - 1), ... of growth ** (batches - 1).
    at = F.pmod(F.xxhash64("s", F.lit("batch")), F.lit(growth ** (batches - 1)))
    nodes = None
    for k in range(batches):
        low = growth ** (k - 1) if k else 0
        nodes = _insert(stored(some.where((at >= low) & (at < growth ** k)), "trie-batch"), nodes, rows, longest, block)
    return nodes


# -- what hangs below each node ------------------------------------------------

def _pieces(batches):
    """From rows sorted by end node and id: pieces of the decimal ids, comma-joined."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["x1", "x2", "first", "piece"])

    for batch in batches:
        for x1, x2, conv in zip(*[batch.column(c).to_pylist() for c in ("x1", "x2", "conv")]):
            if ids and ((x1, x2) != node or len(ids) >= PIECE // 20):
                yield piece()
                ids = []
            node = (x1, x2)
            ids.append(conv)
    if ids:
        yield piece()


def _hash_pieces(batches):
    """From pieces sorted by node and first id: SHA-256 of each node's list."""
    node = state = None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], ["x1", "x2", "sha"])
    for batch in batches:
        for x1, x2, piece in zip(*[batch.column(c).to_pylist() for c in ("x1", "x2", "piece")]):
            if (x1, x2) != node:
                if state is not None:
                    yield out()
                node, state = (x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if state is not None:
        yield out()


def prefix_trie(conversations: DataFrame, batches: int = BATCHES, growth: int = GROWTH, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of rebuilt conversations, edges expanded.

    Input: ``conv_id, turn, role, text`` (others are ignored).  Output, one row
    per distinct beginning, the empty one included: ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Null roles and texts are empty; null turns come first; turns of one number
    are in the order of role and text, and repeated rows are turns of their own.
    Rows without an id belong to no conversation.  A conversation without turns
    after rebuilding is a member of the root alone.  An empty table gives an
    empty result.
    """
    turns, ids = rebuilt_turns(conversations)
    begun = beginnings(turns)
    ends = begun.groupBy("conv").agg(F.max("d").alias("length"), F.max("until").alias("total"),
                                     F.max_by("x1", "d").alias("x1"), F.max_by("x2", "d").alias("x2"))
    zero = F.lit(0).cast("long")
    members = stored(ids.join(ends, "conv", "left").fillna(0, ["length", "total", "x1", "x2"]), "trie-members")
    sequences = stored(members.groupBy("length", "x1", "x2").agg(F.min("conv").alias("s"), F.count("*").alias("w"), F.max("total").alias("total")), "trie-sequences")
    rows = stored(begun.join(sequences.select(F.col("s").alias("conv")), "conv").withColumnRenamed("conv", "s"), "trie-rows")
    nodes = compacted_trie(sequences, rows, batches, growth, block)

    children = stored(nodes.groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "x1", "p2": "x2"}), "trie-children")
    closed = sequences.join(children, ["x1", "x2"], "left").select("s", "w", "total", F.expr("cast(n_children is null as long)").alias("leaf"))
    closed = stored(closed, "trie-closed")
    # Sequences with the nodes they pass: each turn of a sequence is one node at most.
    passed = stored(rows.join(nodes.select("x1", "x2"), ["x1", "x2"]).join(closed, "s")
                    .select("s", "x1", "x2", "w", "total", "leaf", "until", (F.col("until") - F.col("len")).alias("since")), "trie-passed")
    members_of = stored(passed.groupBy("x1", "x2").agg(F.sum("w").alias("n_convs"), F.min("s").alias("conv_id"), F.sum("leaf").alias("n_leaves")), "trie-members-of")
    # What a sequence shares with smaller ones: the code points up to the deepest node with a smaller member.
    shared = stored(passed.join(members_of.select("x1", "x2", "conv_id"), ["x1", "x2"]).groupBy("s")
                    .agg(F.max(F.expr("if(conv_id < s, until, 0)")).alias("shared")), "trie-shared")
    # Turns of members, less the turns of distinct nodes, each counted for its smallest member.
    saved = F.expr("w * (total - since) - (total - greatest(since, shared))")
    sums = passed.join(shared, "s").groupBy("x1", "x2").agg(F.sum(saved).alias("saved"))
    root = closed.join(shared, "s", "left").agg(
        F.min("s").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum("w").alias("n_convs"),
        F.sum(F.expr("w * total - (total - coalesce(shared, 0))")).alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).where("conv_id is not null")

    dealt = members.repartitionByRange("x1", "x2", "conv").sortWithinPartitions("x1", "x2", "conv")
    pieces = stored(dealt.select("x1", "x2", "conv").mapInArrow(_pieces, "x1 long, x2 long, first long, piece string"), "trie-pieces")
    hashed = stored(pieces.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").select("x1", "x2", "piece")
                    .mapInArrow(_hash_pieces, "x1 long, x2 long, sha string"), "trie-ends")

    full = stored(nodes.join(members_of, ["x1", "x2"]).join(sums, ["x1", "x2"]).join(children, ["x1", "x2"], "left").join(hashed, ["x1", "x2"], "left")
                  .fillna(0, ["n_children"]), "trie-full")
    upper = full.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("upper"))
    top = root.first()
    edges = full.join(upper, ["p1", "p2"], "left").withColumn("upper", F.coalesce("upper", F.lit(top["conv_id"] if top else None).cast("long")))
    at_node = rows.select(F.col("s").alias("conv_id"), F.col("d").alias("depth"), (F.col("until") - F.col("len")).alias("node_since"))
    edges = stored(edges.join(at_node, ["conv_id", "depth"]), "trie-edges")
    each = edges.withColumn("d", F.explode(F.expr("sequence(above + 1, depth)")))
    here = rows.select(F.col("s").alias("conv_id"), "d", (F.col("until") - F.col("len")).alias("since"))
    inner = F.col("d") < F.col("depth")
    expanded = each.join(here, ["conv_id", "d"]).select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") - 1 > F.col("above"), F.col("conv_id")).otherwise(F.col("upper")).alias("parent_conv_id"),
        "n_convs", F.when(inner, F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("node_since") - F.col("since"))).alias("saved_tokens"),
        F.when(inner | F.col("sha").isNull(), F.lit(_empty_hash())).otherwise(F.col("sha")).alias("ends_sha256"))
    at_root = lambda df: df.where("x1 = 0 and x2 = 0")
    # One row of each, put together by an aggregate.
    root = (root.unionByName(at_root(children).select("n_children"), allowMissingColumns=True)
            .unionByName(at_root(hashed).select("sha"), allowMissingColumns=True))
    root = (root.agg(*[F.max(c).alias(c) for c in root.columns]).where("conv_id is not null")
            .withColumn("n_children", F.coalesce("n_children", zero)).withColumn("ends_sha256", F.coalesce("sha", F.lit(_empty_hash()))))
    return expanded.unionByName(root.select(expanded.columns))


def op12_prefix_trie(spark, sf_dir):
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(range(8 * length(c::VARCHAR)), lambda r, k:
           xor((CASE WHEN k % 8 = 0 THEN xor(r, ascii(substr(c::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT) ELSE r END) >> 1,
               3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(r, ascii(substr(c::VARCHAR, (k // 8 + 1)::INT, 1))::BIGINT) ELSE r END) & 1)),
           4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (
  SELECT ids.c, 0 AS own, pos, role, text FROM ids JOIN t ON t.c = ids.base AND t.pos <= ids.h
  UNION ALL
  SELECT ids.c, 1, pos, role, text FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, md5(role) || md5(text) AS k, length(text) AS n FROM rebuilt),
paths AS (
  SELECT c, d, n, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM ids),
sizes AS (SELECT c, max(d) AS length FROM paths GROUP BY c),
nodes AS (
  SELECT d, key, min(p.c) AS conv_id, count(*) AS n_convs, max(n) AS n,
         coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE d = length), '') AS ends
  FROM paths p JOIN sizes USING (c) GROUP BY d, key),
children AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
below AS (
  SELECT left(key, 64 * e) AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN below USING (key) LEFT JOIN nodes up ON x.d > 0 AND up.key = left(x.key, 64 * (x.d - 1))
"""
