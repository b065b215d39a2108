"""HyperMinHash near duplicates, the z-fast trie of conversations, the filter audit."""
import collections
import hashlib
import itertools
import random
import zlib

import brute as B
import numpy as np
import pytest
from spendlens.llm import catalog, hyperminhash, jaccard_join, linking, prefix_trie, text_tries
from spendlens.llm.tokens import shingle_sets, text_buffer

LONG = " ".join(f"w{i % 37}x{i}" for i in range(3000))


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- near duplicates -----------------------------------------------------------------

def components(docs, width, percent):
    """docs: (id, text); id -> (set sizes of its texts, smallest id reachable)."""
    sets = [(i, B.shingle_set(t, width)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k] = rng.choice([f"e{rng.randrange(9)}", out[k] + "x"])
    return " ".join(out)


def cluster(seed=3):
    """A cluster of near copies around several degrees of similarity, chains, short texts, edge cases."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    docs = [(1000 + k, edited(rng, base, rng.randrange(0, 9))) for k in range(70)]
    chain = [f"c{k}" for k in range(90)]
    for k in range(12):
        docs.append((2000 + k, " ".join(chain)))
        for _ in range(3):
            chain[rng.randrange(90)] = f"d{rng.randrange(10_000)}"
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(3000 + k, f"{passage} " + " ".join(f"o{k}q{j}" for j in range(rng.randrange(1, 80)))) for k in range(40)]
    docs += [(10 + k, " ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i"][:k + 1])) for k in range(9)]
    docs += [(30, "A b C"), (31, "a B c"), (32, "a b"), (33, "A B"), (34, None), (35, ""), (36, " \n\t"), (37, LONG), (38, LONG + " end"), (39, LONG)]
    return docs


def test_near_duplicates_equal_all_pairs(docs_of):
    docs = cluster()
    extra = [(None, "a b c d e f g h i"), (37, LONG)]
    want = components(docs, 3, 85)
    for block in (1 << 20, 600):  # with small blocks a list is compared in many tasks
        out = rows(hyperminhash.near_duplicates(docs_of(docs + extra), block_tokens=block))
        assert len(out) == len(docs) + 2
        for r in out:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"] is None and r["n_shingles"] == 7
            else:
                assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        sizes = {r["doc_id"]: r["n_shingles"] for r in out}
        assert all(sizes[i] == len(B.shingle_set(t, 3)) for i, t in docs)


def test_near_duplicates_at_other_widths_and_thresholds(docs_of):
    docs = cluster(5)
    for width, percent in ((5, 80), (1, 95)):
        out = {r["doc_id"]: r["component_id"] for r in rows(hyperminhash.near_duplicates(docs_of(docs), width, percent))}
        assert out == components(docs, width, percent)


def test_near_duplicates_of_nothing(docs_of, spark):
    assert rows(hyperminhash.near_duplicates(docs_of([(1, "x")]).where("false"))) == []
    none = rows(hyperminhash.near_duplicates(docs_of([(1, None), (2, "")])))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in none} == {(1, 0, 1, True), (2, 0, 2, True)}
    one_id = rows(hyperminhash.near_duplicates(docs_of([(6, "a b c d"), (6, "q r s t"), (7, "q r s t"), (8, "a b c d")])))
    assert len(one_id) == 4 and {r["component_id"] for r in one_id} == {6}


def sets_of(*texts):
    import pyarrow as pa
    return shingle_sets(*text_buffer(pa.array(texts)), 3)


def test_registers_by_definition():
    for s in sets_of(LONG, "a b c d e", "x"):
        least = {}
        for t in s.tolist():
            bucket, rest = t >> 56, t & ((1 << 56) - 1)
            least[bucket] = min(rest, least.get(bucket, 1 << 56))
        got = hyperminhash.registers(s)
        for bucket in range(256):
            if bucket not in least:
                assert got[bucket] == 0
                continue
            bits = format(least[bucket], "056b")
            zeros = len(bits) - len(bits.lstrip("0"))
            after = (bits[zeros + 1:] + "0" * 10)[:10]
            assert got[bucket] == ((zeros + 1) << 10) + int(after, 2)


def test_estimates_are_near_and_corrected():
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    errors, apart = [], []
    for _ in range(40):
        common, a, b = draw(1700), draw(150), draw(150)
        pair = [np.unique(np.concatenate([common, x])) for x in (a, b)]
        regs = [hyperminhash.registers(s)[None, :] for s in pair]
        errors.append(hyperminhash.estimates(*regs, *[np.array([float(len(s))]) for s in pair])[0][0] - 0.85)
        far = [draw(200_000) for _ in range(2)]
        regs = [hyperminhash.registers(np.sort(s))[None, :] for s in far]
        apart.append(hyperminhash.estimates(*regs, *[np.array([float(len(s))]) for s in far])[0][0])
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03 and np.mean(apart) < 0.01


def test_empty_registers_are_filled_alike():
    few = np.stack([hyperminhash.registers(s) for s in sets_of("a", "a b c d", " ".join(f"k{i}" for i in range(40)))])
    full = hyperminhash.filled(few)
    assert (full > 0).all() and (full[few > 0] == few[few > 0]).all()
    assert set(full[0].tolist()) == {int(few[0].max())} and (hyperminhash.filled(few) == full).all()


def test_leaders_in_several_rounds(spark):
    lists = spark.createDataFrame([(k, 10 * k + i, 5) for k in range(4) for i in range(6)] + [(9, 77, 5)], "key long, rep long, n long")
    asked = []

    def check(pairs):
        asked.extend((r["rep"], r["leader"]) for r in pairs.collect())
        return pairs.where("rep % 2 = leader % 2").selectExpr("rep as a", "leader as b")

    links, found, left = linking.link_lists(lists, check, rounds=9, leaders=1, growth=2)
    label = {r["node"]: r["component"] for r in found.collect()}
    assert left.isEmpty() and len(asked) == len(set(map(frozenset, asked)))
    assert all(label[10 * k + i] == 10 * k + i % 2 for k in range(4) for i in range(6)) and 77 not in label


def test_token_groups_lead_long_lists(docs_of):
    docs = cluster(11)
    want = components(docs, 4, 85)
    for list_rows, led_rows in ((3, 2), (1 << 13, 4), (1 << 13, 1 << 13)):
        out = rows(jaccard_join.jaccard_components(docs_of(docs), list_rows=list_rows, led_rows=led_rows))
        assert {r["doc_id"]: r["component_id"] for r in out} == want


# -- conversations ---------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, source string"


def trie(talks):
    """talks: rows (conv_id, turn, role, text); the contract's nodes, plainly."""
    own = collections.defaultdict(list)
    for c, turn, role, text in talks:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    members = collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in convs if built[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], sum(not children[n] for n in below),
                    sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n=160, most=9):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-150, 350), n):
        for k in range(rng.randrange(0, most)):
            out.append((c, k, rng.choice(["user", "assistant"]), f"say {rng.randrange(3)} ü"))
    return out


def nodes(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("batches, growth, block", [(3, 4, 1 << 10), (1, 2, 2), (4, 2, 4)])
def test_trie_equals_plain_version(spark, batches, growth, block):
    made = talks(batches)
    made += [(0, k, "user", f"long {k}") for k in range(10, 45)] + [(7, k, "user", f"long {k}") for k in range(10, 44)]
    df = spark.createDataFrame([(*t, "x") for t in made], TURN)
    assert nodes(prefix_trie.prefix_trie(df, batches, growth, block)) == trie(made)


def test_trie_edge_cases(spark):
    made = [(1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 5, "user", ""), (None, 1, "user", "x"),
            (100, 1, "", None), (101, 1, "", None), (102, 2, None, ""), (-3, 1, "user", "x" * 100_000), (203, 1, "u", "v"), (305, 1, "u", "v"), (305, 2, "u", "w")]
    df = spark.createDataFrame([(*t, "x") for t in made], TURN)
    assert nodes(prefix_trie.prefix_trie(df)) == trie(made)
    assert nodes(prefix_trie.prefix_trie(df.where("false"))) == []
    # One conversation of one turn, whatever is left of it after rebuilding.
    for c in range(1, 8):
        assert nodes(prefix_trie.prefix_trie(df.where("conv_id = 2").selectExpr(f"{c}L as conv_id", "turn", "role", "text"))) == trie([(c, 5, "user", "")])


def test_a_conversation_over_several_tasks(spark):
    made = [(0, k, "user", f"t{k % 7}") for k in range(400)] + [(50, k, "user", f"t{k % 7}") for k in range(390)] + talks(4, 40)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*t, "x") for t in made], TURN)
        turns, _ = prefix_trie.rebuilt_turns(df)
        depths = {(r["conv"], r["d"]) for r in turns.collect()}
        assert len([d for c, d in depths if c == 0]) == 400 and max(d for c, d in depths if c == 0) == 400
        assert nodes(prefix_trie.prefix_trie(df, block=16)) == trie(made)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_id_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    made = [(1000 * k, 1, "user", "same") for k in range(50)]
    df = spark.createDataFrame([(*t, "x") for t in made], TURN)
    assert nodes(prefix_trie.prefix_trie(df)) == trie(made)


# -- filter audit ------------------------------------------------------------------------

def plain_masks(docs):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, source, *_ in docs:
        t = t or ""
        w = B.words(t)
        out.append((source or "", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                                   any(c in "#$%&*|" for c in t), i is not None and least[t] < i), i))
    return out


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    judged = plain_masks(docs)
    out = {}
    for part in {p for p, *_ in judged}:
        own = [(dict(zip("ABCDE", f)), i) for p, f, i in judged if p == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [any(f[y] for y in order[:k]) for f, _ in own]
                removed = [i for (f, i), g in zip(own, gone) if f[x] and not g]
                total[x] += len(removed)
                out[part, order, k + 1] = [sum(not g and not f[x] for (f, _), g in zip(own, gone)), len(removed), sum(f[x] and g for (f, _), g in zip(own, gone)),
                                           sum(f[x] and sum(f.values()) == 1 for f, _ in own), sum(i in good for i in removed), sum(i in toxic for i in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def made_docs():
    rng = random.Random(2)
    copies = " ".join(f"c{k}" for k in range(220))
    docs = [(5, copies, "a"), (3, copies, "b"), (9, copies, None), (9, copies, ""), (4, copies + " ", "a"), (8, None, "a"), (2, "", "a"), (7, None, "a"),
            (None, copies, "a"), (None, None, None), (1, LONG, "a"), (12, LONG, "a"), (11, LONG + "#", "b"), (13, "ÄÖ " * 300, "a"), (14, "A" + "ä" * 49, "b"), (15, "A" + "ä" * 48, "b")]
    for k in range(120):
        word = rng.choice(["x", "Y", "z%", "ü"])
        docs.append((100 + k, " ".join(f"{word}{rng.randrange(rng.choice([5, 500]))}" for _ in range(rng.choice([3, 199, 200, 260]))), rng.choice(["a", "b", None])))
    return docs + [(300 + k, docs[20 + k % 9][1], "b") for k in range(30)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(100, 160)] + [(5, 1, 0), (5, 0, 1), (9, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("group_bytes", [16 << 20, 700])
def test_audit_equals_plain_version(spark, docs_of, group_bytes):
    docs = made_docs()
    labels = spark.createDataFrame([*LABELS, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    out = rows(text_tries.filter_audit(docs_of(docs), labels, group_bytes))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out}
    assert len(got) == len(out) and got == plain_audit(docs, LABELS)


def test_masks_and_their_bits(docs_of):
    docs = made_docs()
    want = collections.Counter((i, p, sum(int(f) << k for k, f in enumerate(fs))) for p, fs, i in plain_masks(docs))
    for group_bytes in (16 << 20, 300):
        assert collections.Counter((r["doc_id"], r["part"], r["mask"]) for r in rows(text_tries.filter_masks(docs_of(docs), group_bytes))) == want


def test_audit_of_nothing(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(text_tries.filter_audit(docs_of([(1, "x")]).where("false"), labels)) == []
    assert len(rows(text_tries.filter_audit(docs_of([(1, "x")]), labels))) == 600


def test_trie_holds_least_ids():
    rng = random.Random(8)
    texts = ["", "a", "ab", "abc", "abd", "b", "ü", "üb"] + ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    trie_, least, ends = text_tries.RadixTrie(), {}, {}
    for k, t in enumerate(rng.sample(texts, len(texts))):
        ident = rng.randrange(1000)
        least[t] = min(ident, least.get(t, ident))
        ends.setdefault(t, trie_.insert(t.encode(), ident))
        assert trie_.insert(t.encode(), 2000) is ends[t]
    assert {t: n.least for t, n in ends.items()} == least and len({id(n) for n in ends.values()}) == len(ends)


def test_given_tables_have_the_contracts_columns(spark, sf):
    q = catalog.queries()
    assert q["op11_hyperminhash"](spark, sf).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert q["op12_prefix_trie"](spark, sf).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert q["op13_filter_audit"](spark, sf).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
