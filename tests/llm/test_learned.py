"""Backoff scores, toxicity, personal data, Jaccard join and the pipeline."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import brute as B
import corpus_pipeline
from spendlens.llm import catalog, common, jaccard_join, lm_score, pii_crf, toxicity
from spendlens.llm.components import components
from spendlens.llm.tokens import find_words, hash_words, shingle_sets, text_buffer

LONG = " ".join(f"w{i % 37}x{i}" for i in range(3000))


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship_code(spark)


# -- words and hashes -----------------------------------------------------------------

def test_words_of_a_buffer():
    import pyarrow as pa
    texts = ["One  two\tthree", None, "", "é ñandú\nz", " x", "y", "a" * 5000, "b " * 3000]
    data, offsets = text_buffer(pa.array(texts).slice(0))
    starts, ends, first = find_words(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert [words[first[i]:first[i + 1]] for i in range(len(texts))] == [B.words(t) for t in texts]
    hashes = hash_words(data, starts, ends)
    same = hash_words(data, starts, ends, chunk=64)  # windows do not matter, but for words longer than one
    short = (ends - starts) <= 64
    assert (hashes[short] == same[short]).all() and len(set(hashes.tolist())) == len({w.translate(B.ASCII) for w in words})
    data, offsets = text_buffer(pa.array(texts).slice(3, 3))
    assert [bytes(data[offsets[i]:offsets[i + 1]]).decode() for i in range(3)] == texts[3:6]
    assert [len(s) for s in shingle_sets(*text_buffer(pa.array(["a b c d e", "a b", "", "a a a a a a"])), 4)] == [2, 1, 0, 1]


# -- backoff scores ---------------------------------------------------------------------

def plain_scores(docs, order, backoff=0.4):
    own = []
    total = collections.Counter()
    for _, text in docs:
        w = B.words((text or "").translate(B.ASCII))
        c = collections.Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        own.append((w, c))
        total += c
    n_all = sum(len(w) for w, _ in own)
    out = []
    for w, c in own:
        other = lambda g: total[g] - c[g]
        score = 0.0
        for i in range(len(w)):
            factor = 0.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if other(g) > 0:
                    score += factor + math.log(other(g)) - math.log(other(g[:-1]) if n > 1 else n_all - len(w))
                    break
                factor += math.log(backoff)
            else:
                score += factor - math.log(n_all - len(w) + 1)
        out.append(score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_version(spark, docs_of, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["a", "b", "C", "dd", "é", "f"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "one-off words only"), (103, "a b a b"), (103, "a b a b"), (None, "a b c"), (104, LONG)]
    out = collections.defaultdict(list)
    for r in rows(lm_score.stupid_backoff(docs_of(docs), order=order)):
        out[r["doc_id"]].append(r)
    for (i, text), want in zip(docs, plain_scores(docs, order)):
        got = out[i].pop()
        assert got["n_words"] == len(B.words(text)) and math.isclose(got["log_score"], want, rel_tol=1e-9, abs_tol=1e-9), (i, text)
        assert (got["mean_log_score"] is None) == (got["n_words"] == 0)
    assert lm_score.stupid_backoff(docs_of([])).count() == 0


def test_scores_of_given_documents(spark, sf, given):
    docs = [(d["doc_id"], d["text"]) for d in given("documents")]
    got = {r["doc_id"]: r["log_score"] for r in rows(catalog.queries()["op1_stupid_backoff"](spark, sf))}
    for (i, _), want in zip(docs, plain_scores(docs, lm_score.ORDER)):
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_registered_scores_have_trigram_evidence(spark, sf, given):
    docs = [(d["doc_id"], d["text"]) for d in given("documents")]
    got = {r["doc_id"]: r["log_score"] for r in rows(catalog.queries()["op1_stupid_backoff"](spark, sf))}
    for (i, _), want in zip(docs, plain_scores(docs, 3)):
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


# -- toxicity -----------------------------------------------------------------------------

def test_label_model_recovers_rates():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.15
    on, off = np.linspace(0.3, 0.8, 8), np.linspace(0.02, 0.1, 8)
    v = np.where(y[:, None], rng.random((len(y), 8)) < on, rng.random((len(y), 8)) < off).astype(float)
    v = np.column_stack([v, v[:, 0]])  # a copied voter
    model = toxicity.LabelModel(len(v), v.T @ v, y.mean())
    assert np.abs(model.on[1:8] - on[1:]).max() < 0.08 and np.abs(model.off[1:8] - off[1:]).max() < 0.03
    assert model.correlation[0, 8] > 0.2 and model.weight[0] < 0.9 < model.weight[4]
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.93


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [f"plain{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randint(0, len(w)), rng.choice(["nasty", "vile", "rotroot" + rng.choice("abcdefgh") * 2]))
        out.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    return out, labels


def test_toxicity_on_held_out_rows(spark, docs_of):
    docs, labels = toxic_corpus(1500, 3)
    extra = [(5000, None), (5001, ""), (5002, LONG), (None, "nasty vile nasty"), (5003, "hello nasty vile rotrootaa"), (5003, "hello nasty vile rotrootaa")]
    table = spark.createDataFrame([(*r, "x") for r in labels + [(None, 1), (3, None), (9999, 1)]], "doc_id long, toxic int, text string")
    out = rows(toxicity.score_toxicity(docs_of(docs + extra), table))
    assert len(out) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert sum((r["predicted"] == 1) == (truth[r["doc_id"]] == 1) for r in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert {r["predicted"] for r in out if r["doc_id"] == 5003} == {1} and {r["predicted"] for r in out if r["doc_id"] in (5000, 5001)} == {0}
    left = toxicity.without_toxic(docs_of(docs + extra), table)
    ids = [r["doc_id"] for r in rows(left)]
    assert 5003 not in ids and {5000, 5001, 5002} <= set(ids) and "key" in left.columns


def test_held_out_labels_are_not_learnt(spark, docs_of):
    docs, labels = toxic_corpus(600, 5)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    make = lambda ls: spark.createDataFrame(ls, "doc_id long, toxic int")
    a = rows(toxicity.score_toxicity(docs_of(docs), make(labels)))
    b = rows(toxicity.score_toxicity(docs_of(docs), make([(i, 1 - y if held(i) else y) for i, y in labels])))
    assert sorted((r["doc_id"], r["score"]) for r in a) == sorted((r["doc_id"], r["score"]) for r in b)


def test_toxicity_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in rows(toxicity.score_toxicity(docs_of([(1, "a"), (2, None)]), none))} == {0}
    assert toxicity.score_toxicity(docs_of([]), none).count() == 0


# -- personal data ---------------------------------------------------------------------------

def test_personal_base_equals_plain_version(spark, sf, given):
    by = {d["doc_id"]: d["text"] for d in given("documents")}
    for r in rows(catalog.queries()["op3_crf_pii"](spark, sf)):
        spans, digest = B.personal(by[r["doc_id"]])
        count = collections.Counter(k for k, _, _ in spans)
        assert [r[f"n_{k}"] for k in pii_crf.KINDS] == [count[k] for k in pii_crf.KINDS] and r["base_sha256"] == digest
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r["spans"].split(","))


def test_base_patterns_against_plain_version():
    rng = random.Random(7)
    parts = ["a@b.co", "x.y+z@m-1.example.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111",
             "+1 (555) 010-2030", "+12", "+1234567890123456", "@", "a@", "@b.c", "..", "é", " ", "\n", "-", "12345678901234567890", "1.1", "a@b", "a@b..c", "a@b.c@d.e"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii_crf.base_spans(text) == B.personal(text)[0], text
    for text in ("a" * 200_000 + " @ " + "1" * 200_000, "1." * 50_000):
        pii_crf.base_spans(text)


def test_field_adds_written_out_variants(docs_of):
    texts = {1: "please write to maria [at] post4 [dot] example [dot] com for more", 2: "call (030) 555-8120 after eight",
             3: "there were 25 of 300 in chapter 12", 4: None, 5: "", 6: "mail joe@example.org or call +1 (555) 010-2030 now", 7: LONG,
             8: "paid with 4111.1111.1111.1111 again"}
    out = {r["doc_id"]: r for r in rows(pii_crf.find_personal(docs_of(list(texts.items()) + [(6, texts[6])])))}
    assert out[1]["spans"].startswith("email:16:") and out[2]["spans"] == "phone:5:19" and out[8]["spans"].startswith("card:10:")
    assert out[3]["spans"] == out[4]["spans"] == out[5]["spans"] == out[7]["spans"] == ""
    assert out[6]["spans"] == "email:5:20,phone:29:46" and out[6]["n_added"] == 0
    assert pii_crf.find_personal(docs_of([])).count() == 0


def test_field_sees_every_labelled_variant(docs_of):
    """Spans of the labelled table are found in texts with no digit, sign or separator but their own, in any case."""
    texts, want = {}, {}
    for row in pii_crf.LABELLED:
        m = re.search(r"\{(\w+) (.*?)\}", row)
        if not m:
            continue
        before, after = (" ".join(w for w in part.split(" ") if not pii_crf.TRIGGER.search(w)) for part in (row[:m.start()], row[m.end():]))
        for span in {m[2], re.sub(r"(?<=[\[(])(at|dot)(?=[\])])", lambda x: x[0].upper(), m[2])}:
            k = len(texts)
            texts[k] = f"{before}{span}{after}"
            want[k] = f"{m[1]}:{len(before)}:{len(before) + len(span)}"
    assert sum(not re.search("[0-9]", t) for t in texts.values()) >= 8
    out = {r["doc_id"]: r["spans"] for r in rows(pii_crf.find_personal(docs_of(list(texts.items()))))}
    assert {texts[k]: out[k] for k in texts} == {texts[k]: want[k] for k in texts}


def test_gates_agree(docs_of):
    """A text is looked at whenever one of its words is, wherever the word stands."""
    seps = ["at", "dot", "[at]", "(dot)", "AT", "(AT)", "[Dot]", "(at", "dot]", "anna[at]mail", "x(DOT)y", "7", "a@b", "\u0130(AT)x"]
    none = ["kim", "that", "dots", "(cat)", "at.", "\u0130"]
    for w in seps + none:
        for text in (w, f"see {w} now", f"see\n{w}", f"{w}\tsee", f"\u0130\u0130 {w} \u0130"):
            pieces = pii_crf._pieces(text)
            assert bool(pieces) == bool(pc.match_substring_regex(pa.array([text]), pii_crf.ANY_TRIGGER)[0].as_py()) == (w in seps), text
            assert all(text[s:e] == text[s:e].strip() for p in pieces for s, e in p)
    here, far = "sales (AT) shop (DOT) com", "kim at example.net"
    plain = {1: f"write to {here} today", 2: f"mail {far} now"}
    out = {r["doc_id"]: r["spans"] for r in rows(pii_crf.find_personal(docs_of(
        [*plain.items(), *((k + 10, t + " and so on and on and on and on until 5") for k, t in plain.items())])))}
    assert out[1] == out[11] == "email:9:34" and out[2] == out[12] == "email:5:23"


SPELLINGS = {
    "{n} at {d}": (" at ", "."), "{n} at {d} dot": (" at ", " dot "), "[at][dot]": ("[at]", "[dot]"), "(at)(dot)": ("(at)", "(dot)"),
    "[at] [dot]": (" [at] ", " [dot] "), "(at)": ("(at)", "."), " (at) ": (" (at) ", "."), "[AT]": ("[AT]", ".")}


@pytest.mark.parametrize("spelling", SPELLINGS)
def test_recall_on_planted_addresses(spelling):
    """Names, domains and some contexts that the labelled table does not hold."""
    import itertools
    at, dot = SPELLINGS[spelling]
    names, domains = ("lisa", "max.roth", "j_doe", "wu", "ana-b", "peter77"), ("gmx.de", "mail.example.net", "corp.io", "uni-x.edu", "host.co.jp")
    before = ("mail", "contact", "please write to", "you can reach", "her address is", "ask", "questions go to")
    after = ("now", "for details", "today", "or call", "or not")
    cases = [(f"{a} {n}{at}{d.replace('.', dot)} {z}", len(a) + 1, -len(z) - 1) for n, d, a, z in itertools.product(names, domains, before, after)]
    texts = [t for t, _, _ in cases]
    found = pii_crf._added(texts, [pii_crf.base_spans(t) for t in texts], pii_crf.train())
    hits = sum(("email", s, len(t) + e) in f for (t, s, e), f in zip(cases, found))
    assert hits >= 0.9 * len(cases), hits / len(cases)


def test_places_are_not_addresses():
    texts = ["we looked at bbc.com for it", "they arrived at noon.he left", "see it at archive.org today", "he was at home. the end", "stay at x.org and read",
             "he works at google.com now", "she is at work.then she left", "put a dot at the end", "At At At At ating. At At"]
    assert not any(pii_crf._added(texts, [pii_crf.base_spans(t) for t in texts], pii_crf.train()))


def test_viterbi_equals_all_sequences():
    import itertools
    emit, move = pii_crf.train()
    for words in (["call", "555-0172", "or"], ["4111.1111.1111.1111"], ["a", "at", "b", "dot"]):
        x = pii_crf._features(words)
        e = emit[np.array(x)].sum(axis=1)
        best = max(itertools.product(range(len(pii_crf.TAGS)), repeat=len(words)),
                   key=lambda t: move[len(pii_crf.TAGS), t[0]] + sum(e[i, k] for i, k in enumerate(t)) + sum(move[a, b] for a, b in zip(t, t[1:])))
        assert pii_crf.viterbi([x], emit, move)[0] == list(best)


# -- Jaccard join ---------------------------------------------------------------------------------

def near_copies(seed, families=6, copies=12, words=60):
    rng = random.Random(seed)
    docs = []
    passage = [f"shared{k}" for k in range(25)]
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10 ** 6)}"
            if rng.random() < 0.3:
                w += passage
            docs.append(" ".join(w) if rng.random() < 0.9 else " ".join(w).upper())
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs_of, seed):
    docs = near_copies(seed) + [(900, None), (901, ""), (902, "one two"), (903, "One TWO"), (904, "one two three four"), (905, LONG), (906, LONG + " end")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(docs_of(docs)))}
    assert got == B.jaccard_components(docs)


def test_components_with_split_groups(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 150)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    docs = near_copies(4, families=2, copies=30)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.jaccard_components(docs_of(docs)))}
    assert got == B.jaccard_components(docs)


@pytest.mark.parametrize("list_rows", [2, 6])
def test_components_with_long_lists(docs_of, monkeypatch, list_rows):
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 150)
    docs = near_copies(5, families=3, copies=25) + [(None, "a b c d e"), (900, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in rows(jaccard_join.jaccard_components(docs_of([d for d in docs if d[0] is not None]), list_rows=list_rows))}
    assert got == B.jaccard_components([d for d in docs if d[0] is not None])
    assert jaccard_join.jaccard_components(docs_of(docs), list_rows=list_rows).where("doc_id is null and component_id is null").count() == 1


def test_components_of_given_documents(spark, sf, given):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(catalog.queries()["op10_token_groups"](spark, sf))}
    assert got == B.jaccard_components([(d["doc_id"], d["text"]) for d in given("documents")])


def test_one_of_each(docs_of):
    docs = [(3, "a b c d e"), (1, "A b c d E"), (1, "A b c d E"), (2, "x y"), (None, "a b c d e"), (4, None), (5, "")]
    out = jaccard_join.one_of_each(docs_of(docs))
    assert sorted((r["doc_id"] or 0) for r in rows(out)) == [0, 1, 2, 4, 5] and out.columns == docs_of([]).columns
    assert jaccard_join.jaccard_components(docs_of([])).count() == 0


def test_one_of_each_takes_five_words_and_four_fifths(docs_of):
    def pair(first, n):
        """Texts that differ in one word: n - 9 of n + 1 five-word shingles are common."""
        w = [f"{first}w{k}" for k in range(n)]
        return [(first, " ".join(w)), (first + 1, " ".join([*w[:20], "other", *w[21:]]))]
    docs = [*pair(1, 50), *pair(3, 49), *pair(5, 48)]
    assert sorted(r["doc_id"] for r in rows(jaccard_join.one_of_each(docs_of(docs)))) == [1, 3, 5, 6]


def test_long_chain_of_links(spark):
    n = 40
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in rows(components(chain))} == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# -- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3]
    assert len({r["doc_id"] for r in rows(docs.select("doc_id"))}) <= seen[3]
    shards = rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf))
    assert len(shards) == seen[4]
    assert len(rows(corpus_pipeline.run(spark, sf))) == seen[4]
