"""Personal data by patterns and a linear-chain CRF over word shapes.

The base patterns are always reported.  A linear-chain conditional random
field, trained from a small labelled table of written-out variants
(``LABELLED``), adds what the patterns miss: addresses spelled with "at" and
"dot", local phone numbers, cards in unusual groups.  Its features are shapes
of a word and its neighbours; decoding is Viterbi over padded numpy batches.

Words farther than ``CONTEXT`` words from any word with a digit, an ``@`` or
a spelled-out separator are outside by definition of the model, so the chain falls
into short independent pieces that are decoded exactly, and texts with none of these
are not split into words at all.

Scale: one pass over the texts in Arrow batches, no shuffle; the model is a few
thousand numbers, trained once by the driver from fixed rows.
"""
from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns (an address is found from its ``@``; digits are taken whole, so no position is tried twice).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Features of a word.
PER_WORD = 11
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
FEATURES, CONTEXT = 1 << 13, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word that can be part of personal data, or that spells out a separator, in brackets also inside a word.  In lower case.
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|^[\[(]?(?:at|dot)[\])]?$")
#: A text with such a word: the same with a word's ends spelled out, for texts as they are.
ANY_TRIGGER = r"(?i)[0-9@]|[\[(](?:at|dot)[\])]|(?:^|[\x20\x09-\x0D])[\[(]?(?:at|dot)[\])]?(?:$|[\x20\x09-\x0D])"

#: The labelled table: words, with a span's words in braces after its kind.
LABELLED = tuple("""
write to {email anna [at] mail7 [dot] example [dot] com} for more
mail {email j.smith at example dot org} about it
contact {email sales (at) shop.example.com} today
her address is {email kim.lee [at] example.net} now
send it to {email bob at mail dot example dot com} please
reach {email info(at)example.org} or ask
{email max.muster [at] firma [dot] example} antwortet
mail {email kim at example.net} now
or write {email petra.klein at mail.example.org} for help
reach {email o_brien at shop.example.com} at work
contact {email jo at firma.example} today
mail an {email lena at kontakt.example.de} heute
email {email support at example.co.uk} please
write to {email anna[at]mail[dot]com} for more
{email kim.lee[at]example[dot]net} is hers
mail {email sales(at)shop(dot)example(dot)org} about it
reach {email tom_s(at)mail(dot)example.com} now
her address is {email info[at]mail.example[dot]com} today
mail {email bo at web.example.com} for more
mail {email rita at post dot example dot net} or wait
contact {email eva at firma dot example} now
email {email ulf9 at web dot example dot org} for details
her address is {email iris at web.example.net} or so
address {email h.p (at) web.example.com} for prices
her address is {email rosa (at) firma.example} for now
ask {email nina[at]uni-example[dot]org} now
ask {email t-mo(at)x-example.net} for it
orders go to {email ida at shop.example.net} today
it goes to {email mara at web dot example dot com} for now
you can reach {email sam at team.example.org} or me
write to {email a_b-c at my-example.net} for help
reach {email li at my-example dot com} today
write to {email ed (at) web (dot) example} today
contact {email mo (at) firma (dot) example (dot) org} please
mail {email fay (at) web (dot) net} now
his address is {email kurt at web.example} today
her address is {email nora.b at firma.example} now
the address is {email ole at post dot example} for now
ask {email vera at mail.example.org} for more
ask {email vic at web dot example} today
ask {email pia at firma.example.com} now
ask {email uwe at web.example} now
sold at example.this was new
found at my-example.com for less
made at home.it was
we looked at example.net for news
they stay at www.example.org all day
he works at firma.example since 2010
prices at shop.example.com are up
read more at news.example.com today
we met at noon and he put a dot on it
he sat at home. then he left
she was good at maths.they said
look at the dot in example 4
they stayed at home for 12 days
he was at work by 9 and left at 17
the dot at the end of line 20 is red
arrive at gate 14 before 10 and wait
it sold at 25 in 1999 and at 30 in 2004
call {phone (017) 555-7713} after six
phone {phone 555-0172} or write
tel {phone 030 5551 2345} bis 18 uhr
dial {phone 0171-555-9931} for help
fax {phone (212) 555-0199} only
call {phone 415-555-2671} now
telefon {phone 089/555-1234} am abend
tel. {phone 01 55 50 12 34} le matin
number {phone 555.867.5309} is his
call me on {phone 1-800-555-0100} today
the room 217 is on floor 3 of 12
chapter 12 pages 100-120 of 300
from 1990 to 1995 there were 14000 of them
version 2.10.3 came out in 2021-05-17
a score of 3-2 after 90 minutes
order 48213 of 2023-11-02 was sent
the code 7f3a9c21 and the id 448213 differ
on 12.05.2020 at 14:30 we saw 25 of 30
lines 10-20 and 555 others
the value 0.35 of 12.5 in table 4
card {card 4111-1111-1111-1111} was used
paid with {card 4111.1111.1111.1111} again
visa {card 4929/1234/5678/9012} on file
charge {card 3782 822463 10005} for it
amex {card 3714-496353-98431} expired
card number {card 6011.0009.9013.9424} declined
item 4111111111 has 100 parts
ref 2023-0001-0002-0003-11 closed
host {ip 10.0.0[.]15} answered
blocked {ip 192[.]168[.]1[.]10} twice
server {ip 10[.]20[.]30[.]40} is down
addr {ip 172.16.4[.]1} seen
see section 4.2.1.7.3 of part 10
rev 1.2.3 and build 10.4 passed
token = "94f0c2aa71" was made
user@ home 22 and 44@ work
the list[at] and map[dot] of x[dot]y
f(at) of f(dot)g in 3
the 3rd of 4 and the 21st
""".strip().split("\n"))


def _shape(word: str) -> str:
    """Characters by class with the lengths of runs up to 4 (digits) or 1 (letters), spelled
    separators as what they stand for; long words are cut."""
    out, i = [], 0
    word = SPELLED.sub(lambda m: "@" if m[1].lower() == "at" else ".", word[:80])[:40]
    while i < len(word):
        c = word[i]
        j = i
        if c.isdigit():
            while j < len(word) and word[j].isdigit():
                j += 1
            out.append(f"d{min(j - i, 5)}")
        elif c.isalpha():
            while j < len(word) and word[j].isalpha():
                j += 1
            out.append("x")
        else:
            j = i + 1
            out.append(c)
        i = j
    return "".join(out)


#: A separator spelled out in brackets inside a word.
SPELLED = re.compile(r"(?<=[^\x20\x09-\x0D])[\[(](at|dot)[\])](?=[^\x20\x09-\x0D])", re.I)
_ADDRESS, _DOMAIN = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+"), re.compile(r"(?=[\w.-]*[^\W\d_])[\w-]+(\.[\w-]+)+")


def _form(word: str) -> str:
    """What a word looks like as a whole: an address or a domain, plain or spelled, else its kind of characters."""
    plain = SPELLED.sub(lambda m: "@" if m[1].lower() == "at" else ".", word[:80]).strip(",;:!?\"'.")
    if "@" in plain:
        return "spelled" if "@" not in word and _ADDRESS.fullmatch(plain) else "address" if _ADDRESS.fullmatch(plain) else "sign"
    if _DOMAIN.fullmatch(plain):
        return "domain"
    return "word" if plain.isalpha() else "digits" if any(c.isdigit() for c in plain) else "other"


#: Words whose identity is a feature.
CUES = frozenset("at dot [at] [dot] (at) (dot) call phone tel tel. telefon dial fax number card visa amex charge mail email address contact "
                 "write send reach ask an host server addr blocked ip from to page chapter line version table".split())


@functools.lru_cache(maxsize=1 << 16)
def _name(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % FEATURES


def _features(words: list[str]) -> list[list[int]]:
    """``PER_WORD`` feature numbers per word."""
    shapes = [_shape(w.strip(",;:!?\"'")) for w in words]
    cue = [w.lower().strip(",;:!?\"'") for w in words]
    cue = [c if c in CUES else "-" for c in cue]
    form = [_form(w) for w in words]
    digits = [min(sum(ch.isdigit() for ch in w[:64]), 20) for w in words]
    at = lambda a, i: a[i] if 0 <= i < len(a) else "^"
    return [[_name(f"s0={shapes[i]}"), _name(f"s-1={at(shapes, i - 1)}"), _name(f"s+1={at(shapes, i + 1)}"),
             _name(f"c0={cue[i]}"), _name(f"c-1={at(cue, i - 1)}|{at(cue, i - 2)}"), _name(f"c+1={at(cue, i + 1)}"),
             _name(f"n0={digits[i]}"), _name(f"s0s+1={shapes[i]}|{at(shapes, i + 1)}"), _name(f"f0={form[i]}"),
             _name(f"f0c+1f+2={form[i]}|{at(cue, i + 1)}|{at(form, i + 2)}"), _name(f"c-1f0c+1={at(cue, i - 1)}|{form[i]}|{at(cue, i + 1)}")] for i in range(len(words))]


def _parse(row: str) -> tuple[list[str], list[int]]:
    words, tags, kind, first = [], [], None, False
    for w in row.split(" "):
        if w.startswith("{"):
            kind, first = w[1:], True
            continue
        end = w.endswith("}")
        w = w.rstrip("}")
        words.append(w)
        tags.append(TAGS.index(("B-" if first else "I-") + kind) if kind else 0)
        first = False
        if end:
            kind = None
    return words, tags


def _padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(lengths.max()), PER_WORD), np.int64)
    for k, s in enumerate(sequences):
        out[k, :len(s)] = s
    return out, lengths


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _may_follow() -> np.ndarray:
    """0 where a tag may follow another (or begin a piece, last row), else a large loss."""
    loss = np.zeros((len(TAGS) + 1, len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag.startswith("I-"):
            for i, before in enumerate((*TAGS, "O")):
                if before[1:] != tag[1:]:
                    loss[i, j] = -1e4
    return loss


@functools.lru_cache(maxsize=1)
def train(steps: int = 120, rate: float = 0.2, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by tag, and of transitions, that maximise the labelled
    table's conditional likelihood (forward-backward gradients, Adam)."""
    rows = [_parse(r) for r in LABELLED]
    x, lengths = _padded([_features(w) for w, _ in rows])
    n, most, t = len(rows), x.shape[1], len(TAGS)
    y = np.zeros((n, most), np.int64)
    for k, (_, tags) in enumerate(rows):
        y[k, :len(tags)] = tags
    real = np.arange(most) < lengths[:, None]
    emit, move, rules = np.zeros((FEATURES, t)), np.zeros((t + 1, t)), _may_follow()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    gold_emit, gold_move = np.zeros_like(emit), np.zeros_like(move)
    for k in range(n):
        before = t
        for i in range(lengths[k]):
            np.add.at(gold_emit, (x[k, i], y[k, i]), 1)
            gold_move[before, y[k, i]] += 1
            before = y[k, i]
    for step in range(1, steps + 1):
        e, m = emit[x].sum(axis=2), move + rules
        a, b = np.zeros((n, most, t)), np.zeros((n, most, t))
        a[:, 0] = m[t] + e[:, 0]
        for i in range(1, most):
            a[:, i] = np.where(real[:, i, None], _log_sum(a[:, i - 1, :, None] + m[:t], 1) + e[:, i], a[:, i - 1])
        for i in range(most - 2, -1, -1):
            b[:, i] = np.where(real[:, i + 1, None], _log_sum(m[:t] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0.0)
        z = _log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * real[:, :, None]
        expect_emit, expect_move = np.zeros_like(emit), np.zeros_like(move)
        for f in range(x.shape[2]):
            np.add.at(expect_emit, x[:, :, f][real], p[real])
        expect_move[t] = p[:, 0].sum(axis=0)
        for i in range(1, most):
            pair = np.exp(a[:, i - 1, :, None] + m[:t] + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None])
            expect_move[:t] += (pair * real[:, i, None, None]).sum(axis=0)
        for (first, second), param, grad in zip(state, (emit, move), (gold_emit - expect_emit - l2 * n * emit, gold_move - expect_move - l2 * n * move)):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            param += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return emit, move + rules


def viterbi(sequences: list[list[list[int]]], emit: np.ndarray, move: np.ndarray, batch: int = 512) -> list[list[int]]:
    """Best tags of each sequence; pieces of similar length share a batch."""
    out: list[list[int]] = [[] for _ in sequences]
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    t = len(TAGS)
    i = 0
    while i < len(order):
        # A batch holds a bounded number of words however long its pieces are.
        j = i + 1
        while j < len(order) and j - i < batch and (j - i + 1) * len(sequences[order[j]]) <= 64 * batch:
            j += 1
        ks = order[i:j]
        i = j
        x, lengths = _padded([sequences[k] for k in ks])
        n, most = x.shape[:2]
        best = move[t] + emit[x[:, 0]].sum(axis=1)
        back = np.zeros((n, most, t), np.int8)
        for w in range(1, most):
            options = best[:, :, None] + move[:t]
            back[:, w] = options.argmax(axis=1)
            new = options.max(axis=1) + emit[x[:, w]].sum(axis=1)
            best = np.where((lengths > w)[:, None], new, best)
        last = best.argmax(axis=1)
        for row, k in enumerate(ks):
            tag, tags = int(last[row]), []
            for w in range(lengths[row] - 1, -1, -1):
                tags.append(tag)
                tag = int(back[row, w, tag])
            out[k] = tags[::-1]
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for c in digits[-2::-2]:
        total += 2 * int(c) - 9 * (int(c) > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then start."""
    spans, at, since = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > since and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            since = m.end()
        at = text.find("@", max(at + 1, since))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def _pieces(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words near a trigger, as offsets."""
    near, out, since = [(m.start(), m.end()) for m in WORD.finditer(text)], [], -1
    low = text.lower()
    if len(low) != len(text):  # A character with a longer lower case would move the offsets.
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    hot = [k for k, (s, e) in enumerate(near) if TRIGGER.search(low[s:e])]
    for k in hot:
        a, b = max(0, k - CONTEXT), min(len(near), k + CONTEXT + 1)
        if out and a <= since:
            out[-1] += near[since:b]
        else:
            out.append(near[a:b])
        since = b
    return out


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in ",;:!?\"'.|[{":
        s += 1
    while e > s and text[e - 1] in ",;:!?\"'.|]}":
        e -= 1
    return s, e


#: What an added span must look like for its kind: digits, or a spelled separator or an address sign.
def _plausible(kind: str, text: str) -> bool:
    n = len(_digits(text))
    if kind == "email":
        return "@" in text or re.search(r"[^\W_].*?\bat\b.*?(?:[^\W_]\.[^\W_]|\bdot\b)", text.lower(), re.S) is not None
    # A card without separators is the pattern's, which knows its check digit.
    return {"ip": 4 <= n <= 12 and text.count(".") >= 3, "card": 13 <= n <= 19 and not text.isdigit(), "phone": 7 <= n <= 15}[kind]


def _added(texts: list[str], base: list[list[tuple[str, int, int]]], model) -> list[list[tuple[str, int, int]]]:
    """Spans the field finds apart from the base spans."""
    pieces, owner = [], []
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            pieces.append(piece)
            owner.append(k)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not pieces:
        return out
    tags = viterbi([_features([texts[k][s:e] for s, e in p]) for k, p in zip(owner, pieces)], *model)
    for k, piece, found in zip(owner, pieces, tags):
        text, i = texts[k], 0
        while i < len(found):
            if not TAGS[found[i]].startswith("B-"):
                i += 1
                continue
            kind, j = TAGS[found[i]][2:], i + 1
            while j < len(found) and TAGS[found[j]] == f"I-{kind}":
                j += 1
            s, e = _trimmed(text, piece[i][0], piece[j - 1][1])
            if s < e and _plausible(kind, text[s:e]) and not any(s < y and x < e for _, x, y in base[k]):
                out[k].append((kind, s, e))
            i = j
    return out


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


_SCHEMA = ("doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
#: Texts handled together.
GROUP = 256


def _scan(batches, model):
    for batch in batches:
        column = batch.column("text")
        ids = batch.column("doc_id")
        hot = pc.match_substring_regex(column, ANY_TRIGGER).to_numpy(zero_copy_only=False).astype(bool)
        rows = [([], [])] * len(column)
        places = np.flatnonzero(hot).tolist()
        for i in range(0, len(places), GROUP):
            some = places[i:i + GROUP]
            texts = [column[k].as_py() for k in some]
            base = [base_spans(t) for t in texts]
            for k, b, a in zip(some, base, _added(texts, base, model)):
                rows[k] = (b, a)
        nothing = hashlib.sha256(b"").hexdigest()
        yield pa.RecordBatch.from_arrays(
            [ids, *[pa.array([sum(s[0] == kind for s in b) for b, _ in rows], pa.int64()) for kind in KINDS],
             pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() if b else nothing for b, _ in rows]),
             pa.array([_listed(b + a) for b, a in rows]), pa.array([len(a) for _, a in rows], pa.int64())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])


def find_personal(docs: DataFrame) -> DataFrame:
    """Personal data of every document.

    Input: ``doc_id, text`` (others are ignored).  Output, one row per input
    row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.
    Counts and hash are of the base patterns; ``spans`` has theirs and the
    field's, ``kind:start:end`` in code points, by kind and start.  A span of the
    field that meets a base span is left out.

    Null texts count as empty; texts without findings have an empty list and
    the hash of the empty string.  Repeated rows have equal results.  An empty
    table gives an empty result.
    """
    model = train()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(lambda it: _scan(it, model), _SCHEMA)


def op3_crf_pii(spark, sf_dir):
    """Personal data in all documents."""
    return find_personal(table(spark, sf_dir, "documents"))
