"""Plain Python versions of the operators' definitions, for small tables."""
import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def line_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(cover))


def norm_line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def boiler_words(rows, limit=10):
    """rows: (host, text); words of each row in lines that over ``limit`` rows of the host hold."""
    held = collections.Counter()
    for host, text in rows:
        held.update({(host, norm_line(x)) for x in (text or "").split("\n") if WORD.search(x)})
    return [sum(len(words(x)) for x in (text or "").split("\n") if WORD.search(x) and held[host, norm_line(x)] > limit)
            for host, text in rows]


def targets(sizes, cycle=(5, 2, 1), share=1.5, epochs=2):
    """sizes: source -> words.  Reshares the excess until no target is above its stop."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    done, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in done]
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        part = {s: left * weight[s] / w for s in free}
        over = [s for s in free if part[s] > epochs * sizes[s]]
        if not over:
            return done | part
        done |= {s: float(epochs * sizes[s]) for s in over}


def shingle_set(text, width, lower=True):
    w = words((text or "").translate(ASCII) if lower else text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def contained(docs, items, t=0.8, width=5):
    """docs, items: (id, text).  {(doc_id, item_id): (shared, n)}; equal items once."""
    first = {}
    for i, x in items:
        s = frozenset(shingle_set(x, width))
        if s:
            first[s] = min(i, first.get(s, i))
    out = {}
    for d, x in docs:
        w = words((x or "").translate(ASCII))
        for s, i in first.items():
            n = len(next(iter(s)))
            have = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            shared = len(s & have)
            if shared >= t * len(s) - 1e-9:
                out[d, i] = (shared, len(s))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


SECRET = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secrets(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(SECRET) for m in rx.finditer(text or "") if ok(m)]
    base = sorted(found)
    return base, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda x: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda x: 16 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15),
)


def personal(text):
    spans = [(kind, m.start(), m.end()) for kind, rx, ok in PII for m in rx.finditer(text or "") if ok(m[0])]
    return spans, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def jaccard_components(rows, width=4, percent=85):
    """rows: (doc_id, text).  {doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingle_set(x, width) for d, x in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def crc(text):
    return zlib.crc32((text or "").encode())
