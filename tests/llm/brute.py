"""Plain versions of what the corpus operators promise, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return SPACE_WORD.findall(t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


class Sets:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, a):
        while self.root[a] != a:
            self.root[a] = a = self.root[self.root[a]]
        return a

    def join(self, a, b):
        self.root[self.find(a)] = self.find(b)


def least(ids, sets):
    got = {}
    for i, v in enumerate(ids):
        r = sets.find(i)
        got[r] = min(got.get(r, v), v)
    return [got[sets.find(i)] for i in range(len(ids))]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
)


def pii(t):
    spans = [(k, m.start(), m.end()) for k, rx, ok in PII for m in re.finditer(rx, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    n = Counter(k for k, _, _ in spans)
    return [n[k] for k, _, _ in PII], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), spans


SECRETS = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def secrets(t):
    spans = sorted((m.start(), i, m.end()) for i, (_, rx, g, n) in enumerate(SECRETS) for m in re.finditer(rx, t or "") if len(m[g]) >= n)
    return sha(",".join(f"{SECRETS[i][0]}:{a}:{b}" for a, i, b in spans))


PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def licence(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    at = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def shingles(t):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def jaccard(rows):
    """doc_id -> (set size, least id that links reach)."""
    s, sets, index, both = [shingles(t) for _, t in rows], Sets(len(rows)), defaultdict(list), Counter()
    for i, x in enumerate(s):
        for g in x:
            for j in index[g]:
                both[j, i] += 1
            index[g].append(i)
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(s[i]) + len(s[j]) - n):
            sets.join(i, j)
    c = least([k for k, _ in rows], sets)
    return {k: (len(s[i]), c[i]) for i, (k, _) in enumerate(rows)}


def quality(t):
    w, n = words(t), 0
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    n = len(lines) - len(set(lines))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), n, len(hit), failed
