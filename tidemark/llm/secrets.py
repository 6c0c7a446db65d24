"""Secret scans: Boolean trigram queries over an inverted index, then verification.

Each rule's regular expression is turned into a Boolean query over the trigrams that any match must hold. A task
indexes its texts segment by segment (postings: trigram -> texts of the segment), intersects and unites postings
as the query says, and runs the expression only on the texts that are left. A rule without mandatory trigrams
(runs of hexadecimal digits) scans every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, pick

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base rules first, then the method's own.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed_key", r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}"),
    Rule("bearer", r"(?ai:authorization)[\"']?\x20*:\x20*[\"']?(?ai:bearer)\x20+([A-Za-z0-9._~+/-]{16,}=*)"),
)
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_extra long"

#: A query is ("and", parts), ("or", parts) or a trigram; ("and", ()) holds for every text.
ANY = ("and", ())
_MOST = 64


def _both(a, b):
    parts = tuple(dict.fromkeys(y for x in (a, b) for y in (x[1] if isinstance(x, tuple) and x[0] == "and" else (x,))))
    return parts[0] if len(parts) == 1 else ("and", parts)


def _either(parts):
    parts = tuple(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: frozenset[str]):
    """Every match holds one of the strings."""
    grams = [[s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)] for s in strings]
    each = []
    for g in grams:
        q = ANY
        for x in g:
            q = _both(q, x)
        each.append(q)
    return _either(each)


def _walk(items) -> tuple[frozenset[str] | None, object]:
    """(all lower-case strings that the items can match, if they are few; what any match must hold)."""
    exact: frozenset[str] | None = frozenset([""])
    run, query, whole = frozenset([""]), ANY, True
    for op, arg in items:
        got, more = None, ANY
        if op is _c.LITERAL:
            got = frozenset([chr(arg).lower()])
        elif op is _c.IN and all(k is _c.LITERAL for k, _ in arg) and len(arg) <= 8:
            got = frozenset(chr(v).lower() for _, v in arg)
        elif op is _c.SUBPATTERN:
            got, more = _walk(arg[-1])
        elif op is _c.BRANCH:
            each = [_walk(x) for x in arg[1]]
            more = _either([q if s is None else _both(q, _of_strings(s)) for s, q in each])
            got = frozenset().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
            inner, _ = _walk(arg[2])
            got = None if inner is None else inner | {""}
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            inner, more = _walk(arg[2])
            more = more if inner is None else _both(more, _of_strings(inner))
        elif op is _c.AT:
            got = frozenset([""])
        query = _both(query, more)
        if got is not None and len(run) * len(got) <= _MOST:
            run = frozenset(a + b for a, b in product(run, got))
        else:
            query, run, whole = _both(query, _of_strings(run)), frozenset([""]), False
    exact = run if whole else None
    return exact, query if whole else _both(query, _of_strings(run))


def trigram_query(pattern: str):
    """The Boolean trigram query (over lower-cased bytes) that every match of ``pattern`` satisfies."""
    exact, query = _walk(_parser.parse(pattern))
    return query if exact is None else _both(query, _of_strings(exact))


def _grams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1])) if query[1] else set()


class Segment:
    """Postings of some texts for the trigrams that queries ask for."""

    _lower = np.arange(256, dtype=np.uint32)
    _lower[65:91] += 32

    def __init__(self, texts: list[bytes], number: np.ndarray, grams: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        raw = self._lower[np.frombuffer(b"".join(texts), np.uint8)]
        self.all = set(range(len(texts)))
        self.postings: dict[bytes, set[int]] = {g: set() for g in grams}
        if len(raw) < 3:
            return
        found = number[(raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]]
        at = np.flatnonzero(found)
        edges = np.cumsum(size)
        doc = np.searchsorted(edges, at, side="right")
        at, doc = at[ok := at + 3 <= edges[doc]], doc[ok]
        for pair in np.unique(doc * 256 + found[at]).tolist():
            self.postings[grams[pair % 256 - 1]].add(pair // 256)

    def find(self, query) -> set[int]:
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return set().union(*parts)
        return set.intersection(*sorted(parts, key=len)) if parts else self.all


def scanner(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(_grams, queries)))
    if len(grams) > 255:
        raise ValueError("rules ask for over 255 trigrams")
    number = np.zeros(1 << 24, np.uint8)
    for i, g in enumerate(grams):
        number[int.from_bytes(g, "big")] = i + 1
    # A long run of allowed characters is one match; the shorter ones needn't be built to be dropped.
    compiled = [re.compile(r.pattern[:-1] + "{%d,}" % r.least if r.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern) for r in rules]

    def scan(texts: list[bytes]) -> dict:
        segment = Segment(texts, number, grams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, rx) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in sorted(segment.find(query)):
                text = texts[i].decode("utf-8", "replace")
                for m in rx.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        kinds = [r.kind for r in rules]
        out: dict[str, list] = {f"n_{k}": [] for k in ("assign", "access", "hex")}
        out |= {"base_sha256": [], "spans": [], "n_extra": []}
        for spans in found:
            spans.sort()
            base = [f"{kinds[k]}:{s}:{e}" for s, k, e in spans if rules[k].base]
            count = [0] * len(rules)
            for _, k, _ in spans:
                count[k] += 1
            for k, r in enumerate(rules):
                if r.base and f"n_{r.kind}" in out:
                    out[f"n_{r.kind}"].append(count[k])
            out["base_sha256"].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            out["spans"].append(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans))
            out["n_extra"].append(len(spans) - len(base))
        return out

    return scan


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with the spans of its secrets (code points, end exclusive).

    Null or empty texts have none. Rows are independent, so repeated ids or rows give a result each. A text of any
    length is scanned whole, as a segment of its own if need be. An empty table gives an empty result. No shuffle.
    """
    return map_texts(pick(docs, doc_id=id_col, text=text_col), lambda: scanner(rules), SCHEMA)
