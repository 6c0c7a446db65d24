"""Quality rules: repetition inside a text, found with a suffix array over its words.

Words are runs of bytes other than the six ASCII white-space characters, so an empty, blank or null text has
none. A text is compared with itself only; its rows are independent, repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import filter_texts, map_texts, pick

#: Fixed values of the base counts.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: The method's verdict: repeats of so many words count, may cover this share of the words, and none may be longer.
MIN_REPEAT = 8
MAX_COVERED = 0.18
MAX_LONGEST = 100

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"
)
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_STARTS = np.zeros(256, np.int64)  # bytes that start a code point and aren't white space
_STARTS[[b for b in range(256) if b & 0xC0 != 0x80 and b not in b" \t\n\v\f\r"]] = 1
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeat_lengths(ids: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs again in the same text.

    0 where it is shorter than ``window``. ``ends``: for each word, where its text ends. Only positions whose
    first ``window`` words occur again can have so long a common prefix, so the suffix array is built over
    those: ranks by prefix doubling, then the longest common prefix of neighbours from the ranks of each level.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(np.arange(n) + window <= ends)
    if len(at) < 2:
        return out
    key = ends[at].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    for k in range(window):
        key += (ids[at + k].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[k % 5] * np.uint64(2 * (k // 5) + 1)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    if not again.any():
        return out
    # With each of them the words right after it, so that ranks further on exist wherever they decide an order.
    inside = np.zeros(n, bool)
    for k in range(window + 1):
        inside[np.minimum(at[again] + k, ends[at[again]] - 1)] = True
    at = np.flatnonzero(inside)
    words = [np.where(at + k < ends[at], ids[np.minimum(at + k, n - 1)], -1) for k in range(window)]
    rank = _dense(np.stack([ends[at], *words], 1))
    pos = np.full(n, -1, np.int64)  # of a word among the candidates
    pos[at] = np.arange(len(at))
    levels, width = [(window, rank.astype(np.int32))], window
    while True:
        counts = np.bincount(rank)
        if counts.max() < 2:
            break
        nxt = np.minimum(at + width, n - 1)
        second = np.where((at + width < ends[at]) & (pos[nxt] >= 0), rank[np.maximum(pos[nxt], 0)], -1)
        rank = _dense(np.stack([rank, second], 1))
        width *= 2
        levels.append((width, rank.astype(np.int32)))
    sa = np.argsort(rank)
    a, b = at[sa[:-1]], at[sa[1:]]
    lcp = np.zeros(len(a), np.int64)
    for width, level in reversed(levels):
        i, j = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        ok = (a + lcp < ends[a]) & (b + lcp < ends[b]) & (pos[i] >= 0) & (pos[j] >= 0)
        ok &= level[np.maximum(pos[i], 0)] == level[np.maximum(pos[j], 0)]
        lcp += np.where(ok, width, 0)
    for _ in range(window - 1):  # what is left is shorter than a window; a step after a difference finds it again
        i, j = a + lcp, b + lcp
        lcp += (lcp >= window) & (i < ends[a]) & (j < ends[b]) & (ids[np.minimum(i, n - 1)] == ids[np.minimum(j, n - 1)])
    best = np.zeros(len(at), np.int64)
    np.maximum.at(best, sa[:-1], lcp)
    np.maximum.at(best, sa[1:], lcp)
    out[at] = np.where(best >= window, best, 0)
    return out


def _dense(rows: np.ndarray) -> np.ndarray:
    order = np.lexsort(rows.T[::-1])
    new = np.r_[False, (rows[order][1:] != rows[order][:-1]).any(1)]
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def byte_counts(text: bytes) -> np.ndarray:
    """How often each byte occurs, a piece of the text at a time."""
    out = np.zeros(256, np.int64)
    for s in range(0, len(text), 1 << 20):
        out += np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, len(text) - s), s), minlength=256)
    return out


def measure(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> dict:
    m = len(texts)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(n_words.sum()))
    ends = np.repeat(np.cumsum(n_words), n_words)
    doc = np.repeat(np.arange(m), n_words)
    lengths = repeat_lengths(ids, ends)
    n, at = len(ids), np.flatnonzero(lengths)
    per_doc = lambda mask: np.bincount(doc[mask], minlength=m) if n else np.zeros(m, np.int64)
    repeat_words = per_doc(covered(at, np.full(len(at), WINDOW), n)) if len(at) else np.zeros(m, np.int64)
    far = at[lengths[at] >= min_repeat]
    spans = per_doc(covered(far, lengths[far], n)) if len(far) else np.zeros(m, np.int64)
    longest = np.zeros(m, np.int64)
    if len(at):
        np.maximum.at(longest, doc[at], lengths[at])
    counts = np.stack([byte_counts(t) for t in texts]) if m else np.zeros((0, 256), np.int64)
    dup = np.zeros(m, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = Counter(x for x in t.split(b"\n") if x.strip(b" \t\v\f\r"))
            dup[i] = lines.total() - len(lines)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    fraction = spans / np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": counts @ _STARTS, "n_symbols": counts @ _IS_SYMBOL, "n_dup_lines": dup, "n_repeat_words": repeat_words,
        "base_failed": failed, "kept": ~failed & (fraction <= max_covered) & (longest <= max_longest), "covered_fraction": fraction, "longest_repeat": longest,
    }


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row per document with counts, the base rule and the verdict ``kept``.

    Null or empty texts have no words and fail. A text of any length is judged whole (n log n of its n words); repeated
    rows get a result each. An empty table gives an empty result. There is no shuffle.
    """
    return map_texts(pick(docs, doc_id=id_col, text=text_col), lambda: lambda t: measure(t, min_repeat, max_covered, max_longest), SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows and columns of ``docs`` whose text quality_rules() keeps.

    Each text goes to Python once and only kept rows come back. Rows are judged as in quality_rules().
    """
    names = docs.columns
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = filter_texts(flat, f"c{names.index(text_col)}", lambda: lambda t: measure(t, **limits)["kept"])
    return kept.toDF(*names)
