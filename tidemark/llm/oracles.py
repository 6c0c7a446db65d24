"""DuckDB SQL of the corpus queries that SQL can express. The others are held against plain Python in tests/llm."""

from .licenses import COMMON, MAX_GAP, MIN_ANCHOR, MIN_SHARE, MIN_WORDS, PHRASES, TEMPLATES

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>') AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(body) + CASE WHEN before = role THEN 8 ELSE 12 + length(head) + 1 + 11 END) AS chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS b FROM r GROUP BY 1
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY 1
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""



def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules in order, with the group whose length counts and its least. Runs that must be long say so in the expression.
_ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_RULES = (
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("prefixed_key", r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}", 0, 0),
    ("bearer", f"""{_any_case("authorization")}["\']?\\x20*:\\x20*["\']?{_any_case("bearer")}\\x20+([A-Za-z0-9._~+/-]{{16,}}=*)""", 0, 0),
)


def _secret_rows() -> str:
    each = []
    for k, (kind, rx, group, least) in enumerate(_SECRET_RULES):
        q = "'" + rx.replace("'", "''") + "'"
        each.append(f"SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {q}, 0) AS m, regexp_extract_all(text, {q}, {group}) AS g, string_split_regex(text, {q}) AS p FROM t")
    return " UNION ALL ".join(each)


# Places of matches: the lengths of what lies between them and of the matches before.
_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), a AS ({_secret_rows()}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
y AS (SELECT r, k, kind, CAST(list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM x WHERE length(g[i]) >= least),
z AS (SELECT r, k, s, n, kind || ':' || s || ':' || (s + n) AS span FROM y)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, k, n) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k, n), '') AS spans, count(*) FILTER (WHERE k > 2) AS n_extra
FROM t LEFT JOIN z USING (r) GROUP BY t.r
"""

# Spans of repeats of eight words or more cover what repeated windows of eight cover; the longest repeat is a run of equal
# windows of five at one distance.
_QUALITY = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), f AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) > 4)
), e AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) > 7)
), f2 AS (
  SELECT r, i, g FROM f QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), e2 AS (
  SELECT r, i FROM e QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), c5 AS (
  SELECT r, count(DISTINCT i + k) AS n FROM f2, (SELECT unnest(range(5)) AS k) GROUP BY 1
), c8 AS (
  SELECT r, count(DISTINCT i + k) AS n FROM e2, (SELECT unnest(range(8)) AS k) GROUP BY 1
), d AS (
  SELECT a.r, b.i - a.i AS far, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS run FROM f2 a JOIN f2 b ON a.r = b.r AND a.g = b.g AND a.i < b.i
), lr AS (
  SELECT r, max(n) + 4 AS n FROM (SELECT r, count(*) AS n FROM d GROUP BY r, far, run) GROUP BY 1
), o AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words, coalesce(c8.n, 0) / greatest(len(w), 1)::DOUBLE AS covered_fraction, coalesce(lr.n, 0) AS longest_repeat
  FROM t LEFT JOIN c5 USING (r) LEFT JOIN c8 USING (r) LEFT JOIN lr USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND covered_fraction <= 0.18 AND longest_repeat <= 100 AS kept FROM o
"""

def _fills(rounds: int) -> str:
    """The words left over, offered to the documents near the cut time after time."""
    steps = []
    for k in range(rounds):
        fits = "extra = 0 AND size <= room"
        offered = f"SELECT *, sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, size, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM n{k}"
        taken = f"SELECT * EXCLUDE (run, extra), CASE WHEN {fits} AND run <= room THEN 1 ELSE extra END AS extra FROM ({offered})"
        steps.append(f"n{k + 1} AS (SELECT * EXCLUDE (room), all_room - sum(extra * size) OVER (PARTITION BY source) AS room FROM ({taken}))")
    return ", ".join(steps)


# Sources fill up in the order of their levels, length classes of a source in the order of their lengths.
_MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), z AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS class, (('0x' || substr(md5('17 ' || coalesce(doc_id::VARCHAR, '') || ' ' || size), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM z GROUP BY 1
), f AS (
  SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, coalesce(3 * sum(n) OVER (ORDER BY 3 * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY 3 * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM s
), o AS (
  SELECT *, below + 3 * n / w::DOUBLE * above <= total AS whole FROM f
), t AS (
  SELECT source, n, CASE WHEN whole THEN (3 * n)::DOUBLE ELSE CAST((total - coalesce(sum(3 * n) FILTER (WHERE whole) OVER (), 0)) * w AS DOUBLE) / CAST(sum(w) FILTER (WHERE NOT whole) OVER () AS DOUBLE) END AS target FROM o
), k AS (
  SELECT source, class, sum(size)::DOUBLE AS words, count(*) AS docs, 2.0::DOUBLE ** (-0.125::DOUBLE * class) AS damp FROM z WHERE size > 0 GROUP BY 1, 2
), l AS (
  SELECT k.*, target, 3 * coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 / damp * sum(damp * words) OVER (PARTITION BY k.source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= target * (1 + 1e-12) AS whole
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN whole THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, (target - coalesce(sum(3 * words) FILTER (WHERE whole) OVER (PARTITION BY source), 0)) * damp / sum(damp * words) FILTER (WHERE NOT whole) OVER (PARTITION BY source)) END AS copies FROM l
), r AS (
  SELECT source, class, floor(copies + 1e-9) AS sure, CASE WHEN copies - floor(copies + 1e-9) > 1e-9 THEN least(copies - floor(copies + 1e-9), 1 - 1e-9::DOUBLE) ELSE 0 END AS p,
    target - sum(floor(copies + 1e-9) * words) OVER (PARTITION BY source) AS all_room, greatest(1, least(65536, floor(sum(docs) OVER (PARTITION BY source) / 256))) AS bins FROM c
), q AS (
  SELECT z.*, sure, all_room, bins, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM z LEFT JOIN r ON z.source IS NOT DISTINCT FROM r.source AND z.class = r.class
), b AS (
  SELECT *, odds / (1 + odds) AS rank, CASE WHEN odds IS NOT NULL THEN least(floor(odds / (1 + odds) * bins), bins - 1) END AS bin FROM q
), h AS (
  SELECT source, bin, all_room, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upto FROM b WHERE odds IS NOT NULL GROUP BY 1, 2, 3
), cut AS (
  SELECT source, min(bin) AS bin, min(upto - words) AS spent FROM h WHERE upto > all_room GROUP BY 1
), a AS (
  SELECT b.* EXCLUDE (all_room), cut.bin AS cut_bin, all_room - coalesce(spent, 0) AS all_room, all_room - coalesce(spent, 0) AS room, CASE WHEN odds IS NOT NULL AND (cut.bin IS NULL OR b.bin < cut.bin) THEN 1 ELSE 0 END AS extra FROM b LEFT JOIN cut ON b.source IS NOT DISTINCT FROM cut.source
), n0 AS (
  SELECT * FROM a WHERE bin = cut_bin
), {_fills(4)}, y AS (
  SELECT doc_id, source, size, sure, extra FROM n4 UNION ALL SELECT doc_id, source, size, sure, extra FROM a WHERE bin IS DISTINCT FROM cut_bin OR bin IS NULL
)
SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN size > 0 THEN (coalesce(sure, 0) + extra) * size ELSE 0 END AS BIGINT) AS taken FROM y JOIN t ON y.source IS NOT DISTINCT FROM t.source
"""

#: Kinds of personal data in order, and the candidates: runs of identifier characters with a digit.
_PII_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("id", r"[A-Za-z@._%+/-]*[0-9][A-Za-z0-9@._%+/-]*"),
)
_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::BIGINT WHEN digits[-i]::BIGINT > 4 THEN 2 * digits[-i]::BIGINT - 9 ELSE 2 * digits[-i]::BIGINT END)) % 10 = 0"
_PII_PLACES = " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS p FROM t" for k, (kind, rx) in enumerate(_PII_RULES))

# The words beside a match are those since the last match of its expression and up to the next one.
_PII = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), a AS ({_PII_PLACES}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
y AS (SELECT r, k, kind, m[i] AS inst, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS s,
  list_transform(regexp_extract_all(p[i], '\p{{L}}+'), lambda v: lower(v)) AS before, lower(regexp_extract(p[i + 1], '\p{{L}}+')) AS after FROM x),
z AS (SELECT *, s + length(inst) AS e, row_number() OVER () AS place FROM y WHERE CASE k WHEN 0 THEN TRUE WHEN 1 THEN list_max(list_transform(string_split(inst, '.'), lambda v: v::HUGEINT)) <= 255 WHEN 2 THEN CASE WHEN length(digits) BETWEEN 16 AND 19 THEN {_LUHN} ELSE FALSE END WHEN 3 THEN length(digits) BETWEEN 8 AND 15 ELSE length(inst) >= 6 END),
m AS MATERIALIZED (SELECT * FROM z WHERE k < 4 UNION ALL SELECT * FROM z WHERE k = 4 AND place NOT IN (SELECT c.place FROM z c JOIN z b ON b.r = c.r AND b.k < 4 AND c.k = 4 AND b.s < c.e AND b.e > c.s)),
w AS (SELECT inst, k < 4 AS seed, 1 AS tag, before[-2] AS u, before[-1] AS v FROM m UNION ALL SELECT inst, k < 4, 2, before[-1], nullif(after, '') FROM m),
g AS MATERIALIZED (SELECT tag, u, v, inst, bool_or(seed) AS seed FROM w WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
known(inst, seed) USING KEY (inst) AS (
  SELECT DISTINCT inst, TRUE FROM g WHERE seed
  UNION
  (WITH j AS (SELECT g.*, n.inst IS NOT NULL AS sure FROM g LEFT JOIN recurring.known n ON g.inst = n.inst),
  c AS (SELECT tag, u, v, count(*) FILTER (WHERE sure) / (count(*) FILTER (WHERE sure) + 0.1::DOUBLE * count(*) FILTER (WHERE NOT sure) + 1) AS conf FROM j GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE sure) >= 3)
  SELECT inst, FALSE FROM j JOIN c USING (tag, u, v) WHERE NOT sure GROUP BY 1 HAVING 1 - exp(sum(ln(1 - conf))) >= 0.6::DOUBLE - 1e-9)
),
f AS (SELECT r, k, s, e, kind FROM m WHERE k < 4 UNION ALL SELECT DISTINCT r, k, s, e, kind FROM m WHERE k = 4 AND inst IN (SELECT inst FROM known WHERE NOT seed)),
o AS (SELECT r, k, s, e, kind || ':' || s || ':' || e AS span FROM f)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone,
  sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (WHERE k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, s, e), '') AS spans, count(*) FILTER (WHERE k = 4) AS n_id
FROM t LEFT JOIN o USING (r) GROUP BY t.r
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSE_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', {_quoted(text)})" for k, (label, text) in enumerate(TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES)
_GRAM = f"SELECT {{0}}, i, array_to_string(w[i - {MIN_ANCHOR - 1} : i], ' ') AS g FROM (SELECT {{0}}, w, unnest(range({MIN_ANCHOR}, len(w) + 1)) AS i FROM {{1}})"
_LAP = "greatest(0, a[i].x + a[i].n - a[k].x, a[i].y + a[i].n - a[k].y)"

# Equal runs of words are islands on the diagonals of text and template. An anchor is the longest run that ends at a place,
# where no run goes on one longer.
_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON))
_LICENSES = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, {_LICENSE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pw AS (SELECT t, label, {_LICENSE_WORDS.format("text")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(t, label, text)),
p AS (SELECT *, list_transform(range(len(w) + 1), lambda i: len(list_filter(w[1:i], lambda x: x NOT IN ({_COMMON})))) AS g FROM pw),
q AS (SELECT r, t, x.i AS i, y.i AS j FROM ({_GRAM.format("r", "t")}) x JOIN ({_GRAM.format("t", "p")}) y USING (g)),
u AS (SELECT r, t, i, j, {MIN_ANCHOR - 1} + row_number() OVER (PARTITION BY r, t, i - j, island ORDER BY i) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, t, i - j ORDER BY i) AS island FROM q)),
l AS (SELECT r, i, max(n) AS n FROM u GROUP BY 1, 2), e AS (SELECT l.* FROM l LEFT JOIN l m ON l.r = m.r AND m.i = l.i + 1 WHERE m.n IS DISTINCT FROM l.n + 1),
c AS (SELECT u.r, u.t, list({{'x': u.i - u.n, 'y': u.j - u.n, 'n': u.n}} ORDER BY u.i, u.j) AS a, any_value(p.g) AS g FROM u JOIN e ON u.r = e.r AND u.i = e.i AND u.n = e.n JOIN p ON p.t = u.t GROUP BY 1, 2),
d AS (
  SELECT r, t, a, g, 1::BIGINT AS k, list_transform(a[1:0], lambda v: {{'cover': v.n, 'told': v.n, 'start': v.x}}) AS best FROM c
  UNION ALL
  SELECT r, t, a, g, k + 1, list_append(best, list_max(list_concat([{{'cover': a[k].n, 'told': g[a[k].y + a[k].n + 1] - g[a[k].y + 1], 'start': a[k].x}}], list_transform(list_filter(range(1, k), lambda i: a[i].x + a[i].n >= a[k].x - {MAX_GAP} AND a[i].x < a[k].x AND a[i].y < a[k].y AND {_LAP} < a[k].n),
    lambda i: {{'cover': best[i].cover + a[k].n - {_LAP}, 'told': best[i].told + g[a[k].y + a[k].n + 1] - g[a[k].y + {_LAP} + 1], 'start': best[i].start}})))) FROM d WHERE k <= len(a)
),
s AS (SELECT r, t, unnest(best) AS b, unnest(list_transform(a, lambda v: v.x + v.n)) AS e FROM d WHERE k > len(a)),
o AS (SELECT r, p.label, b.start AS s, e, least(1.0::DOUBLE, b.told / p.g[-1]::DOUBLE) AS share FROM s JOIN p USING (t) WHERE b.cover >= least({MIN_WORDS}, len(p.w)) AND b.told > 0),
f AS (SELECT r, v.label, i - 1 AS i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t) JOIN (VALUES {_PHRASE_ROWS}) v(label, phrase) ON w[i] = string_split(phrase, ' ')[1] AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
fs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM f GROUP BY 1),
os AS (SELECT r, max(share) AS score, coalesce(list(DISTINCT label) FILTER (WHERE share >= {MIN_SHARE}::DOUBLE), []) AS found FROM o GROUP BY 1),
ts AS (SELECT r, string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e, label) AS spans FROM (SELECT DISTINCT r, label, s, e FROM o WHERE share >= {MIN_SHARE}::DOUBLE) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(spans, '') AS template_spans
FROM t LEFT JOIN fs USING (r) LEFT JOIN os USING (r) LEFT JOIN ts USING (r)
"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda v: ascii(v)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda a, b: {eight.replace('[x,', '[xor(a, b),')}), 4294967295)"


_TRIE = rf"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, r, md5(strlen(r) || ':' || r || x)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations) GROUP BY 1
), h AS (
  SELECT *, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20
), n AS (
  SELECT t[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = d), '') AS ends
  FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM r) GROUP BY 1, 2
), k AS (
  SELECT p[1:d - 1] AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(n.p[d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON k.p = n.p
), s AS (
  SELECT p[1:e] AS p, count(*) FILTER (kids = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM m) GROUP BY 1
)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.p = m.p LEFT JOIN n u ON m.d > 0 AND u.p = m.p[1:m.d - 1]
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars")


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in [*(f"{c}::VARCHAR" for c in _FIELDS), text]) + ")"


# d has the tree of every source (g its place), u that of the sources (g 0); x has the nodes on the way of each leaf.
_MERKLE = f"""
WITH RECURSIVE g AS (
  SELECT s, row_number() OVER (ORDER BY s NULLS FIRST) AS g FROM (SELECT DISTINCT source AS s FROM documents)
), l AS (
  SELECT row_number() OVER () AS r, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, changed
  FROM (SELECT doc_id, g, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents d JOIN g ON s IS NOT DISTINCT FROM d.source)
), d AS (
  SELECT 0 AS v, g, i, leaf AS h FROM l
  UNION ALL SELECT v + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM d) WHERE c > 1 GROUP BY v, g, i // 3
), t AS (
  SELECT g, max(v) AS v, arg_max(h, v) AS h FROM d GROUP BY 1
), u AS (
  SELECT 0 AS v, 0 AS g, g - 1 AS i, h FROM t
  UNION ALL SELECT v + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM u) WHERE c > 1 GROUP BY v, g, i // 3
), o AS (
  SELECT max(v) AS v, arg_max(h, v) AS h FROM u
), x AS (
  SELECT r, v, g, i // CAST(3 ** v AS BIGINT) AS i, v AS step FROM (SELECT r, g, i, unnest(range(t.v)) AS v FROM l JOIN t USING (g))
  UNION ALL SELECT r, v, 0, (g - 1) // CAST(3 ** v AS BIGINT), 1000 + v FROM (SELECT r, g, unnest(range(o.v)) AS v FROM l, o)
), n AS (
  SELECT v, g, i, h FROM d UNION ALL SELECT v, g, i, h FROM u
), p AS (
  SELECT r, step, coalesce(string_agg(h, '' ORDER BY n.i) FILTER (n.i < x.i), '') AS b, coalesce(string_agg(h, '' ORDER BY n.i) FILTER (n.i > x.i), '') AS a
  FROM x JOIN n ON n.v = x.v AND n.g = x.g AND n.i // 3 = x.i // 3 GROUP BY r, step
), q AS (
  SELECT r, list(b || '|' || a ORDER BY step) AS way, string_agg(b || a, '' ORDER BY step) AS sides FROM p GROUP BY 1
), f AS (
  SELECT l.*, coalesce(sides, '') AS sides, list_reduce(list_prepend(coalesce(changed, leaf), coalesce(way, [])), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded FROM l LEFT JOIN q USING (r)
)
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(sides) AS proof_sha256, folded AS folded_root, folded = o.h AS verified FROM f JOIN t USING (g), o
"""


SQL: dict[str, str] = {
    "op1_pii": _PII,
    "op3_license_scan": _LICENSES,
    "op4_chat_format": _CHAT,
    "op6_jaccard_join": _JACCARD,
    "op7_near_vectors": _VECTORS,
    "op8_quality_rules": _QUALITY,
    "op9_secret_scan": _SECRETS,
    "op10_mixing": _MIXING,
    "op11_prefix_trie": _TRIE,
    "op13_merkle_manifest": _MERKLE,
}
