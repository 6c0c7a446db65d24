"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four expressions find the seeds: e-mail addresses, IP addresses, card and phone numbers. The words round a seed
make its patterns (the two words before it; the word before with the word after). Any other run with a digit is a
candidate. Patterns and instances form a bipartite graph with one row per pair, scored in rounds: a pattern's
confidence is S / (S + DOUBT * U + 1) for S instances that are seeds or accepted and U that aren't; an instance
scores one minus the product of its patterns' doubts, is accepted above the threshold and then counts as a seed.
Rounds go on until none is accepted. Accepted candidates are spans of kind ``id``.

Positions come from splitting a text by an expression: lengths of what lies between and of the matches, summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, staged

#: Kinds in order, their expressions (each finds the same matches as the plain one, in linear time:
#: a run is read once, and a match starts where a run does or right where the last match ended) and a cheap test
#: for texts that can't match.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", None, "+")
#: A candidate: a run of identifier characters with a digit.
CANDIDATE = r"(?<![A-Za-z0-9@._%+/-])[A-Za-z@._%+/-]*+[0-9][A-Za-z0-9@._%+/-]*+"
#: Shortest candidate, different seeds that a pattern needs, least score of a found instance, and what an instance that
#: isn't accepted counts against a pattern.
LEAST_CHARS, MIN_SEEDS, MIN_SCORE, DOUBT = 6, 3, 0.6, 0.1
#: Found spans, with their rows, up to which they are broadcast to the texts (24 bytes each); beyond it the join shuffles.
BROADCAST_SPANS = 500_000
_BLOCK, _CHUNK = 128, 256


def _let(value: Column, use) -> Column:
    """use(value), the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op, first: int = 0) -> Column:
    """Running sums (or greatest values: ``op``) of an array of longs, block by block, so that no long array is copied
    for each element."""
    start = F.array(F.lit(first).cast("long"))
    fold = lambda xs: F.aggregate(xs, start, lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))
    rest = lambda xs: F.slice(xs, F.lit(2), F.size(xs))

    def whole(blocks: Column) -> Column:
        before = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(rest(b), lambda v: op(o, v))))

    def several(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        return _let(F.transform(numbers, lambda b: fold(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))), whole)

    return _let(values, lambda v: F.when(F.size(v) > _BLOCK, several(v)).when(F.size(v) > 0, rest(fold(v))).otherwise(F.array().cast("array<long>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _valid(kind: int, x: Column) -> Column:
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == 2:
        digits = F.regexp_replace(x, "[^0-9]", "")

        def luhn(d: Column) -> Column:
            def one(acc: Column, i: Column) -> Column:
                v = F.ascii(F.substring(d, -i, F.lit(1))) - 48
                return acc + F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

            return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), one) % 10 == 0

        return F.element_at(F.transform(F.array(digits), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))), 1)
    if kind == 3:
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15)
    return F.length(x) >= LEAST_CHARS if kind == 4 else F.lit(True)


def _before(part: Column) -> Column:
    """The last word of a text and the one before it, or empty."""
    back = F.reverse(part)
    word = lambda k: F.lower(F.reverse(F.regexp_extract(back, r"\A[^\p{L}]*+(\p{L}++)(?:[^\p{L}]++(\p{L}++))?", k)))
    return F.struct(word(1).alias("last"), word(2).alias("prev"))


def _after(part: Column) -> Column:
    return F.lower(F.regexp_extract(part, r"\A[^\p{L}]*+(\p{L}++)", 1))


def _free(found: Column) -> Column:
    """Of spans found in a text (k, start, end ...), the base ones and the candidates that overlap none, by merging:
    in the order of base starts and candidate ends, a candidate is free if no base span so far ends beyond its start."""
    merged = F.array_sort(F.transform(found, lambda x: F.struct(F.when(x["k"] < 4, x["start"]).otherwise(x["end"]).alias("at"), (x["k"] < 4).alias("base"), x.alias("x"))))

    def keep(m: Column) -> Column:
        ends = _running(F.transform(m, lambda z: F.when(z["base"], z["x"]["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, -1)
        both = F.zip_with(m, ends, lambda z, e: F.struct(z["x"].alias("x"), (z["base"] | (e <= z["x"]["start"])).alias("free")))
        return F.transform(F.filter(both, lambda z: z["free"]), lambda z: z["x"])

    return F.when(F.exists(found, lambda x: x["k"] < 4), _let(merged, keep)).otherwise(found)


def mentions(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text): doc_id, h (of the text), base (kind, start, end), mentions (seed, inst, p1, p2, start, end)."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    every = []
    for k, rx in enumerate((*EXPRESSIONS, CANDIDATE)):
        may = F.contains("text", F.lit(NEEDS[k])) if k < 4 and NEEDS[k] else F.rlike("text", F.lit("[0-9]"))
        m, p = F.regexp_extract_all("text", F.lit(rx), F.lit(0)), F.split("text", rx, -1)
        every.append(F.struct(F.lit(k).alias("k"), F.when(may, m).otherwise(none).alias("m"), F.when(may, p).otherwise(none).alias("p")))
    kinds = F.array(*every)
    kinds = F.transform(
        kinds, lambda z: F.struct(z["k"].alias("k"), z["m"].alias("m"), z["p"].alias("p"), F.transform(z["m"], lambda x, i: (F.length(z["p"][i]) + F.when(i > 0, F.length(z["m"][i - 1])).otherwise(0)).cast("long")).alias("n"))
    )
    kinds = F.transform(kinds, lambda z: F.struct(z["k"].alias("k"), z["m"].alias("m"), z["p"].alias("p"), _running(z["n"], _sum).alias("s")))

    def one(z: Column, x: Column, i: Column) -> Column:
        ok = F.lit(True)
        for k in (1, 2, 3, 4):
            ok = F.when(z["k"] == k, _valid(k, x)).otherwise(ok)
        end = z["s"][i] + F.length(x)
        return F.struct(z["k"].alias("k"), z["s"][i].alias("start"), end.alias("end"), ok.alias("ok"), F.xxhash64(x).alias("inst"), _before(z["p"][i]).alias("left"), _after(z["p"][i + 1]).alias("right"))

    found = F.flatten(F.transform(kinds, lambda z: F.transform(z["m"], lambda x, i: one(z, x, i))))
    t = t.select("doc_id", F.xxhash64("text").alias("h"), F.filter(found, lambda x: x["ok"]).alias("found"))
    t = t.select("doc_id", "h", "found", F.filter("found", lambda x: x["k"] < 4).alias("base"))
    free = _free(F.col("found"))

    def pattern(a: Column, b: Column, tag: int) -> Column:
        return F.when((F.length(a) > 0) & (F.length(b) > 0), F.xxhash64(F.lit(tag), a, b))

    def mention(x: Column) -> Column:
        last, prev = x["left"]["last"], x["left"]["prev"]
        return F.struct(
            (x["k"] < 4).alias("seed"), x["inst"].alias("inst"), pattern(prev, last, 1).alias("p1"), pattern(last, x["right"], 2).alias("p2"), x["start"].alias("start"), x["end"].alias("end")
        )

    base = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end")))
    return t.select("doc_id", "h", base.alias("base"), F.transform(free, mention).alias("mentions"), F.size("base").alias("n_base"))


def accept(edges: DataFrame, min_seeds: int, min_score: float, doubt: float) -> DataFrame:
    """inst of those that aren't seeds and are accepted. edges: pattern, inst, seed, one row per pair.

    Each round joins the pairs with the instances known so far and with the patterns' confidences; both sides hold one
    row per pair or key, however often a passage repeats. Accepted ones stay accepted, so the rounds end.
    """
    known, n = staged(edges.filter("seed").select("inst").distinct(), "pii-known"), -1
    while (now := known.count()) > n:
        n = now
        sure = F.col("k").isNotNull()
        scored = edges.select("pattern", "inst").join(known.select(F.col("inst").alias("k")), F.col("inst") == F.col("k"), "left")
        patterns = scored.groupBy("pattern").agg(F.count("k").alias("s"), F.count("*").alias("n")).filter(F.col("s") >= min_seeds)
        patterns = patterns.select(F.col("pattern").alias("p"), (F.col("s") / (F.col("s") + doubt * (F.col("n") - F.col("s")) + 1)).alias("conf"))
        open_pairs = scored.filter(~sure).join(patterns, F.col("pattern") == F.col("p"))
        more = open_pairs.groupBy("inst").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")).filter(F.col("score") >= min_score - 1e-9)
        known = staged(known.unionByName(more.select("inst")), "pii-known")
    return known.join(edges.filter("seed").select("inst").distinct(), "inst", "left_anti")


def discover(found: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, doubt: float = DOUBT) -> DataFrame:
    """doc_id, h, more (start, end): the spans that patterns find beyond the seeds. found: from mentions()."""
    m = found.select("doc_id", "h", F.inline("mentions"))
    pairs = m.select("seed", "inst", F.explode(F.array("p1", "p2")).alias("pattern")).filter("pattern is not null")
    edges = staged(pairs.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "pii-edges")
    hits = m.filter(~F.col("seed")).join(accept(edges, min_seeds, min_score, doubt), "inst", "left_semi")
    return hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows (with doc_id, h) and the spans found for them. Few enough found spans are broadcast."""
    more = staged(more.withColumnsRenamed({"doc_id": "m_id", "h": "m_h"}), "pii-more")
    few = (more.agg(F.sum(F.size("more") + 2)).first()[0] or 0) <= BROADCAST_SPANS
    side = F.broadcast(more) if few else more
    return rows.join(side, rows["doc_id"].eqNullSafe(side["m_id"]) & (rows["h"] == side["m_h"]), "left")


def _of_kind(k: int):
    return lambda x: x["k"] == k


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the seeds, base_sha256, and all spans (code points, end exclusive).

    Null or empty texts have no spans. Documents are told apart by id and text, so repeated rows get the same
    spans each, and a null id is an id. A text of any length is read whole, in time that grows with its length and
    n log n of its n matches. An empty table gives an empty result.
    """
    found = staged(mentions(pick(docs, doc_id=id_col, text=text_col)), "pii-found")
    all_rows = _with_more(found.select("doc_id", "h", "base"), discover(found))
    name = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda x: F.concat(name[x["k"]], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: F.concat(F.lit("id:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return all_rows.select(
        "doc_id",
        *[F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with each span replaced by its kind, as ``[email]``.

    Overlapping spans become one, named after the first. A null text stays null; all other cases as in find_pii().
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = staged(mentions(flat.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))), "pii-found")
    spans = found.select("doc_id", "h", F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].cast("int").alias("k"))).alias("base")).filter(F.size("base") > 0)
    more = discover(found).select("doc_id", "h", F.transform("more", lambda x: F.struct(x["start"], x["end"], F.lit(len(KINDS)).alias("k"))).alias("base"))
    # Rows with the same id and text have the same spans, so one of them will do.
    spans = spans.groupBy("doc_id", "h").agg(F.first("base").alias("base")).unionByName(more)
    spans = spans.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("base"))).alias("more"))
    rows = _with_more(flat.withColumns({"doc_id": F.col(key), "h": F.xxhash64(F.coalesce(text, F.lit("")))}), spans)
    tags = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, "id")])

    def redacted(chunks: Column) -> Column:
        """The text, cut into chunks of _CHUNK characters, so that no cut reads the text from its start."""

        def cut(a: Column, b: Column) -> Column:
            def part(c: Column) -> Column:
                first = F.greatest(a - c * _CHUNK, F.lit(0))
                return F.substring(F.element_at(chunks, (c + 1).cast("int")), (first + 1).cast("int"), (F.least(b - c * _CHUNK, F.lit(_CHUNK)) - first).cast("int"))

            numbers = F.sequence(F.floor(a / _CHUNK), F.floor((b - 1) / _CHUNK))
            return F.when(a < b, F.array_join(F.transform(numbers, part), "")).otherwise("")

        def whole(ends: Column) -> Column:
            # A span that starts before all earlier ones have ended belongs to the first of them.
            before = lambda i: F.when(i > 0, ends[i - 1]).otherwise(F.lit(0).cast("long"))
            one = lambda x, i: F.when(x["start"] >= before(i), F.concat(cut(before(i), x["start"]), tags[x["k"]])).otherwise("")
            return F.concat(F.array_join(F.transform("more", one), ""), cut(F.element_at(ends, -1), F.length(text)))

        return _let(_running(F.transform("more", lambda x: x["end"]), F.greatest), whole)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    clean = F.when(F.col("more").isNull(), F.col(text)).otherwise(_let(chunks, redacted))
    return rows.select(*[(clean if f"c{i}" == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
