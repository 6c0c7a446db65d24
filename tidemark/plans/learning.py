"""Queries on itemsets, text, evaluation and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, itemsets, splits, text
from .registry import query

_ITEMS = "SELECT DISTINCT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON p_partkey = l_partkey"


def _baskets(t):
    return itemsets.baskets(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_type")


def _text(c):
    return F.array_join(c, "|").alias(c)


@query(f"SELECT basket, string_agg(item, '|' ORDER BY item) AS items FROM ({_ITEMS}) GROUP BY 1")
def baskets(t):
    return _baskets(t).select("basket", _text("items"))


@query(f"""WITH i AS ({_ITEMS}), f AS (SELECT item, count(*) AS n FROM i GROUP BY 1) SELECT basket, string_agg(item, '|' ORDER BY n DESC, item) AS items FROM i JOIN f USING (item) GROUP BY 1""")
def baskets_by_frequency(t):
    return itemsets.order_by_frequency(_baskets(t)).select("basket", _text("items"))


_LEAST = 400
# Every subset of the frequent items of every basket is counted.
_EVERY = f"""i AS ({_ITEMS}), o AS (SELECT item FROM i GROUP BY 1 HAVING count(*) >= {_LEAST}), b AS (SELECT basket, list(item ORDER BY item) AS w FROM i SEMI JOIN o USING (item) GROUP BY 1), u AS (SELECT w, unnest(range(1, (2 ** len(w))::BIGINT)) AS m FROM b),
f AS (SELECT array_to_string(list_filter(w, lambda x, j: (m >> (j - 1)) & 1 = 1), '|') AS items, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= {_LEAST})"""


@query(f"WITH {_EVERY} SELECT * FROM f")
def apriori_levels(t):
    return itemsets.apriori(_baskets(t), _LEAST).select(_text("items"), "n")


@query(f"WITH {_EVERY} SELECT * FROM f")
def fpgrowth_itemsets(t):
    b = _baskets(t)
    return itemsets.fp_growth(b, _LEAST, b.count()).select(_text("items"), "n")


@query(f"WITH {_EVERY} SELECT * FROM f")
def vertical_itemsets(t):
    return itemsets.vertical(_baskets(t), _LEAST).select(_text("items"), "n")


@query(f"WITH i AS ({_ITEMS}), b AS (SELECT basket, row_number() OVER (ORDER BY basket) - 1 AS tid FROM i GROUP BY 1) SELECT item, count(*) AS n, count(DISTINCT tid // 65536) AS ranges FROM i JOIN b USING (basket) GROUP BY 1")
def item_tid_sets(t):
    return itemsets.tid_sets(_baskets(t)).groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("ranges"))


_RULES = f"""t AS (SELECT count(DISTINCT basket)::DOUBLE AS total FROM i), s AS (SELECT string_split(items, '|') AS items, n FROM f), m AS (SELECT items, n, unnest(range(1, (2 ** len(items) - 1)::BIGINT)) AS m FROM s WHERE len(items) > 1),
x AS (SELECT n AS nxy, list_filter(items, lambda x, j: (m >> (j - 1)) & 1 = 1) AS a, list_filter(items, lambda x, j: (m >> (j - 1)) & 1 = 0) AS c FROM m),
r AS (SELECT array_to_string(a, '|') AS antecedent, array_to_string(c, '|') AS consequent, nxy / total AS s, p.n / total AS x, q.n / total AS y, nxy / p.n::DOUBLE AS conf FROM x JOIN s p ON p.items = a JOIN s q ON q.items = c, t)
SELECT antecedent, consequent, round(s, 9) AS support, round(x, 9) AS antecedent_support, round(y, 9) AS consequent_support, round(conf, 9) AS confidence, round(conf / y, 9) AS lift, round(s - x * y, 9) AS leverage, round(CASE WHEN conf < 1 THEN (1 - y) / (1 - conf) END, 9) AS conviction, round((s - x * y) / nullif(greatest(s * (1 - x), x * (y - s)), 0), 9) AS zhang FROM r"""


@query(f"WITH {_EVERY}, {_RULES}")
def association_rules_full(t):
    b = _baskets(t)
    r = itemsets.rules(itemsets.apriori(b, _LEAST), b.count())
    return r.select(_text("antecedent"), _text("consequent"), *[F.round(c, 9).alias(c) for c in r.columns[2:]])


# The names that these had while the three above ended at three items.
@query(f"WITH {_EVERY} SELECT * FROM f")
def apriori_all_sizes(t):
    return itemsets.apriori(_baskets(t), _LEAST).select(_text("items"), "n")


@query(f"WITH {_EVERY} SELECT * FROM f")
def fpgrowth_all_sizes(t):
    b = _baskets(t)
    return itemsets.fp_growth(b, _LEAST, b.count()).select(_text("items"), "n")


@query(f"WITH {_EVERY}, {_RULES}")
def association_rules_all_sizes(t):
    b = _baskets(t)
    r = itemsets.rules(itemsets.apriori(b, _LEAST), b.count())
    return r.select(_text("antecedent"), _text("consequent"), *[F.round(c, 9).alias(c) for c in r.columns[2:]])


_PUNCT = r"""([.,!?;:()\[\]{}"''])"""
_TOKENS = f"""SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[\\r\\n]+', ' ', 'g'), '{_PUNCT}', ' \\1 ', 'g')), '\\s+'), lambda x: x <> '') AS w FROM documents)"""


def _tokens(t):
    return text.tokens(t.documents, "doc_id", "text")


@query(f"SELECT doc_id, count(*) AS n, count(DISTINCT token) AS distinct_n FROM ({_TOKENS}) GROUP BY 1")
def tokenize(t):
    return _tokens(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("distinct_n"))


_VOCAB = f"SELECT token, row_number() OVER (ORDER BY min((doc_id, pos))) - 1 AS id, count(*) AS n FROM ({_TOKENS}) GROUP BY 1"


@query(_VOCAB)
def vocabulary_ids(t):
    return text.vocabulary(_tokens(t), "doc_id")


@query(f"""WITH t AS (SELECT *, lag(token, 2) OVER w AS a, lag(token, 1) OVER w AS b, lead(token, 1) OVER w AS c, lead(token, 2) OVER w AS d FROM ({_TOKENS}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT token, count(*) AS n, count(DISTINCT concat_ws(' ', a, b, c, d)) AS contexts FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY 1""")
def context_windows(t):
    c = text.text_contexts(t.documents, "text", 2)
    return c.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct(F.array_join("context", " ")).alias("contexts"))


@query(f"WITH v AS ({_VOCAB}) SELECT token, round(n ** 0.75 / sum(n ** 0.75) OVER (), 10) AS weight FROM v")
def unigram_power_weights(t):
    return text.unigram_weights(text.word_counts(_tokens(t))).select("token", F.round("weight", 10).alias("weight"))


@query("""SELECT event_id, array_to_string(list_transform([user_id % 5, (user_id + 1) % 5, (event_id * 3) % 5], lambda x: CAST(x = event_id % 5 AS INTEGER)), '') AS labels FROM events""")
def negative_sample_labels(t):
    e = t.events.select("event_id", F.array(F.col("user_id") % 5, (F.col("user_id") + 1) % 5, (F.col("event_id") * 3) % 5).alias("s"), (F.col("event_id") % 5).alias("t"))
    return text.negative_labels(e, "s", "t").select("event_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@query("""SELECT page_id, CAST(unnest(range(len(i))) AS INTEGER) AS n, regexp_replace(unnest(i), '<[^>]*>', '', 'g') AS item FROM (SELECT page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1) AS i FROM pages)""")
def html_table_rows(t):
    return text.list_items(t.pages, "page_id", "html")


@query("""SELECT event_id, CAST(0 AS INTEGER) AS n, 'k' || CAST(props->>'$.k' AS VARCHAR) AS message FROM events""")
def json_messages(t):
    j = F.concat(F.lit('{"messages": ["k'), F.get_json_object("props", "$.k"), F.lit('"]}'))
    return text.json_messages(t.events.select("event_id", j.alias("j")), "event_id", "j")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_roles(t):
    s = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(s, lambda x: x["role"]), ">").alias("roles"))


def _scored(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", F.col("n_chars").alias("score"))


_SCORED = "SELECT l.doc_id, quality, toxic, n_chars AS score FROM labels l JOIN documents USING (doc_id)"
_CURVE = f"""WITH d AS ({_SCORED}), g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM d GROUP BY 1),
c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC))"""


@query(f"{_CURVE} SELECT score, round(fp / neg::DOUBLE, 9) AS fpr, round(tp / pos::DOUBLE, 9) AS tpr FROM c")
def roc_curve_binary(t):
    return evaluate.roc_curve(_scored(t), F.col("score"), F.col("quality") == 1).select("score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"{_CURVE} SELECT round(sum(q * (tp - p / 2.0::DOUBLE)) / any_value(pos * neg), 9) AS auc FROM c")
def auc(t):
    return evaluate.auc(_scored(t), F.col("score"), F.col("quality") == 1).select(F.round("auc", 9).alias("auc"))


@query(f"{_CURVE} SELECT score, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / pos::DOUBLE, 9) AS recall FROM c")
def pr_curve(t):
    return evaluate.pr_curve(_scored(t), F.col("score"), F.col("quality") == 1).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"{_CURVE} SELECT round(sum(p * tp / (tp + fp)::DOUBLE) / any_value(pos), 9) AS average_precision FROM c")
def average_precision(t):
    return evaluate.average_precision(_scored(t), F.col("score"), F.col("quality") == 1).select(F.round("average_precision", 9).alias("average_precision"))


@query("""WITH d AS (SELECT p_size % 3 AS y, p_retailprice::DOUBLE AS s FROM part), o AS (SELECT 0 AS class, s AS score, y = 0 AS hit FROM d UNION ALL SELECT 1, -s, y = 1 FROM d UNION ALL SELECT 2, s % 100, y = 2 FROM d),
a AS (SELECT score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS q FROM o GROUP BY 1), b AS (SELECT p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM a),
g AS (SELECT class, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS q FROM o GROUP BY 1, 2),
c AS (SELECT class, sum(q) OVER w / sum(q) OVER (PARTITION BY class) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY class) AS tpr FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC) UNION ALL SELECT DISTINCT class, 0, 0 FROM g),
e AS (SELECT class, fpr, max(tpr) AS high, min(tpr) AS low FROM c GROUP BY 1, 2), s AS (SELECT *, lead(fpr) OVER w AS next, lead(low) OVER w AS next_low FROM e WINDOW w AS (PARTITION BY class ORDER BY fpr)),
x AS (SELECT class, i, i / 100.0::DOUBLE AS x FROM (SELECT DISTINCT class FROM g), range(101) r(i)), y AS (SELECT x.i, avg(CASE WHEN s.next IS NULL OR s.fpr = x.x THEN high ELSE high + (next_low - high) * (x.x - s.fpr) / (next - s.fpr) END) AS y FROM x ASOF JOIN s ON x.class = s.class AND x.x >= s.fpr GROUP BY 1)
SELECT 'micro' AS kind, round(sum(q * (tp - p / 2.0::DOUBLE)) / any_value(pos * neg), 6) AS auc FROM b UNION ALL SELECT 'macro', round(sum(h), 6) FROM (SELECT (y + lag(y) OVER (ORDER BY i)) / 200 AS h FROM y)""")
def roc_macro_micro(t):
    c = t.part.select((F.col("p_size") % 3).alias("y"), F.col("p_retailprice").alias("s"))
    ovr = evaluate.one_vs_rest(c, "y", {0: F.col("s"), 1: -F.col("s"), 2: F.col("s") % 100})
    return evaluate.macro_micro_auc(ovr).select("kind", F.round("auc", 6).alias("auc"))


_PRED = f"SELECT quality AS label, CAST(score > 500 AS INTEGER) AS predicted FROM ({_SCORED})"


def _predicted(t):
    return _scored(t).select(F.col("quality").alias("label"), (F.col("score") > 500).cast("int").alias("predicted"))


@query(f"SELECT label, predicted, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def confusion_matrix(t):
    return evaluate.confusion(_predicted(t), "label", "predicted")


@query(f"""WITH d AS ({_PRED}), c AS (SELECT label AS class FROM d UNION SELECT predicted FROM d), g AS (SELECT class, count(*) FILTER (WHERE label = class AND predicted = class) AS tp, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE predicted = class) AS pr FROM c, d GROUP BY 1)
SELECT class, round(coalesce(tp / nullif(pr, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 9) AS recall, round(2.0::DOUBLE * tp / (support + pr), 9) AS f1, support FROM g""")
def class_report(t):
    r = evaluate.class_report(_predicted(t), "label", "predicted")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"SELECT round(avg(CAST(label = predicted AS DOUBLE)), 9) AS accuracy, count(*) AS n FROM ({_PRED})")
def accuracy(t):
    return evaluate.accuracy(_predicted(t), "label", "predicted").select(F.round("accuracy", 9).alias("accuracy"), "n")


@query("""SELECT round(avg((o_totalprice - 250000) ** 2), 1) AS mse, round(1 - sum((o_totalprice - 250000) ** 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2 FROM orders""")
def r2_mse(t):
    r = evaluate.regression_report(t.orders.withColumn("p", F.lit(250000.0)), "o_totalprice", "p")
    return r.select(F.round("mse", 1).alias("mse"), F.round("r2", 6).alias("r2"))


@query("""WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), p AS (SELECT o_orderpriority, n / sum(n) OVER (PARTITION BY o_orderpriority) AS p FROM n) SELECT o_orderpriority, round(-sum(p * log2(p)), 6) AS entropy, round(1 - sum(p * p), 6) AS gini FROM p GROUP BY 1""")
def gini_entropy(t):
    return splits.impurity(t.orders, "o_orderstatus", ["o_orderpriority"]).select("o_orderpriority", F.round("entropy", 6).alias("entropy"), F.round("gini", 6).alias("gini"))


def _split_sql(f: str) -> str:
    return f"""(WITH e AS (SELECT min({f})::DOUBLE AS a, (max({f})::DOUBLE - min({f})::DOUBLE) / 101 AS step FROM part), c AS (SELECT p_size % 2 AS y, least(greatest(ceil(({f}::DOUBLE - a) / step), 1), 101) AS cell, count(*) AS n FROM part, e GROUP BY 1, 2),
s AS (SELECT k, y, sum(CASE WHEN cell <= k THEN n ELSE 0 END)::DOUBLE AS l, sum(n)::DOUBLE AS t FROM (SELECT unnest(range(1, 101)) AS k), c GROUP BY 1, 2), g AS (SELECT k, sum(l) AS nl, sum(t) AS nt, sum(t - l) AS nr, sum(l * l) AS sl, sum(t * t) AS st, sum((t - l) * (t - l)) AS sr,
sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS el, sum(CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END) AS et, sum(CASE WHEN t - l > 0 THEN (t - l) * log2(t - l) ELSE 0 END) AS er FROM s GROUP BY 1 HAVING sum(l) > 0 AND sum(t - l) > 0)
SELECT '{f}' AS feature, round(a + k * step, 6) AS threshold, round(1 - st / nt ** 2 - (nl * (1 - sl / nl ** 2) + nr * (1 - sr / nr ** 2)) / nt, 6) AS gini_gain, round(log2(nt) - et / nt - (nl * (log2(nl) - el / nl) + nr * (log2(nr) - er / nr)) / nt, 6) AS entropy_gain FROM g, e
ORDER BY round(1 - st / nt ** 2 - (nl * (1 - sl / nl ** 2) + nr * (1 - sr / nr ** 2)) / nt, 12) DESC, k LIMIT 1)"""


@query(f"{_split_sql('p_retailprice')} UNION ALL {_split_sql('p_partkey')}")
def best_split_grid(t):
    p = t.part.select((F.col("p_size") % 2).alias("y"), "p_retailprice", "p_partkey")
    b = splits.best_split(p, ["p_retailprice", "p_partkey"], "y")
    return b.select("feature", *[F.round(c, 6).alias(c) for c in ("threshold", "gini_gain", "entropy_gain")])


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_orderstatus, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS w FROM c) SELECT o_orderkey, round(w, 9) AS weight FROM orders JOIN w USING (o_orderstatus)""")
def balanced_weights(t):
    return splits.balanced_weights(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", F.round("weight", 9).alias("weight"))


@query("""WITH c AS (SELECT c_mktsegment AS m, avg(c_acctbal) AS a, avg(c_nationkey) AS b FROM customer GROUP BY 1), d AS (SELECT c_custkey, sqrt((c_acctbal - a) ** 2 + (c_nationkey - b) ** 2) AS d FROM customer JOIN c ON m = c_mktsegment), r AS (SELECT min(d) AS lo, max(d) AS hi FROM d)
SELECT c_custkey, round(greatest(0.001, least(1.0, 1 - (d - lo) / (hi - lo))), 6) AS weight FROM d, r""")
def fuzzy_weights(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    return splits.fuzzy_weights(c, ["c_acctbal", "c_nationkey"], "c_mktsegment").select("c_custkey", F.round("weight", 6).alias("weight"))


@query("""WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, CAST(floor(n * 0.8) AS BIGINT) AS train, n FROM n""")
def stratified_split(t):
    s = splits.stratified_split(t.orders, "o_orderkey", "o_orderstatus", 0.8, 3)
    return s.groupBy("o_orderstatus").agg(F.count_if("is_train").alias("train"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, CAST(unnest(range(5)) AS INTEGER) AS fold, (n - unnest(range(5)) + 4) // 5 AS n FROM n""")
def stratified_folds(t):
    return splits.folds(t.orders, "o_orderkey", "o_orderstatus", 5).groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


def _draw(n: int) -> str:
    return f"(('0x' || substr(md5('{n} ' || a || ' ' || i), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


@query(f"""WITH m AS (SELECT s_suppkey AS a, s_acctbal::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier WHERE s_nationkey < 5), n AS (SELECT p.a, q.x, q.y, row_number() OVER (PARTITION BY p.a ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.a) AS k FROM m p JOIN m q ON p.a <> q.a),
c AS (SELECT a, list({{'x': x, 'y': y}} ORDER BY k) FILTER (WHERE k <= 5) AS near FROM n GROUP BY 1), d AS (SELECT m.*, near, unnest([1, 2]) AS i FROM m JOIN c USING (a)), o AS (SELECT *, near[CAST(floor({_draw(1)} * len(near)) AS BIGINT) + 1] AS z, {_draw(2)} AS u FROM d)
SELECT a AS origin, CAST(i AS INTEGER) AS i, round(x + (z.x - x) * u, 6) AS s_acctbal, round(y + (z.y - y) * u, 6) AS nation FROM o""")
def smote(t):
    s = splits.smote(t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation")), "s_suppkey", ["s_acctbal", "nation"], F.col("s_nationkey") < 5, 2)
    return s.select("origin", "i", F.round("s_acctbal", 6).alias("s_acctbal"), F.round("nation", 6).alias("nation"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def ols_line(t):
    return t.lineitem.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("""SELECT s_suppkey, CAST(unnest([1, 2]) AS INTEGER) AS row, unnest([s_name || '|' || s_suppkey, 'nation|' || s_nationkey]) AS cells FROM supplier""")
def table_rows_cells(t):
    cells = lambda tag, *v: F.concat(F.lit("<tr class='r'>"), *[F.concat(F.lit(f"<{tag}> <b>"), x.cast("string"), F.lit(f"</b></{tag.upper()}>")) for x in v], F.lit("</tr>\n"))
    h = F.concat(F.lit("<TABLE>"), cells("th", F.lit("name"), F.lit("value")), cells("td", F.col("s_name"), F.col("s_suppkey")), cells("td", F.lit("nation"), F.col("s_nationkey")), F.lit("</table>"))
    return text.table_rows(t.supplier.select("s_suppkey", h.alias("h")), "s_suppkey", "h", 1).select("s_suppkey", "row", F.array_join("cells", "|").alias("cells"))
