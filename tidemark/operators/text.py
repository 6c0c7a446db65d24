"""Words, vocabularies and contexts; rows of HTML tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import spaced_tokens, spaced_words
from ..session import stored
from .relate import row_index

#: Characters of a share of the texts, on which word vectors are trained together.
TRAINED = 1 << 25
#: Places of a step of that training at most, noise words they share, noise words that count for each, its first rate, the changes that a step
#: adds up for a word at most, and the most that a component may be.
STEP, NOISE, NEGATIVE, RATE, LUMP, MOST = 2048, 64, 5, 0.05, 8, 8.0


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), token."""
    return df.select(F.col(key), F.posexplode(spaced_tokens(F.col(text))).alias("pos", "token"))


def vocabulary(t: DataFrame, key: str) -> DataFrame:
    """token, id, n: ids in the order of first occurrence (by key, then place). Only distinct tokens are sorted, by range.

    A whole-number key and the place are packed into one decimal, whose least value a hash aggregate can hold.
    """
    whole = t.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    place = F.col(key).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos") if whole else F.struct(key, "pos")
    v = t.groupBy("token").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return row_index(v, "first", out="id").select("token", "id", "n")


def word_counts(t: DataFrame) -> DataFrame:
    """token, n: a vocabulary without ids, where order doesn't matter."""
    return t.groupBy("token").agg(F.count("*").alias("n"))


def contexts(t: DataFrame, key: str, reach: int) -> DataFrame:
    """key, pos, token, context: the ``reach`` tokens either side; places too near the ends are left out."""
    w = Window.partitionBy(key).orderBy("pos")
    near = F.array(*[F.lag("token", i).over(w) for i in range(reach, 0, -1)], *[F.lead("token", i).over(w) for i in range(1, reach + 1)])
    return t.select(key, "pos", "token", near.alias("context")).filter(~F.exists("context", lambda x: x.isNull()))


def text_contexts(df: DataFrame, text: str, reach: int) -> DataFrame:
    """token, context as contexts() has them, from whole texts: each text's words beside themselves moved by 1 to 2 * ``reach``.

    Nothing is shuffled, and no text is copied for its words.
    """
    n = F.greatest(F.size("_w") - 2 * reach, F.lit(0))
    rows = df.select(spaced_tokens(F.col(text)).alias("_w")).filter(F.size("_w") > 2 * reach)
    rows = rows.select(F.inline(F.arrays_zip(*[F.slice("_w", i + 1, n).alias(f"w{i}") for i in range(2 * reach + 1)])).alias(*[f"w{i}" for i in range(2 * reach + 1)]))
    return rows.select(F.col(f"w{reach}").alias("token"), F.array(*[f"w{i}" for i in range(2 * reach + 1) if i != reach]).alias("context"))


def unigram_weights(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """token, weight: n ** power over the sum of all."""
    p = F.pow(F.col("n").cast("double"), F.lit(power))
    total = vocab.agg(F.sum(p).alias("total"))
    return vocab.crossJoin(F.broadcast(total)).select("token", (p / F.col("total")).alias("weight"))


def negative_labels(df: DataFrame, samples: str, target: str) -> DataFrame:
    """labels: 1 where a sampled id is the target, else 0."""
    return df.withColumn("labels", F.transform(samples, lambda x: (x == F.col(target)).cast("int")))


def sample_negatives(df: DataFrame, key: str, cumulative: list[float], n: int, seed: int = 7) -> DataFrame:
    """samples: n ids drawn by a table of cumulative weights, from hashes of key and number so that reruns agree."""
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), F.lit(1_000_003)) / 1_000_003.0
    table = F.array(*map(F.lit, cumulative))
    return df.withColumn("samples", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.size(F.filter(table, lambda c: c <= u(i)))))


def table_rows(df: DataFrame, key: str, html: str, skip: int = 0) -> DataFrame:
    """key, row, cells: the cells of each <tr>, tags removed, without the first ``skip`` rows."""
    rows = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr")).filter(F.col("row") >= skip)
    clean = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))
    return rows.select(key, "row", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), clean).alias("cells"))


def list_items(df: DataFrame, key: str, html: str, tag: str = "li") -> DataFrame:
    """key, n, item: the text of each element of a kind, in order."""
    items = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("n", "item"))
    return items.withColumn("item", F.regexp_replace("item", "<[^>]*>", ""))


def json_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, message: the elements of the array ``messages`` in a JSON text; bad JSON gives none."""
    m = F.from_json(F.get_json_object(text, "$.messages"), "array<string>")
    return df.select(key, F.posexplode(m).alias("n", "message"))


def _add(to: np.ndarray, ids: np.ndarray, change: np.ndarray, n: np.ndarray) -> None:
    """Adds rows of ``n`` changes each; where a word has more than LUMP of them, LUMP times their mean, or steps would overshoot."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    few = np.minimum(1, LUMP / np.add.reduceat(n[order], first)).astype(np.float32)
    to[ids[first]] = np.clip(to[ids[first]] + np.add.reduceat(change[order], first) * few[:, None], -MOST, MOST)


def bag_of_words(ids: np.ndarray, vectors: np.ndarray, reach: int, seed: int) -> None:
    """Trains ``vectors`` in place, once over all places: the mean of the words ``reach`` either side tells a word from noise words.

    Ids are rows of the vectors; the last row, of zeros, is for places between texts (``reach`` of them part two texts and stand at
    the ends). Sums over contexts are differences of running sums within a step.
    """
    pad, span, rng = len(vectors) - 1, 2 * reach + 1, np.random.default_rng(seed)
    out = np.zeros_like(vectors)
    drawn = np.cumsum(np.bincount(ids, minlength=pad + 1)[:pad] ** 0.75)

    def moving(x):
        total = np.cumsum(np.concatenate([np.zeros_like(x[:1]), x]), 0)
        return total[span:] - total[:-span]

    step = max(16, min(STEP, len(ids) // 64))  # few places take as many steps
    for at in range(0, len(ids) - 2 * reach, step):
        rate = np.float32(RATE * max(1e-4, 1 - at / len(ids)))
        w = ids[at : at + step + 2 * reach]
        x, known, mid = vectors[w], w < pad, slice(reach, len(w) - reach)
        n = moving(known.astype(np.float32)) - known[mid]
        use = np.flatnonzero(known[mid] & (n > 0))
        if not len(use):
            continue
        h, target = (moving(x) - x[mid])[use] / n[use, None], w[mid][use]
        noise, times = np.unique(np.searchsorted(drawn, rng.random(NOISE) * drawn[-1], "right"), return_counts=True)
        weight = (times * (rate * NEGATIVE / NOISE)).astype(np.float32)
        y, z = out[target], out[noise]
        with np.errstate(over="ignore"):
            right = rate / (1 + np.exp((h * y).sum(1)))
            wrong = -weight / (1 + np.exp(-h @ z.T))
        wrong[target[:, None] == noise] = 0
        error = np.zeros((len(w) + 2 * reach, x.shape[1]), np.float32)
        error[use + 2 * reach] = right[:, None] * y + wrong @ z
        _add(out, np.concatenate([target, noise]), np.concatenate([right[:, None] * h, wrong.T @ h]), np.concatenate([np.ones_like(right), weight * (len(use) / rate)]))
        _add(vectors, w[known], (moving(error) - error[reach:-reach])[known], np.ones(known.sum()))


def word_vectors(df: DataFrame, text: str, size: int = 32, reach: int = 5, least: int = 5, seed: int = 1, share: int = TRAINED) -> DataFrame:
    """token, vector by a continuous bag of words with noise words. Words of fewer than ``least`` places are left out first.

    Texts are dealt into shares of about ``share`` characters. A share is trained on by one task with its own words alone, from first
    vectors that hashes of the words give; a word's vector is the mean of those of the shares that had it. Neither the driver nor a
    task holds the vocabulary, which MLlib's Word2Vec does in each of its tasks.
    """
    parts = max(1, math.ceil((df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0) / share))
    lines = df.select(spaced_words(F.col(text)).alias("words")).filter("words != ''").withColumn("place", F.monotonically_increasing_id())
    lines = stored(lines.withColumn("share", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int")))  # a place stays the same in both readings
    own = lines.select("share", F.explode(F.split("words", " ")).alias("token")).groupBy("share", "token").agg(F.count("*").alias("n"))
    own = own.withColumn("n", F.sum("n").over(Window.partitionBy("token"))).filter(F.col("n") >= least)  # a row a share
    own = own.select("share", "token", F.xxhash64(F.lit(seed), "token").alias("start"))

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("token")
        ids = {w: i for i, w in enumerate(words.column("token").to_pylist())}
        rows, between = [], np.full(reach, len(ids), np.int32)
        for i in np.argsort(texts.column("place").to_numpy()):
            line = [w for w in map(ids.get, texts.column("words")[int(i)].as_py().split(" ")) if w is not None]
            rows += [between, np.array(line, np.int32)] if line else []
        start = words.column("start").to_numpy().view(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            start = (start ^ (start >> np.uint64(shift))) * np.uint64(by)
        vectors = np.zeros((len(ids) + 1, size), np.float32)
        vectors[:-1] = ((start >> np.uint64(11)) / 2.0**53 - 0.5) / size
        if rows:
            bag_of_words(np.concatenate([*rows, between]), vectors, reach, seed)
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size)
        return pa.table({"token": words.column("token"), "vector": pa.ListArray.from_arrays(ends, pa.array(vectors[:-1].ravel()))})

    from pyspark.ml.functions import array_to_vector

    trained = lines.groupBy("share").cogroup(own.groupBy("share")).applyInArrow(run, "token string, vector array<float>")
    means = trained.groupBy("token").agg(*[F.avg(F.col("vector")[i]).alias(f"v{i}") for i in range(size)])
    return means.select("token", array_to_vector(F.array(*[f"v{i}" for i in range(size)])).alias("vector"))
