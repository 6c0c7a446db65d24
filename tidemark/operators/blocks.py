"""Rows that meet in pairs of blocks: for work that takes all pairs, bounded in memory and spread over the tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of vectors of a block at most, blocks at least (from 1,024 rows a block), and numbers of a table of distances.
MOST_ROWS, BLOCK_BYTES, LEAST_BLOCKS = 1 << 14, 16 << 20, 8
CELLS = 1 << 21


def stack(column) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.empty((0, 1))


def spans(n: int, width: int):
    """Slices of n rows, each with about CELLS numbers."""
    step = max(1, CELLS // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, within rounding of the vectors' squares."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def number(n: int, dims: int) -> int:
    """Blocks of n rows: LEAST_BLOCKS up to some 131,000 rows, so that what is moved grows with the rows; then by the size of a block."""
    most = max(256, min(MOST_ROWS, BLOCK_BYTES // (8 * max(1, dims))))
    return max(1, math.ceil(n / most), min(LEAST_BLOCKS, n // 1024))


def meet(df: DataFrame, key: str, blocks: int, fn, schema: str) -> DataFrame:
    """fn(a, b) for each pair of blocks once, tables of Arrow; b is None where a block meets itself. Each row goes to ``blocks`` pairs."""
    names = df.columns
    mine = df.withColumn("_mine", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = mine.select(*names, "_mine", F.least("_mine", "_o").alias("_i"), F.greatest("_mine", "_o").alias("_j"))

    def run(t: pa.Table) -> pa.Table:
        i, j, of = t.column("_i")[0].as_py(), t.column("_j")[0].as_py(), t.column("_mine").to_numpy()
        rows = t.select(names)
        return fn(rows, None) if i == j else fn(rows.filter(pa.array(of == i)), rows.filter(pa.array(of == j)))

    return dealt.repartition(min(4096, blocks * (blocks + 1) // 2), "_i", "_j").groupBy("_i", "_j").applyInArrow(run, schema)
