"""Self-similarity search over descriptors: blocks of the matrix as matrix products, partial maxima, no row per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Frames of a block: a task holds two blocks and their product.
BLOCK = 256


def _matrix(column: pa.Array, row: int) -> np.ndarray:
    vectors = column[row].values
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


#: Blocks of a stripe at most: a task holds a stripe's vectors, and one block of another.
STRIPE = 64


def _products(gap: int, least: float):
    """Best partners over a stream of cells: a cell's left blocks come first and are held, its right ones pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, best = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            for (i, _), (top, j) in zip(left, best):
                some = top > least
                yield pa.record_batch([pa.array(i[some]), pa.array(j[some]), pa.array(top[some])], ["i", "j", "sim"])

        for batch in batches:
            a, b, side, ts, vecs = batch.columns
            for row in range(batch.num_rows):
                cell, t, m = (a[row].as_py(), b[row].as_py()), ts[row].values.to_numpy(), _matrix(vecs, row)
                if cell != now:
                    yield from found()
                    now, left, best = cell, [], []
                if side[row].as_py() == 0:
                    left.append((t, m))
                    best.append((np.full(len(t), -np.inf), np.zeros(len(t), np.int64)))
                    continue
                order = np.argsort(t, kind="stable")
                later = t[order]
                for (i, own), (top, j) in zip(left, best):
                    if later[-1] < i.min() + gap:
                        continue
                    # equal vectors stay equal whatever the order of sums
                    sim = np.round(own @ m[order].T, 12)
                    sim[later[None, :] < i[:, None] + gap] = -np.inf
                    at = sim.argmax(axis=1)
                    now_top, now_j = sim[np.arange(len(i)), at], later[at]
                    more = (now_top > top) | ((now_top == top) & (now_j < j))
                    top[more], j[more] = now_top[more], now_j[more]
        yield from found()

    return run


def best_later(descriptors: DataFrame, gap: int, least: float) -> DataFrame:
    """(i, j, sim): each frame's most similar one at least ``gap`` steps later, the earliest of equals, above ``least``.

    descriptors(t, vec). Every frame is compared with every later one, that being the operator. Blocks are dealt to stripes and
    the stripes to the cells of a grid, about one cell a task: a vector is copied once per stripe, which is the root of the number of tasks, and
    only each frame's best of a cell is shuffled.
    """
    rows = descriptors.select(F.col("t").cast("long").alias("t"), "vec").withColumn("block", F.floor(F.col("t") / BLOCK))
    low, high = rows.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return rows.selectExpr("t i", "t j", "0e0 sim")
    tasks = int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(-(-(high - low + 1) // STRIPE), min(math.ceil(math.sqrt(2 * tasks)), high - low + 1))
    width = -(-(high - low + 1) // stripes)
    blocks = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("t", "vec"))).alias("f"))
    blocks = blocks.select(F.floor((F.col("block") - low) / width).cast("int").alias("s"), "block", F.col("f.t").alias("ts"), F.col("f.vec").alias("vecs"))
    side = lambda n, a, b, spread: blocks.select(spread.alias("o"), "*").select(a.alias("a"), b.alias("b"), F.lit(n).alias("side"), "block", "ts", "vecs")
    last = F.lit(stripes - 1)
    left = side(0, F.col("s"), F.col("o"), F.explode(F.sequence(F.col("s"), F.greatest(last, F.col("s")))))
    right = side(1, F.col("o"), F.col("s"), F.explode(F.sequence(F.lit(0), F.col("s"))))
    cells = left.union(right).repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "side", "block").drop("block")
    found = cells.mapInArrow(_products(gap, least), "i long, j long, sim double")
    best = found.groupBy("i").agg(F.max(F.struct("sim", (-F.col("j")).alias("k"))).alias("m"))
    return best.select("i", (-F.col("m.k")).alias("j"), F.col("m.sim").alias("sim"))
