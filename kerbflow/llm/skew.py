"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than this part of the counted rows, so fewer than HOT keys are, and they may be broadcast.
HOT = 1024
#: Tasks that the rows of a hot key are dealt to.
SPLITS = 128


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys of counts(key, n) with more than 1 / HOT of all n: fewer than HOT rows. ``counts`` is read twice, now for its sum."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT > total).select(key)


def split_join(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with values (one row a key) on ``key``, rows of hot keys dealt to SPLITS tasks by a hash of ``by``.

    Each value of a hot key is copied to those tasks, at most HOT * SPLITS copies in all. ``hot`` must come from hot_keys.
    """
    mark = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    part = F.pmod(F.xxhash64(*by), F.lit(SPLITS)).cast("int")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(mark, key, "left").withColumn("_part", F.when(F.col("_hot"), part).otherwise(F.lit(0))).drop("_hot")
    copied = values.join(mark, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(copied, [key, "_part"], how).drop("_part")
