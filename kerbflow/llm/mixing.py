"""Mixing sources to target weights: token sums per source, repetition rates, then floor(rate) copies of each
document and one more by a hash-seeded Bernoulli draw with the fraction as probability. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scratch import Workspace

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: A source table of at most this many rows is broadcast (under 20 MB); beyond it, the join shuffles.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    """Number of maximal runs outside space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sized(source, size) -> (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share the total size by them. A target
    stops at cap times its source's size and the excess is shared again by weight: with sources in order of
    cap * size / weight, the capped ones are a prefix, so running sums find the level without iteration.
    One row per source, so the windows run over the sources, not the documents.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    every = Window.partitionBy()
    order = Window.orderBy((cap * F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "left_size": F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    capped = F.col("left_size") * F.col("weight") > cap * F.col("source_size") * F.col("left_weight")
    s = s.withColumn("open", ~capped).withColumn("k", F.row_number().over(order))
    level = F.min(F.when(F.col("open"), F.struct("k", "left_size", "left_weight"))).over(every)
    s = s.withColumn("level", level)
    shared = (F.col("level.left_size") * F.col("weight")).cast("double") / F.col("level.left_weight")
    target = F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), (cap * F.col("source_size")).cast("double")).otherwise(shared)
    return s.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) from an MD5 of seed and key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every input row with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    Null or blank texts have size 0; null sources are one source; a source of size 0 has target 0 and its rows 0
    copies. Repeated rows share their draw, as it comes from the id (null: the empty string). Other columns,
    clashing names included, pass through: added columns carry the prefix mix_. An empty table gives none.
    """
    sized = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    targets = Workspace(docs.sparkSession, "mix").table(source_targets(sized, weights, cap), "targets")
    small = targets.count() <= BROADCAST_ROWS
    t = targets.select(F.col("source").alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    d = docs.withColumn("mix_size", n_words(F.col(text_col)))
    out = d.join(F.broadcast(t) if small else t, F.col(source_col).eqNullSafe(F.col("mix_key"))).drop("mix_key")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return out.withColumn("mix_copies", whole + (draw(F.col(id_col), seed) < rate - whole).cast("long"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with its copy number mix_copy from 1."""
    plan = plan_mix(docs, **options).where("mix_copies > 0")
    return plan.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP1_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, ([5, 2, 1])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint w from s0),
s2 as (select *, row_number() over o k, (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::bigint ls,
  (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::bigint lw
  from s1 window o as (order by (3 * source_size)::double / w, source asc nulls last)),
o as (select k ok, ls ols, lw olw from s2 where not (ls * w > 3 * source_size * lw) order by k limit 1),
t as (select source, source_size, case when ok is null or k < ok then (3 * source_size)::double else (ols * w)::double / olw end target from s2 left join o on true),
r as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint taken from r
"""
