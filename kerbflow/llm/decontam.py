"""Benchmark decontamination by spaced seeds: fixed masks hash chosen token positions and ignore the others, test and
training hashes are joined, and the alignment around each hit is compared token by token. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Positions that each mask reads in a span of SPAN tokens. Any window of WINDOW tokens with at most two substitutions
#: holds some mask at some offset without one.
MASKS = ((0, 1, 2, 5, 7), (0, 2, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 8
WINDOW = 12
LEAST = 10
#: Test seeds of up to this many bytes, with the few tokens around each, are broadcast; beyond it both sides shuffle by seed.
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _seeds(words: str, at: str) -> Column:
    """Array of (mask, hash) of the seeds that start at 0-based position ``at``."""
    one = lambda k, mask: F.xxhash64(F.lit(k), *(F.expr(f"{words}[{at} + {o}]") for o in mask))
    return F.array(*(one(k, mask) for k, mask in enumerate(MASKS)))


def _seeded(df: DataFrame, words: str, keep: list[str], at: str) -> DataFrame:
    """A row per position and mask; positions and words stay inside one code-generated stage."""
    spots = df.where(F.size(words) >= SPAN).select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - SPAN)).alias(at))
    return spots.select(*keep, words, at, F.explode(_seeds(words, at)).alias("seed"))


def _around(words: str, at: str, left: Column) -> Column:
    return F.slice(words, F.col(at) - left + 1, left + WINDOW)


def _best(a: str, b: str, left: str, size: str) -> Column:
    """Most equal tokens of a window of ``size`` aligned tokens that holds the seed; a and b start at one alignment."""

    def window(s: Column) -> Column:
        pairs = F.zip_with(F.slice(a, s + 1, F.col(size)), F.slice(b, s + 1, F.col(size)), lambda x, y: (x == y).cast("int"))
        return F.when(s + F.col(size) <= F.least(F.size(a), F.size(b)), F.aggregate(pairs, F.lit(0), lambda t, x: t + x)).otherwise(0)

    return F.array_max(F.transform(F.sequence(F.lit(0), F.col(left)), window))


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id_col, item_col, n_matches, n_hits) of every document that overlaps a test item.

    Overlap: a spaced seed in common and, in some aligned window of 12 tokens that holds it, at least 10 equal tokens
    (items of 8 to 11 tokens: the whole item, with the same share; of 8, not where the first or last differs, as all
    masks read both). Shorter items or texts have no seed and match
    nothing; null texts have no tokens. n_matches is the best window's count, n_hits the number of aligned places whose
    seed leads to an overlap. Rows of one id (or of one item id) count together, place by place; null ids are an id. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("words"))
    test = items.select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("item_words"))
    seeds = _seeded(test, "item_words", ["item"], "item_at")
    # a seed takes along the tokens that any window around it can hold, never its whole item
    lead = F.least("item_at", F.lit(WINDOW - SPAN))
    seeds = seeds.select("seed", "item", "item_at", F.least(F.lit(WINDOW), F.size("item_words")).alias("size"), F.slice("item_words", F.col("item_at") - lead + 1, lead + WINDOW).alias("context"))
    n = seeds.agg(F.sum(F.octet_length(F.array_join("context", " ")) + 64)).first()[0] or 0
    here = _seeded(d, "words", ["doc"], "at")
    if n <= broadcast_bytes:
        hits = here.join(F.broadcast(seeds), "seed")
    else:
        # texts don't travel with every seed: a hit finds its text again by its digest
        d = d.withColumn("digest", F.sha1(F.to_json("words")))
        spots = _seeded(d, "words", ["doc", "digest"], "at").select("digest", "at", "seed")
        hits = spots.join(seeds, "seed").join(d, "digest")
    # only slices leave the join's code-generated stage: no array function that would copy whole texts per position
    left = F.least(F.col("at"), F.col("item_at"), F.lit(WINDOW - SPAN))
    near = hits.select("doc", "item", "at", "item_at", left.alias("left"), "size", _around("words", "at", left).alias("a"), F.slice("context", F.least("item_at", F.lit(WINDOW - SPAN)) - left + 1, left + WINDOW).alias("b"))
    places = near.groupBy("doc", "item", "at", "item_at").agg(*(F.max(c).alias(c) for c in ("left", "size", "a", "b")))
    checked = places.withColumn("n", _best("a", "b", "left", "size")).where(F.col("n") * WINDOW >= LEAST * F.col("size"))
    out = checked.groupBy("doc", "item").agg(F.max("n").cast("long").alias("n_matches"), F.count("*").alias("n_hits"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_matches", "n_hits")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id overlaps a test item; rows with a null id stay if none of them overlaps one."""
    bad = find_leaks(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("_")).distinct()
    # other columns ride in a struct, so that their names cannot clash
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(bad, F.col(f"row.{id_col}").eqNullSafe(bad["_"]), "left_anti").select("row.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    seed = " union all ".join(f"select id, w, p, '{k}' || " + " || ' ' || ".join(f"w[p + {o}]" for o in mask) + " s from {0}" for k, mask in enumerate(MASKS))
    wins = []
    for back in range(WINDOW - SPAN + 1):
        same = " + ".join(f"(case when {i} < z and a.w[a.p - {back} + {i}] = b.w[b.p - {back} + {i}] then 1 else 0 end)" for i in range(WINDOW))
        wins.append(f"case when a.p - {back} >= 1 and b.p - {back} >= 1 and a.p - {back} + z - 1 <= len(a.w) and b.p - {back} + z - 1 <= len(b.w) then {same} end")
    return rf"""
with d0 as (select doc_id id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w from documents),
b0 as (select item_id id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w from benchmark),
d1 as (select id, w, unnest(range(1, len(w) - {SPAN} + 2)) p from d0 where len(w) >= {SPAN}),
b1 as (select id, w, unnest(range(1, len(w) - {SPAN} + 2)) p from b0 where len(w) >= {SPAN}),
d2 as ({seed.replace("{0}", "d1")}),
b2 as (select *, least({WINDOW}, len(w)) z from ({seed.replace("{0}", "b1")})),
h as (select a.id doc_id, b.id item_id, a.p, b.p q, max(z) z, max(greatest({", ".join(wins)})) n from d2 a join b2 b using (s) group by all)
select doc_id, item_id, max(n)::bigint n_matches, count(*)::bigint n_hits from h where n * {WINDOW} >= {LEAST} * z group by doc_id, item_id
"""


OP5_SQL = _sql()
