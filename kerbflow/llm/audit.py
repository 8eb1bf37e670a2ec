"""Filter interaction audit: every document's failures replayed under all orders of five filters.

Each document's flags are crossed with the 120 orders (a broadcast table of fixed size), each order's five steps are
exploded, the first failing step decides where the document goes, and conditional sums per part, order and step combine
on the map side, so what is shuffled is 600 rows a part and task however many documents there are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import skew
from ..scratch import Workspace

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: str = "text") -> list:
    """Columns a to d: the failures that a text alone decides."""
    words = F.array_remove(F.split(F.col(text), r"[ \t-\r]+"), "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    upper = F.regexp_count(F.col(text), F.lit("[A-Z]"))
    return [words, [(n < 50).alias("a"), (distinct * 100 < n * 65).alias("b"), (upper * 100 > F.length(text) * 5).alias("c"), F.col(text).rlike("[#$%&*|]").alias("d")]]


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) per row of docs(doc_id, text, source); bit i of ``fails`` is set if filter i fails it.

    A null text is empty, a null source the part ''. E fails a row whose text some smaller id holds; a row without an id is
    neither smaller nor larger than any. Rows of one id fail E only through another id. Of several labels of an id any 1
    counts; a row without a label, or without an id, is neither good nor toxic. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "audit")
    words, failures = text_failures()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_words", words).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *failures)
    rows = work.table(rows, "failures")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    texts = work.table(texts, "repeated")
    # a text that many rows hold is dealt to many tasks
    rows = skew.split_join(rows, texts.select("digest", "low"), "digest", skew.hot_keys(texts, "digest"), ["doc_id"], "left")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    rows = rows.withColumn("e", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))).join(marks, "doc_id", "left")
    fails = sum((F.when(F.col(c.lower()), 1 << i).otherwise(0) for i, c in enumerate(LETTERS)), F.lit(0))
    return rows.select("part", fails.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """(number, f1 .. f5): the bit of the filter at each step of each order; 120 rows."""
    rows = ", ".join(str((i, *(1 << LETTERS.index(c) for c in order))) for i, order in enumerate(ORDERS))
    return spark.sql(f"select * from values {rows} as orders(number, f1, f2, f3, f4, f5)")


def replay(flags: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    flags(part, fails, good, toxic), a row a document. An empty table has no parts, so no rows.
    """
    bits = [f"f{i}" for i in range(1, 6)]
    crossed = flags.join(F.broadcast(orders(flags.sparkSession)))
    first = F.expr("case " + " ".join(f"when fails & {f} <> 0 then {i}" for i, f in enumerate(bits, 1)) + " else 6 end")
    crossed = crossed.select("part", "number", "fails", "good", "toxic", first.alias("first"), *bits)
    steps = F.inline(F.array(*(F.struct(F.lit(i).alias("step"), F.col(f).alias("bit")) for i, f in enumerate(bits, 1))))
    rows = crossed.select("part", "number", "fails", "good", "toxic", "first", steps)
    removed = F.col("first") == F.col("step")
    failing = F.col("fails").bitwiseAND(F.col("bit")) != 0
    counted = rows.groupBy("part", "number", "step", "bit").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"), F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"), F.count_if(removed & F.col("toxic")).alias("toxic_lost"))
    # over the counted rows: a part and filter have 120 of them
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    names = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("number") + 1)
    return counted.select("part", names.alias("filter_order"), "step", *COUNTS, shapley.alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return replay(document_flags(docs, labels))


OP12_SQL = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
low as (select text, min(doc_id) low from d group by text),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
f as (select d.doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > low.low, false)] bad,
 coalesce(good, 0) good, coalesce(toxic, 0) toxic from d join low on low.text = d.text left join l on l.doc_id = d.doc_id),
c as (select 'A' x, 1 i union all select 'B', 2 union all select 'C', 3 union all select 'D', 4 union all select 'E', 5),
o as (select a.x || b.x || c1.x || d1.x || e.x filter_order, [a.i, b.i, c1.i, d1.i, e.i] seq from c a, c b, c c1, c d1, c e where len(list_distinct([a.i, b.i, c1.i, d1.i, e.i])) = 5),
r as (select part, filter_order, seq, bad, good, toxic, coalesce(list_position(list_transform(seq, lambda i: bad[i]), true), 6) first from f, o),
s as (select *, seq[step] letter from r, (select unnest([1, 2, 3, 4, 5]) step)),
t as (select part, filter_order, step, letter, count(*) filter (first > step) kept, count(*) filter (first = step) removed, count(*) filter (bad[letter] and first < step) redundant,
 count(*) filter (bad[letter] and len(list_filter(bad, lambda b: b)) = 1) unique_fails, count(*) filter (first = step and good = 1) good_lost, count(*) filter (first = step and toxic = 1) toxic_lost from s group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint shapley from t
"""
