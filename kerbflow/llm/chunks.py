"""Substring dedup by content-defined chunking: a gear rolling hash cuts texts where its top bits are zero, so cuts
move with the content and resist insertions; chunks are deduplicated by digest. Since a passage may hold too few cuts,
seeds of SEED words join them: of any SEED adjacent ones the least hash is taken, so a passage of 2 * SEED - 1 words in
two texts has a seed in common for certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..scratch import Workspace
from . import textkernel as K
from .skew import hot_keys, split_join

_U = np.uint64
#: Bytes that a cut depends on; the hash shifts by one bit a byte, so older bytes have left its 32 bits.
REACH = 32
CUT_BITS = 5
LONGEST = 512
#: Bytes of adjacent repeated chunks that make a repeated passage.
LEAST_RUN = 128
#: Words of a seed; every repeat of at least 2 * SEED - 1 words, that is over 50, holds a common one.
SEED = 26
GEAR = (K._stream(77, 256) >> _U(32)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray, bits: int = CUT_BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk, and its row. h(i) = 2 h(i-1) + gear[byte], over the row's own bytes only."""
    size = np.diff(offsets)
    pad = (REACH - 1) * np.arange(1, len(size) + 1)
    place = np.arange(len(data)) + np.repeat(pad, size)
    h = np.zeros(len(data) + (REACH - 1) * len(size), np.uint32)
    h[place] = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    cut = (h[place] >> np.uint32(32 - bits)) == 0
    cut[offsets[1:][size > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    parts = -(-(ends - starts) // longest)
    if len(parts) and parts.max() > 1:
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + k * longest
        ends = np.minimum(starts + longest, np.repeat(ends, parts))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of every ``width`` adjacent values."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :])


def seeds(data: np.ndarray, offsets: np.ndarray, words: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of the windows of ``words`` words that are least among some ``words`` adjacent ones."""
    starts, ends, ranges = K.spans(data, offsets)
    h, at = K.windows(K.hashes(data, starts, ends, K.AS_IS), ranges, words)
    if len(h) < words:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, _U)
    least = _sliding(h, words, np.minimum)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.arange(len(least)) + words <= at[row[: len(least)] + 1]
    pad = np.zeros(words - 1, _U)
    least = np.concatenate([pad, np.where(inside, least, _U(0)), pad])
    hit = np.flatnonzero((_sliding(least, words, np.maximum) == h) & (h > 0))
    first = hit - at[row[hit]] + ranges[row[hit]]
    return starts[first], ends[first + words - 1], row[hit], h[hit]


def _chunks(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.rows(batches, text_col):
            starts, ends, row = cuts(data, offsets)
            digest = K.hashes(data, starts, ends, K.AS_IS)
            ids = batch.column(batch.schema.get_field_index(id_col))
            s_starts, s_ends, s_row, s_hash = seeds(data, offsets)
            row, begin, end = np.concatenate([row, s_row]), np.concatenate([starts, s_starts]), np.concatenate([ends, s_ends])
            digest = np.concatenate([digest, K.mix(s_hash ^ K.STEP[60])])
            seed = np.arange(len(row)) >= len(starts)
            yield pa.record_batch(
                [ids.take(pa.array(row)), pa.array((begin - offsets[row]).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(K.signed(digest)), pa.array(seed)],
                ["doc", "start", "size", "digest", "seed"],
            )

    return run


def chunk_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, size, digest, seed) of every chunk and seed; starts and sizes in UTF-8 bytes. Null and empty texts have none."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_chunks("doc", "text"), "doc long, start int, size int, digest long, seed boolean")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """Runs of chunks and seeds that other documents hold too: (id_col, start, n_bytes, n_chunks, first_doc, is_first).

    A chunk repeats if two ids hold its digest; runs of at least least_run bytes, and all that hold a repeated seed, are
    returned for every document that holds them, so every repeat of over 50 words has a row. A run may end inside the
    passage: it holds the passage's chunks and seeds, and n_chunks (0 in short ones) counts its chunks. first_doc is the smallest id that holds one of the run's seeds, or of its chunks if it has none; its copy is the one to keep (is_first). A
    document is its id: rows of one id count as one document, and rows without an id are left out. Digests have 64
    bits, and a run needs several adjacent ones. Clean texts have no row; empty tables give none. Repeated digests are
    written once; a digest that many documents hold is dealt to many tasks.
    """
    chunks = chunk_table(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col)
    held = chunks.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc")
    held = Workspace(docs.sparkSession, "passages").table(held.select("digest", "first_doc", "n"), "held")
    dup = split_join(chunks, held.select("digest", "first_doc"), "digest", hot_keys(held, "digest"), ["doc", "start"]).select("doc", "start", "size", "seed", "first_doc")
    dup = dup.dropDuplicates(["doc", "start", "seed"])
    order = Window.partitionBy("doc").orderBy("start")
    end = F.col("start") + F.col("size")
    fresh = F.coalesce((F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start")).cast("int"), F.lit(1))
    runs = dup.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).cast("long").alias("n_bytes"), F.count_if(~F.col("seed")).alias("n_chunks"), F.max("seed").alias("seed"), F.coalesce(F.min(F.when(F.col("seed"), F.col("first_doc"))), F.min("first_doc")).alias("first_doc"))
    out = out.where((F.col("n_bytes") >= least_run) | F.col("seed"))
    return out.select(F.col("doc").alias(id_col), "start", "n_bytes", "n_chunks", "first_doc", (F.col("doc") == F.col("first_doc")).alias("is_first"))


def _without():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                if spans:
                    data, kept, begin = text.encode(), [], 0
                    for s in sorted(spans, key=lambda s: s["start"]):
                        start, end = s["start"], s["end"]
                        # a chunk may end inside a character, which then stays
                        while start < end and data[start] & 0xC0 == 0x80:
                            start += 1
                        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
                            end -= 1
                        kept.append(data[begin:start])
                        begin = max(begin, end)
                    text = b"".join([*kept, data[begin:]]).decode()
                out.append(text)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("row")), pa.array(out, pa.string())], ["row", "text"])

    return run


def deduplicate(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least_run: int = LEAST_RUN) -> DataFrame:
    """docs with each repeated passage left in one place only: in the document of the smallest id, at its first place.

    A chunk or seed goes where another place, earlier by (id, start), holds the same; runs of such ones are cut out if they have
    least_run bytes or hold a seed, so repeats inside one document go too. Texts are cut between characters. Rows without an
    id come last in order; repeated rows (equal id and text) are one document and stay alike. Null and empty texts stay;
    other columns pass through.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    chunks = chunk_table(rows.select("key", "text"), id_col="key").withColumnRenamed("doc", "key")
    ids = rows.groupBy("key").agg(F.min("id").alias("id"))
    placed = chunks.distinct().join(ids, "key").withColumn("place", F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "start"))
    held = placed.groupBy("digest").agg(F.min("place").alias("keep"), F.count("*").alias("n")).where("n > 1")
    held = Workspace(docs.sparkSession, "deduplicate").table(held, "held")
    found = split_join(placed, held.select("digest", "keep"), "digest", hot_keys(held, "digest"), ["key", "start"])
    again = found.where(F.col("place") > F.col("keep")).select("key", "start", "size", "seed")
    order = Window.partitionBy("key").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    fresh = F.coalesce((F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start")).cast("int"), F.lit(1))
    runs = again.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.max("seed").alias("seed")).where(F.col("seed") | (F.col("end") - F.col("start") >= least_run))
    spans = runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, "key", "left").select("row", "text", "spans")
    out = joined.mapInArrow(_without(), StructType([joined.schema["row"], StructField("text", StringType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
