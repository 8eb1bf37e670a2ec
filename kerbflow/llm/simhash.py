"""SimHash near duplicates by tiled exact comparison of fingerprints.

Equal fingerprints collapse first, so copies are never compared. The distinct ones are dealt into blocks by their population
count, a block of each pair of counts within the radius is compared with the other in a task of its own, and inside a
task tiles hold the fingerprints with the same population counts in their four quarters: a pair of tiles whose counts
differ, quarter by quarter summed, by more than the radius is skipped, all others are compared by exclusive-or and bit
counts. A task reports its links as a spanning forest, so a dense group leaves it as about as many rows as it has members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import skew, textkernel as K
from ..operators.graph import components
from ..scratch import Workspace

#: Bytes of a text that are split into words at a time, hashes whose bits are counted at a time.
PIECE = 1 << 20
HASHES = 1 << 15
#: Fingerprints a block holds on average, pairs that are compared at a time, tasks that block pairs are dealt to at most.
BLOCK = 1 << 15
PAIRS = 1 << 20
TASKS = 4096
SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle of a text (A-Z lowered, single spaces), or of all its words if they are fewer."""
    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = cut.start() if cut else len(text)
        words = held + text[at:to].lower().split()
        at = to
        for first in range(0, len(words) - k + 1, HASHES):
            part = words[first : first + HASHES + k - 1]
            line = b" ".join(part)
            ends = np.cumsum([len(w) + 1 for w in part])
            starts = np.concatenate([[0], ends[:-1]])[: len(part) - k + 1].tolist()
            some = True
            yield np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(starts))
        held = words[max(len(words) - k + 1, 0) :] if len(words) >= k else words
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """The bits set in over half the shingle hashes; 0 without words."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k, seed):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row, fp as a signed 64-bit number; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.rows(batches, "text"):
            at = offsets.tolist()
            found = np.fromiter((fingerprint(data[a:b].tobytes(), k, seed) for a, b in zip(at[:-1], at[1:])), np.uint64, len(at) - 1)
            yield pa.record_batch([batch.column(0), pa.array(K.signed(found), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tiles:
    """Fingerprints in order of their quarters' population counts; a tile is a run of equal counts."""

    def __init__(self, fps: np.ndarray):
        counts = np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)
        order = np.lexsort(counts.T)
        self.fps, counts = fps[order], counts[order]
        new = np.concatenate([[True], (counts[1:] != counts[:-1]).any(axis=1)]) if len(fps) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(fps))
        self.counts, self.tile = counts[self.starts], np.cumsum(new) - 1


def close_pairs(a: Tiles, b: Tiles, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and b of fingerprints that differ in at most ``radius`` bits, a bounded number of pairs at a time."""
    for counts, start, end in zip(a.counts, a.starts.tolist(), a.ends.tolist()):
        within = np.abs(b.counts - counts).sum(axis=1) <= radius
        other = np.flatnonzero(within[b.tile])
        if not len(other):
            continue
        fps, rows = b.fps[other], max(1, PAIRS // len(other))
        for at in range(start, end, rows):
            near = np.bitwise_count(a.fps[at : min(at + rows, end), None] ^ fps) <= radius
            i, j = np.nonzero(near)
            if len(i):
                yield i + at, other[j]


class Forest:
    """Components of the fingerprints of one task; keeps the links that joined two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.root[i], self.root[j]
        apart = x != y
        for x, y in np.unique(np.stack([x[apart], y[apart]], axis=1), axis=0).tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.links.append((x, y))
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (Tiles(batch.column(c)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in (0, 1))
                b = b if len(b.fps) else a  # a block with itself
                forest = Forest(len(a.fps) + (0 if a is b else len(b.fps)))
                shift = 0 if a is b else len(a.fps)
                for i, j in close_pairs(a, b, radius):
                    forest.join(i, j + shift)
                if forest.links:
                    fps = a.fps if a is b else np.concatenate([a.fps, b.fps])
                    u, v = np.array(forest.links).T
                    yield pa.record_batch([pa.array(K.signed(fps[u]), pa.int64()), pa.array(K.signed(fps[v]), pa.int64())], ["u", "v"])

    return run


def close_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) with the same components as all pairs of distinct(fp) that differ in at most ``radius`` bits.

    Comparing all with all is the method: work grows with the square of the number of distinct fingerprints (about a
    tenth of all pairs pass the counts), in block pairs of bounded size that spread over all tasks; a block is copied to
    each of its pairs.
    """
    rows = distinct.select("fp", F.bit_count("fp").alias("p"))
    sizes = {p: -(-n // BLOCK) for p, n in rows.groupBy("p").count().collect()}  # 65 rows at most
    splits = F.array(*(F.lit(sizes.get(p, 0)) for p in range(65 + radius)))
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("fp"), F.get(splits, F.col("p"))).cast("int"))
    blocks = dealt.groupBy("p", "s").agg(F.collect_list("fp").alias("fps"))
    # the pairs of a block: with itself and later blocks of its count, and with all blocks of counts up to radius higher
    later = F.flatten(F.transform(F.sequence(F.col("p"), F.col("p") + radius), lambda q: F.transform(
        F.filter(F.sequence(F.lit(0), F.get(splits, q)), lambda s: (s < F.get(splits, q)) & ((q > F.col("p")) | (s >= F.col("s")))), lambda s: F.struct(q.alias("q"), s.alias("r")))))
    left = blocks.select("p", "s", "fps", F.inline(later))
    right = blocks.select(F.col("p").alias("q"), F.col("s").alias("r"), F.col("fps").alias("others"))
    same = left.where("p = q and s = r").select("fps", F.array().cast("array<long>").alias("others"))
    pairs = left.where("p <> q or s <> r").join(right, ["q", "r"]).select("fps", "others").union(same)
    # pairs are few bytes and much work, so their number sets the tasks, not their size
    n = sum(x * (x + 1) // 2 + x * sum(sizes.get(p + d, 0) for d in range(1, radius + 1)) for p, x in sizes.items())
    return pairs.repartition(min(max(n, 1), TASKS)).mapInArrow(_compare(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) per row of docs: component_id is the smallest id reachable over fingerprints that differ in
    at most ``radius`` bits.

    Null, empty and blank texts have fingerprint 0, which links like any other. Texts of fewer than k words are one shingle.
    Repeated rows stay rows of their own. Null ids are never the smallest unless a component has no other. Other columns
    are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col, text_col, k, seed), "rows")
    first = work.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    comp = components(close_links(first, radius), work)
    of = first.select("fp", "low").join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    of = work.table(of, "of")
    least = of.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = of.join(least, "comp").select("fp", "component_id")
    out = skew.split_join(rows, found, "fp", skew.hot_keys(first, "fp"), ["doc_id"])
    return out.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
