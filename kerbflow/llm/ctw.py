"""Language-model scoring by context-tree weighting over bytes.

Each next byte is eight binary decisions; each decision has a context tree over the last D bytes whose nodes mix
Krichevsky-Trofimov estimates of all depths. KT block probabilities depend on counts alone, so training is counting
byte (D+1)-grams. Documents are dealt to blocks of bounded size; a block counts its own distinct grams and words,
the counts meet by key, and each block gets back the values of just its own keys. Nothing is broadcast but the
nodes of depth 0 and 1 (at most 65,536).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkernel as K
from ..scratch import Workspace

_U = np.uint64
DEPTH = 4
BLOCK_BYTES = 24 << 20
PIECE = 1 << 19
END = 10
HALF = math.log(0.5)
_SMALL = 4096
_LG_HALF = np.concatenate([[math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_LG_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))])


def _lgamma(n: np.ndarray, plus: float) -> np.ndarray:
    """ln gamma(n + plus) for counts n, plus 0.5 or 1."""
    table = _LG_HALF if plus == 0.5 else _LG_ONE
    x = np.maximum(n, _SMALL) + plus
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL).astype(np.int64)], far)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of n0 zeros and n1 ones, in any order."""
    return _lgamma(n0, 0.5) + _lgamma(n1, 0.5) - _lgamma(n0 + n1, 1.0) - 2 * math.lgamma(0.5)


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the model's byte sequence: lower-cased words parted by one space, then one end byte; each key holds the
    byte in its low 8 bits and the ``depth`` bytes before it above (end bytes before the start). Also each row's range."""
    m = np.diff(ranges)
    size = ends - starts + 1
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    length = np.where(m > 0, total[ranges[1:]] - total[ranges[:-1]], 1)
    at = np.concatenate([[0], np.cumsum(length)])
    base = at + depth * np.arange(len(at))  # each row is led by depth end bytes
    out = np.full(int(base[-1]), END, np.uint8)
    row = np.repeat(np.arange(len(m)), m)
    first = total[:-1] - total[ranges[:-1]][row] + base[:-1][row] + depth
    body = ends - starts
    inside = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
    out[np.repeat(first, body) + inside] = K.LOWER[data[np.repeat(starts, body) + inside]]
    gap = first + body
    last = np.zeros(len(size), bool)
    last[ranges[1:][m > 0] - 1] = True
    out[gap[~last]] = 32
    wide = out.astype(_U)
    key = wide[depth:].copy()
    for j in range(1, depth + 1):
        key |= wide[depth - j : -j] << _U(8 * j)
    keep = np.arange(int(at[-1])) + np.repeat(base[:-1] - at[:-1], length)
    return key[keep], at


class Lookup:
    """Open-addressing table from 64-bit keys to float64, filled and read in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.at, self.values = keys, np.full(1 << self.bits, -1, np.int32), values
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got = self.at[slot]
        bad = np.flatnonzero(self.keys[got] != keys)
        while len(bad):
            slot[bad] = (slot[bad] + 1) & ((1 << self.bits) - 1)
            got[bad] = self.at[slot[bad]]
            bad = bad[self.keys[got[bad]] != keys[bad]]
        return self.values[got]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _tally(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a piece, with how many are of training rows."""
    s = np.sort((key << _U(1)) | train.astype(_U)) if key.max(initial=0) < 1 << 62 else None
    if s is None:
        keys, inverse = np.unique(key, return_inverse=True)
        return keys, np.bincount(inverse, weights=train, minlength=len(keys)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    both, count = s[edge], np.diff(np.append(edge, len(s)))
    key = both >> _U(1)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return key[first], np.bincount(np.cumsum(first) - 1, weights=count * (both & _U(1)).astype(np.int64), minlength=int(first.sum())).astype(np.int64)


#: The end token as a word hash; words never hash to it but by collision.
END_WORD = _U(0x0E0D0E0D0E0D0E0D)


def _words(data, starts, ends) -> np.ndarray:
    return K.hashes(data, starts, ends) >> _U(2)  # 62 bits: one bit for the tally


def _features(depth: int, text: str):
    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list] = {0: [], 1: []}
        ends_in_training = 0
        for batch, data, offsets in K.rows(iter(table.to_batches()), text, PIECE):
            train = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
            starts, ends, ranges = K.spans(data, offsets)
            key, at = stream(data, starts, ends, ranges, depth)
            parts[0].append(_tally(key, np.repeat(train, np.diff(at))))
            parts[1].append(_tally(_words(data, starts, ends), np.repeat(train, np.diff(ranges))))
            ends_in_training += int(train.sum())
            for kind in parts:
                if len(parts[kind]) > 3:
                    parts[kind] = [_merge(parts[kind])]
        parts[1].append((np.array([END_WORD], _U), np.array([ends_in_training])))
        got = [(kind, *_merge(p)) for kind, p in parts.items()]
        block = table["block"][0].as_py()
        n = sum(len(k) for _, k, _ in got)
        return pa.table({
            "block": pa.array(np.full(n, block), pa.int64()),
            "kind": pa.array(np.concatenate([np.full(len(k), kind) for kind, k, _ in got]), pa.int32()),
            "key": pa.array(K.signed(np.concatenate([k for _, k, _ in got])), pa.int64()),
            "n": pa.array(np.concatenate([c for _, _, c in got]), pa.int64()),
        })

    return run


def _level(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, inner: np.ndarray | None, parent: np.ndarray):
    """One depth up: nodes, their counts, log weighted probability, and each lower row's node."""
    keys, inverse = np.unique(parent, return_inverse=True)
    c0 = np.bincount(inverse, weights=n0, minlength=len(keys))
    c1 = np.bincount(inverse, weights=n1, minlength=len(keys))
    kt = log_kt(c0, c1)
    if inner is None:
        return keys, c0, c1, kt, np.ones(len(keys)), inverse
    split = HALF + np.bincount(inverse, weights=inner, minlength=len(keys))
    lw = np.logaddexp(HALF + kt, split)
    return keys, c0, c1, lw, np.exp(HALF + kt - lw), inverse


def bit_rows(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight (node, bit) decisions of each byte; node 1 is the root."""
    j = np.arange(8)
    byte = byte.astype(np.int64)[:, None]
    return ((1 << j) | (byte >> (8 - j))).astype(_U), (byte >> (7 - j)) & 1


def _subtrees(depth: int):
    """Trees below depth 2 for a group of two-byte contexts: per gram its eight probabilities as seen from depth 2,
    per depth-2 node its counts and log weighted probability."""

    def run(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy().view(_U)
        n = table["n"].to_numpy().astype(np.float64)
        node, bit = bit_rows(key & _U(255))
        where = ((key >> _U(8))[:, None] << _U(8) | node).ravel()  # context and node, context above bit 8
        bit, w = bit.ravel(), np.repeat(n, 8)
        row_node, levels = where, []
        n0, n1, lw, parent = w * (bit == 0), w * (bit == 1), None, where
        place = None
        for d in range(depth, 1, -1):
            mask = _U((1 << (8 * d + 8)) - 1)
            parent = (row_node if lw is None else keys) & mask  # noqa: F821
            keys, n0, n1, lw, weight, inverse = _level(parent, n0, n1, lw, parent)
            place = inverse if place is None else inverse[place]
            levels.append((place, n0, n1, weight))
        p = None
        for place, c0, c1, weight in levels:
            kt = (np.where(bit == 1, c1[place], c0[place]) + 0.5) / (c0[place] + c1[place] + 1)
            p = kt if p is None else weight[place] * kt + (1 - weight[place]) * p
        vals = np.concatenate([p, np.stack([n0, n1, lw], axis=1).ravel()])
        at = np.concatenate([np.arange(len(key) + 1) * 8, 8 * len(key) + 3 * np.arange(1, len(keys) + 1)])
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [len(key), len(keys)]), pa.int32()),
            "key": pa.array(K.signed(np.concatenate([key, keys])), pa.int64()),
            "vals": K.lists(vals, at, pa.float64()),
        })

    return run


def _finish(top: dict):
    """log10 of the whole mix of each gram, from its probabilities below depth 2 and the nodes of depth 1 and 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(_U)
            p = batch.column(1).flatten().to_numpy().reshape(-1, 8)
            node, bit = bit_rows(key & _U(255))
            for d in (1, 0):
                at = (((key >> _U(8)) & _U((1 << (8 * d)) - 1))[:, None] << _U(8) | node).astype(np.int64)
                c0, c1, w = top[d]
                kt = (np.where(bit == 1, c1[at], c0[at]) + 0.5) / (c0[at] + c1[at] + 1)
                p = w[at] * kt + (1 - w[at]) * p
            yield pa.record_batch([batch.column(0), pa.array(np.log10(p).sum(axis=1), pa.float64())], ["key", "value"])

    return run


def _top(nodes: DataFrame) -> dict:
    """Dense arrays of the nodes of depth 1 and 0 (at most 65,536 and 256) from those of depth 2."""
    one = nodes.groupBy((F.col("key").bitwiseAND(0xFFFF)).alias("at")).agg(*(F.sum(F.col("vals")[i]).alias(x) for i, x in enumerate(("n0", "n1", "lw")))).toArrow()
    at = one["at"].to_numpy()
    n0, n1, inner = (one[x].to_numpy() for x in ("n0", "n1", "lw"))
    top = {}
    for d in (1, 0):
        keys, c0, c1, lw, weight, _ = _level(at, n0, n1, inner, at & ((1 << (8 * d + 8)) - 1))
        dense = [np.zeros(1 << (8 * d + 8)) for _ in range(3)]
        for to, x in zip(dense, (c0, c1, weight)):
            to[keys] = x
        top[d] = dense
        at, n0, n1, inner = keys, c0, c1, lw
    return top


def _score(depth: int, unseen: float, id_type: pa.DataType):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        key, value = values["key"].to_numpy().view(_U), values["value"].to_numpy()
        is_word = (key >> _U(63)).astype(bool)
        grams = Lookup(key[~is_word], value[~is_word])
        words = Lookup(key[is_word] & _U((1 << 63) - 1), value[is_word])
        del values, key, value, is_word
        out = []
        for batch, data, offsets in K.rows(iter(docs.to_batches()), "text", PIECE):
            starts, ends, ranges = K.spans(data, offsets)
            stream_key, at = stream(data, starts, ends, ranges, depth)
            bits = np.zeros(len(stream_key) + 1)
            np.cumsum(grams(stream_key), out=bits[1:])
            w = words(_words(data, starts, ends)) if len(starts) else np.zeros(0)
            total = np.zeros(len(w) + 1)
            np.cumsum(w, out=total[1:])
            end = words(np.array([END_WORD], _U))[0]
            known = K.per_row(w > unseen, ranges) + int(end > unseen)
            col = lambda x: batch.column(batch.schema.get_field_index(x))
            out.append(pa.record_batch(
                [col("doc_id"), col("held_out"), pa.array(np.diff(ranges) + 1), pa.array(known), pa.array(total[ranges[1:]] - total[ranges[:-1]] + end), pa.array(bits[at[1:]] - bits[at[:-1]]), pa.array(np.diff(at))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
            ))
        return pa.Table.from_batches(out)

    return run


def ctw_scores(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held_out: boolean column; the others are learned from. A word score (count + 0.5 over all, one end token a text)
    stands beside the tree's log10 probability of the lower-cased words, parted by single spaces, and the end. Null
    and empty texts are one end. With no training rows every binary decision has probability one half and N is 0.
    Repeated rows are learned from as often as they stand. 2 <= depth <= 6.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "ctw")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    kinds = "block long, kind int, key long, n long"
    features = work.table(d.groupBy("block").applyInArrow(_features(depth, "text"), kinds), "features")

    words = work.table(features.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    floor = n + 0.5 * (v + 1)
    unseen = math.log10(0.5 / floor)
    word_values = words.select(F.lit(1).alias("kind"), "key", F.when(F.col("n") > 0, F.log10((F.col("n") + 0.5) / floor)).otherwise(unseen).alias("value"))

    grams = features.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"))
    deal = F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)), F.lit(max(16, 4 * blocks)))
    trees = work.table(grams.withColumn("deal", deal).groupBy("deal").applyInArrow(lambda t: _subtrees(depth)(t), "kind int, key long, vals array<double>"), "trees")
    top = _top(trees.where("kind = 1"))
    gram_values = trees.where("kind = 0").select("key", "vals").mapInArrow(_finish(top), "key long, value double").select(F.lit(0).alias("kind"), "key", "value")

    values = features.select("block", "kind", "key").join(gram_values.unionByName(word_values), ["kind", "key"]).select("block", F.expr("if(kind = 1, key | shiftleft(1L, 63), key)").alias("key"), "value")
    id_type = to_arrow_type(d.schema["doc_id"].dataType)
    kind = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    out = d.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score(depth, unseen, id_type), kind)
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))


def op10_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ctw_scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
