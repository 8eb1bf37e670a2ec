"""Token counts through a digest cache: content and tokenizer-version digests join stored counts; only distinct
misses are encoded, then appended to the cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import Workspace
from .skew import hot_keys, split_join

LIMIT = 512
#: Characters whose class (letter, number, space, other) has been the same in every Unicode version since 6.0:
#: for texts of these alone the rank file gives the library's own counts, several times as fast.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ȠΑ-Ρα-ωА-я‐-‧€]*")
#: The rank file's own pattern matching takes time by the square of a run of white space, so texts with one of this many
#: characters are left to the library; counts are the same either way.
LONG_RUN = 1 << 8
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)


def version(path: str, ranks: str | None) -> str:
    """Digest of the tokenizer's files: another vocabulary never reads this one's counts."""
    h = hashlib.sha256()
    for p in (path, ranks):
        if p:
            with open(p, "rb") as f:
                h.update(f.read())
    return h.hexdigest()[:32]


class Counter:
    """len(ids) as the tokenizer file's own library gives them, no begin, end or added special tokens."""

    def __init__(self, path: str, ranks: str | None = None):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow, self.fast = lambda t: len(model.encode(t)), None
            return
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.slow, self.fast = lambda t: len(own.encode(t, add_special_tokens=False).ids), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        if self.fast and "<|" not in text and PLAIN.fullmatch(text) and not (len(text) >= LONG_RUN and _LONG_RUN.search(text)):
            return len(self.fast(text))
        return self.slow(text)


def _encode(path: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, ranks)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([count(t or "") for t in batch.column(1).to_pylist()], pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, ranks: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with ``tok_bytes`` (UTF-8) and ``tok_tokens`` of every whole text.

    cache: folder of counts kept between calls, in a store that all executors share (None: for this call only).
    ranks: the same byte-level vocabulary as a rank file, used where it must give the library's counts.
    The normal form of a content is its UTF-8 text with null as the empty text; both have 0 tokens and bytes.
    Repeated texts are encoded once and keep their rows; a text that many rows hold is dealt to many tasks. Other columns pass through, also those of the names used here;
    an empty table gives none.
    """
    spark = docs.sparkSession
    where = f"{cache or Workspace(spark, 'tokencache').path}/{version(tokenizer, ranks)}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha1(text))
    kind = "digest binary, n_tokens long"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    misses = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if known:
        misses = misses.join(spark.read.schema(kind).parquet(where), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer, ranks), kind).write.mode("append").parquet(where)
    # two jobs may have appended the same miss
    counts = spark.read.schema(kind).parquet(where).groupBy("digest").agg(F.max("n_tokens").alias("tok_tokens"))
    copies = docs.select(digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    copies = Workspace(spark, "tokencopies").table(copies, "copies")
    # columns travel under names of their own, so that theirs cannot clash and those not asked for stay behind
    own = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(digest.alias("digest"), F.octet_length(text).cast("long").alias("_bytes"), *(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)))
    spread = [o for o, (c, kind) in zip(own, docs.dtypes) if c != text_col and "map<" not in kind and "variant" not in kind] or ["_bytes"]
    found = split_join(rows, counts, "digest", hot_keys(copies, "digest"), spread, "left")
    return found.select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own)), F.col("_bytes").alias("tok_bytes"), "tok_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"))
    return counted.select("doc_id", F.col("tok_bytes").alias("n_bytes"), F.col("tok_tokens").alias("n_tokens"), (F.col("tok_tokens") > LIMIT).alias("over_limit"))
