"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, surrogates for personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents. A document is an input row: repeated rows pass the quality rules together, and one row of each
near-duplicate group stays, that of the smallest id. Rows without an id are only dropped as exact copies of another
one, since nothing else names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbflow.llm.decontam import decontaminate
from kerbflow.llm.jaccard import jaccard_components
from kerbflow.llm.mixing import mix_sources
from kerbflow.llm.pii import pseudonymise, surrogate_key
from kerbflow.llm.quality import quality_rules
from kerbflow.scratch import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    import public_tokenizers as P

    return quality_rules(docs.select(*COLUMNS), P.path("byte_bpe_multi_50k.tiktoken")).where("q_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    found = jaccard_components(docs, k=5, num=4, den=5)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars is counted again."""
    return pseudonymise(docs.select(*COLUMNS), key=surrogate_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, each copy a row."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixture", mixture)]
#: Tokeniser verdicts, links and surrogates have no SQL; tests compare the operators with brute force and check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        work.settle()
    return STAGES[-1][1](spark, docs, sf_dir)
