"""A training-corpus pipeline of four stages over documents; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebeam.llm import packing, quality, simhash, suffix_dedup
from cuebeam.llm.common import carried, restored, stage

Docs = DataFrame


def quality_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that the classifier accepts (score 0.7 or more); it learns from labels outside the held-out fold.

    Texts without words (null, empty, blank) all get the model's bias and share one fate. Repeated rows are scored alike
    and each is kept or not; rows without an id are scored like others. Columns of any name pass through unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, usable=~quality.held_out(F.col("doc_id")))
    scored = quality.score(carried(docs, "doc_id", "text"), model, at_least=0.7)
    return restored(scored.filter("predicted = 1"), docs.columns, "doc_id", "text")


def simhash_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """One row of each group linked at similarity 0.8 of five-word shingles: of the smallest id, nulls last; rows with neither id nor words stay.

    Pairs of SimHash fingerprints three bits apart are linked first, each checked on its sets; what they miss follows exactly (see the operator).
    """
    return simhash.first_rows(docs, shingle=5, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Every document, less the strings of 100 bytes or more that start earlier in the corpus too.

    Null texts stay null, and texts under 100 bytes stay whole. n_chars, if there, is counted anew; other columns
    stay as they are. Rows without an id, and rows that share one, are documents of their own (see the operator).
    """
    cut = suffix_dedup.deduplicate(docs, length=100)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def packing_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; null and empty texts have one of a single token."""
    return packing.pack(docs, length=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: The stages learn weights, hash and tokenize; SQL can't express them. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
