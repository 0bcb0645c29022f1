"""What the operators of this subpackage share: written stages, worker caches and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebeam.staging import drop, shared_dir, stage

_holders: dict = {}


def holds(name: str, clear) -> None:
    """Register how to let go of what an operator keeps in a worker process from one task to the next."""
    _holders[name] = clear


def claim(name: str) -> None:
    """Called in a worker: the caches of all other operators go, since workers outlive a stage of a pipeline."""
    for other, clear in _holders.items():
        if other != name:
            clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """docs as the columns own and one struct, others, of all else: a user's column can't clash with an operator's own."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*others).alias("others") if others else F.lit(0).alias("others"))


def restored(rows: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns, in this order, of rows that carried() has made."""
    return rows.select(*[F.col(c) if c in own else F.col("others").getField(c).alias(c) for c in columns])


__all__ = ["carried", "claim", "documents", "drop", "embeddings", "holds", "restored", "shared_dir", "stage"]
