"""Connected components of a distributed set of links, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import drop, stage

#: Rounds after which something must be wrong: each round leaves a fraction of the nodes.
MOST_ROUNDS = 100
#: Links, at most, that one task settles; more are contracted in rounds until so few are left.
FEW_LINKS = 500_000


def _settle(batches: Iterator) -> Iterator:
    """node and label (least of its component) of a few links (a, b)."""
    import numpy as np
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    ends = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in got], axis=1)
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """node and label, for each node of links (a, b; longs); equal labels mark one component.

    In each round every node hooks onto its least neighbour, or itself, in an order dealt anew by
    a hash (so that no numbering of the nodes makes long chains), links are renamed to the nodes
    hooked onto, and those within one node go. Rounds go on until FEW_LINKS are left, which a task settles; only
    their number reaches the driver. Nulls and links of a node with itself are no links.
    """
    tidy = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stage(tidy(links), "cc-links")
    few = lambda df: df.repartition(1).mapInArrow(_settle, "node long, label long")
    if left.count() <= FEW_LINKS:
        return few(left)
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    first = left
    for k in range(MOST_ROUNDS):
        if left.count() <= FEW_LINKS:
            last = stage(few(left).select(F.col("node").alias("label"), F.col("label").alias("to")), "cc-hook")
            labels = labels.join(last, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("o"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = F.array(F.struct(F.col("a").alias("x"), rank("b").alias("y")), F.struct(F.col("b").alias("x"), rank("a").alias("y")))
        hook = (
            left.select(F.explode(ends).alias("e")).groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("y"))
            .filter(F.col("y") < rank("x")).select("x", F.col("y.id").alias("to"))
        )
        hook = stage(hook, "cc-hook")
        renamed = left
        for end in ("a", "b"):
            renamed = renamed.join(hook.select(F.col("x").alias(end), F.col("to").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        after = stage(tidy(renamed), "cc-links")
        if left is not first:
            drop(left)
        left = after
        labels = stage(labels.join(hook.select(F.col("x").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
    else:
        raise RuntimeError("components did not settle")
    return labels
