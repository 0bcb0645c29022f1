"""A Merkle manifest of a table: a digest of each row, a tree over each source, and a proof for each row.

Nodes are visited in aligned blocks of BLOCK: a postorder traversal of a block returns the digest of its subtree, and
while it unwinds it appends the siblings of each level to the leaves below. The roots of all blocks are the nodes of
another distributed traversal, until a source has one node left; the sources' roots are nodes of a last tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import drop, stage

#: Nodes of a run that become one, and levels that a block covers.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Columns that make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels above `nodes` nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def climb(nodes: list[str], levels: int, paths: list[list] | None = None) -> str:
    """The digest of the subtree over nodes, `levels` high.

    Where paths (a list for each node) is given, each node's list gets (before, after) of each level, from its own up:
    the digests of its run's others, joined, left and right of the one that holds the node.
    """

    def visit(lo: int, hi: int, level: int) -> str:
        if level == 0:
            return nodes[lo]
        step = FAN ** (level - 1)
        starts = range(lo, hi, step)
        children = [visit(a, min(a + step, hi), level - 1) for a in starts]
        if paths is not None:
            for k, a in enumerate(starts):
                siblings = "".join(children[:k]), "".join(children[k + 1 :])
                for own in paths[a : min(a + step, hi)]:
                    own.append(siblings)
        return digest(children)

    return visit(0, len(nodes), levels)


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = digest([before, leaf, after])
    return leaf


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The leaf of a row: each field as its count of UTF-8 bytes, a colon and itself, or as a dash where it is null."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf, ..) with tree (number of the source, in order) and node (place in its tree).

    Rows are sorted over all tasks by range, so that a source of any size is spread. What each task knows of
    its first and last source and how many it has is all that is put together in one place.
    """
    keys = ["source", "doc_id", "leaf", "tie"]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [c for c in rows.columns if c != "tie"]

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, run, at, last = TaskContext.get().partitionId(), -1, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            source = b.column(b.schema.get_field_index("source"))
            ids = pc.dictionary_encode(source, null_encoding="encode").indices.to_numpy() if b.num_rows else []
            new = np.r_[True, ids[1:] != ids[:-1]]
            goes_on = run >= 0 and source[0].as_py() == last
            runs = np.cumsum(new) - 1 + (run if goes_on else run + 1)
            starts = np.flatnonzero(new)
            node = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.r_[starts, b.num_rows]))
            if goes_on:
                node[: starts[1] if len(starts) > 1 else b.num_rows] += at
            run, at, last = int(runs[-1]), int(node[-1]) + 1, source[-1].as_py()
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(runs, pa.int64()), pa.array(node, pa.int64())], names=[*names, "part", "run", "node"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    numbered = stage(rows.mapInArrow(number, f"{schema}, part int, run long, node long"), "merkle-leaves")
    runs = numbered.groupBy("part", "run").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"))
    # of each task only the ends; the number of tasks bounds what is gathered
    ends = runs.groupBy("part").agg(
        F.max("run").alias("last"), F.min_by(F.struct("source"), "run")["source"].alias("low"), F.max_by(F.struct("source"), "run")["source"].alias("high"), F.max_by("n", "run").alias("n"),
    )
    before, tree, ahead = [], 0, 0  # of each task: the number of its first source, and how many of its rows come in tasks before
    was = None
    for e in sorted(ends.collect(), key=lambda e: e["part"]):
        same = was is not None and e["low"] == was[0]
        tree, ahead = (tree, ahead) if same else (tree + (was is not None), 0)
        before.append((e["part"], tree, ahead))
        ahead, tree = e["n"] + (ahead if e["last"] == 0 else 0), tree + e["last"]
        was = (e["high"],)
    # a row for each task of the sort, which bounds it
    offsets = F.broadcast(leaves.sparkSession.createDataFrame(before, "part int, base long, ahead long"))
    tree, node = F.col("base") + F.col("run"), F.col("node") + F.when(F.col("run") == 0, F.col("ahead")).otherwise(0)
    return numbered.join(offsets, "part").select(*names, tree.alias("tree"), node.alias("node"))


def _blocks(batches: Iterator) -> Iterator:
    """Rows of one block each, as tuples, of batches sorted by tree and node whose first two columns are tree and block."""
    held: list = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _levels(block: int, nodes: int) -> int:
    """Levels that a block covers: all, but for a tree of one block, which ends where one node is left."""
    return height(nodes) if block == 0 else LEVELS


def _block_of(node: str) -> Column:
    return F.expr(f"{node} div {BLOCK}")


def roots(nodes: DataFrame) -> DataFrame:
    """tree, node (number of the block) and digest of the root of each block of nodes (tree, node, digest)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["tree", "node", "digest"])

        for block in _blocks(batches):
            tree, number = block[0][:2]
            out.append((tree, number, climb([r[2] for r in block], _levels(number, len(block)))))
            if len(out) >= 4096:
                yield rows()
                out = []
        yield rows()

    dealt = nodes.withColumn("block", _block_of("node")).repartition("tree", "block").sortWithinPartitions("tree", "node")
    return dealt.select("tree", "block", "digest").mapInArrow(run, "tree long, node long, digest string")


def _under(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, block, digest, all else and path: nodes in order, before each block a row with the path from its root up (above: tree, block, path)."""
    rest = [f for f in nodes.schema.fields if f.name not in ("tree", "node", "digest")]
    kind = above.schema["path"].dataType
    rows = nodes.select("tree", _block_of("node").alias("block"), "node", "digest", *[f.name for f in rest], F.lit(None).cast(kind).alias("path"))
    heads = above.select("tree", "block", (F.col("block") * BLOCK).alias("node"), F.lit(None).cast("string").alias("digest"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest], "path")
    both = rows.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "node", F.asc_nulls_first("digest"))
    return both.select("tree", "block", "digest", *[f.name for f in rest], "path")


def _walked(batches: Iterator) -> Iterator:
    """Of each block of _under(): its rows, their own paths within it, and what its head carries."""
    for head, *block in _blocks(batches):
        paths: list[list] = [[] for _ in block]
        if block:
            climb([r[2] for r in block], _levels(head[1], len(block)), paths)
        yield block, paths, head[-1]


def paths_of(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, node and path, (before, after) of each level up to the root, of nodes (tree, node, digest); above has tree, block and the path from there."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for block, paths, up in _walked(batches):
            whole = [[*({"before": b, "after": a} for b, a in p), *up] for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array([r[3] for r in block], pa.int64()), pa.array(whole, kind)], names=["tree", "node", "path"])

    return _under(nodes.select("tree", "node", "digest", F.col("node").alias("place")), above).mapInArrow(run, f"tree long, node long, path {PATH}")


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each traversal, from nodes (tree, node, digest) up, and tree and digest of each tree's root."""
    traversals = [nodes]
    while True:
        nodes = stage(roots(nodes), "merkle-roots")
        if not nodes.agg(F.max("node")).first()[0]:
            return traversals, nodes.select("tree", "digest")
        traversals.append(nodes)


def _heads(traversals: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, block and path of the blocks of the first traversal; above has tree and the path from its root."""
    heads = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for nodes in reversed(traversals[1:]):
        heads = stage(paths_of(nodes, heads).withColumnRenamed("node", "block"), "merkle-paths")
    return heads


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path, given (the leaf to check) and folded_root of each row.

    The leaf digests `fields`. Leaves of a source ascend by doc_id (nulls first; rows of one id by their leaf), sources
    by their bytes, null first. path holds (before, after) of each level up to the root. Where tampered holds, given is
    the leaf of a row whose text's A-Z are lower-case; else it is the leaf. folded_root is what given and path lead to.

    Null, empty and very long texts are digested whole. Repeated rows are leaves each. An empty table has no rows. Columns
    not in fields play no part. Texts never leave the task that reads them: digests and ids are all that is shuffled.
    """
    spark = docs.sparkSession
    own = {c: F.col(c) for c in fields}
    odd = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lowered = own | {"text": F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())}
    given = F.when(odd, leaf_digest(lowered))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(own).alias("leaf"), given.alias("given"))
    leaves = stage(leaves, "merkle-digests")
    rows = stage(placed(leaves), "merkle-rows")
    drop(leaves)
    rows = rows.withColumnRenamed("leaf", "digest")
    lower, subroots = _climbed(rows.select("tree", "node", "digest"))
    # the sources' roots are the leaves of one tree, in the order of the sources' numbers
    upper, top = _climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), "digest"))
    found = top.first()
    root = found["digest"] if found else None
    ends = spark.createDataFrame([(0, [])], f"tree long, path {PATH}") if root else spark.createDataFrame([], f"tree long, path {PATH}")
    of_tree = paths_of(upper[0], _heads(upper, ends)).select(F.col("node").alias("tree"), "path")
    heads = _heads(lower, of_tree).join(subroots, "tree").select("tree", "block", F.struct("path", F.col("digest").alias("subroot")).alias("path"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), kind, pa.string(), pa.string())
        for block, paths, head in _walked(batches):
            up = [(s["before"], s["after"]) for s in head["path"]]
            for lo in range(0, len(block), 256):  # a row has some 5 KB of siblings
                out: list[list] = [[] for _ in types]
                for (_, _, leaf, doc_id, source, given, _), own in zip(block[lo : lo + 256], paths[lo : lo + 256], strict=True):
                    path = [*own, *up]
                    values = (doc_id, source, leaf, head["subroot"], root, [{"before": b, "after": a} for b, a in path], given or leaf, fold(given or leaf, path))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    names = ["doc_id", "source", "leaf", "subroot", "root", "path", "given", "folded_root"]
    return _under(rows.select("tree", "node", "digest", "doc_id", "source", "given"), heads).mapInArrow(run, f"doc_id long, source string, leaf string, subroot string, root string, path {PATH}, given string, folded_root string")


def proofs(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; those whose crc32 `every` divides are tampered with.

    A row without an id is not tampered with.
    """
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    rows = manifest(docs, tampered=odd)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


__all__ = ["climb", "digest", "fold", "height", "leaf_digest", "manifest", "paths_of", "placed", "proofs", "roots"]
