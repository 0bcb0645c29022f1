"""Exact top-k search and near-duplicate detection over embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import floor, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.llm.common import stage
from cuebeam.llm.components import components

#: Candidates and queries that meet in one task of the search. Each candidate is copied once for each block of queries
#: and each query once for each chunk of candidates, so for a given task the copies are fewest where both are equal.
CHUNK_ROWS, QUERY_ROWS = 8192, 8192
#: Vectors of a pivot list that are compared with each other, or with as many others, in one task.
SLICE_ROWS = 512


def usable(vector: Column) -> Column:
    """Whether a vector is there, is not empty and holds finite numbers only."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


# exact search


def whole_numbers(components, scale: int):
    """floor(scale * x) of each component: 64-bit numbers, or Python's where some are larger than doubles count exactly."""
    import numpy as np

    with np.errstate(over="ignore"):
        w = np.floor(components * scale)
    if not w.size or np.abs(w).max() < 1 << 53:
        return w.astype(np.int64)
    exact = lambda x: floor(x * scale) if isfinite(x * scale) else int(x) * scale
    return np.array([exact(x) for x in components.reshape(-1).tolist()], object).reshape(w.shape)


def accumulate(queries, candidates):
    """Scores (queries x candidates) term at a time: each non-zero query weight scatters its term's postings.

    In 64 bits where no score can go beyond, else in Python's numbers.
    """
    import numpy as np

    most = [max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0 for m in (queries, candidates)]
    kind = np.int64 if most[0] * most[1] * queries.shape[1] < 1 << 63 else object
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    postings = []
    for column in candidates.T:
        at = np.flatnonzero(column)
        postings.append((slice(None) if len(at) == len(column) else at, np.ascontiguousarray(column[at])))
    scores = np.zeros((len(queries), len(candidates)), kind)
    for q, row in zip(queries, scores, strict=True):
        for term in np.flatnonzero(q):
            at, weights = postings[term]
            row[at] += q[term] * weights
    return scores


def best(scores, rows, own, k: int):
    """Positions of the k highest scores but that of the row own; ties go to earlier positions."""
    import numpy as np

    allowed = np.flatnonzero(rows != own)
    s = scores[allowed]
    if s.dtype == object:
        return allowed[sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]]
    if len(s) > k:
        least = -np.partition(-s, k - 1)[k - 1]
        over, tied = np.flatnonzero(s > least), np.flatnonzero(s == least)
        pick = np.concatenate([over, tied[: k - len(over)]])
    else:
        pick = np.arange(len(s))
    return allowed[pick[np.lexsort((pick, -s[pick]))]]


def beyond(score: int) -> bytes | None:
    """None for what 64 bits hold, else bytes in the order of the numbers."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    size = abs(score).bit_length() // 8 + 1
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + key if score > 0 else b"\x01" + bytes(255 - x for x in key)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each query row, over all other rows.

    Components become floor(scale * x); the score is the integer inner product, exact at any size. The stated query rows
    meet all rows in blocks: rows are dealt to chunks and queries to blocks by a hash of
    the row's number, a task scores one block against one chunk and hands on k rows a query, and a final
    ranking merges them. Vectors that are null, empty or hold null or non-finite components take no part. Vectors meet those of
    their own length. Rows count each for itself: a query meets other rows of its own id, and rows repeated whole, and rows
    of one id that ask have a ranking each. Ties go to the smaller id, null ids last. A score that 64 bits don't hold is null, at
    its place in the ranking. Columns besides vec_id and embedding play no part.
    """
    clean = (
        vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).filter(usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("vec_id"), "is_query", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    )
    rows = stage(clean.withColumn("row", F.monotonically_increasing_id()), "top-rows")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("queries")).first()
    chunks, blocks = max(1, -(-n["rows"] // CHUNK_ROWS)), max(1, -(-n["queries"] // QUERY_ROWS))
    hashed = F.xxhash64("row")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select("row", "vec_id", "x", F.lit(False).alias("asks"), F.pmod(hashed, F.lit(chunks)).cast("int").alias("chunk"), numbers(blocks).alias("block"))
    asking = rows.filter("is_query").select("row", "vec_id", "x", F.lit(True).alias("asks"), numbers(chunks).alias("chunk"), F.pmod(F.shiftright(hashed, 20), F.lit(blocks)).cast("int").alias("block"))
    cells = candidates.unionByName(asking).withColumn("dims", F.size("x"))

    def search(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def part(asks: bool):
            t = table.filter(pc.equal(table["asks"], asks)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
            flat = t["x"].combine_chunks().flatten().to_numpy()
            return t["row"].to_numpy(), t["vec_id"], whole_numbers(flat.reshape(len(t), -1) if len(t) else np.zeros((0, 1)), scale)

        (rows, ids, found), (asked, own_ids, weights) = part(False), part(True)
        own_ids, out = own_ids.to_pylist(), [[] for _ in range(5)]
        if len(rows) and len(asked):
            for lo in range(0, len(asked), 64):
                scores = accumulate(weights[lo : lo + 64], found)
                for own, own_id, s in zip(asked[lo : lo + 64].tolist(), own_ids[lo : lo + 64], scores, strict=True):
                    at = best(s, rows, own, k)
                    top = s[at].tolist()
                    for c, v in zip(out, ([own] * len(at), [own_id] * len(at), ids.take(pa.array(at)).to_pylist(), [x if beyond(x) is None else None for x in top], [beyond(x) for x in top]), strict=True):
                        c += v
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["query", "query_id", "vec_id", "score", "beyond"])

    near = cells.groupBy("dims", "chunk", "block").applyInArrow(search, "query long, query_id long, vec_id long, score long, beyond binary")
    # above all that 64 bits hold, within them, below
    level = F.when(F.col("beyond").isNull(), 0).when(F.substring("beyond", 1, 1) == F.unhex(F.lit("02")), 1).otherwise(-1)
    order = [F.desc(level), F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# near-duplicates


def reference_points(dims: int, pivots: int, seed: int = 7):
    """Unit vectors in random directions, the same for every table; columns are pivots."""
    import numpy as np

    p = np.random.default_rng([seed, dims]).normal(size=(dims, pivots))
    return p / np.linalg.norm(p, axis=0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, pivots: int = 64, listed: int = 4, shared: int = 2) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector: links join equal labels at cosine >= threshold.

    Pivot-permutation index: a vector is described by its `listed` nearest of `pivots` reference
    points in order; it is posted under each `shared` of them, so two vectors meet where they have
    that many pivots in common, and in the least of their common lists the pair is counted, after its
    cosine in double precision is verified. With the defaults, pairs at cosine 0.98 exactly are
    met with probability above 0.99 in 64 dimensions, closer ones more often (see README).

    Equal vectors are one member of the index with their number. A long list is cut into slices, and
    each two slices meet in a task of their own. Tasks hand on counts and spanning links, never pairs.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing: n_links 0, their own component, kept. Vectors of different length don't link.
    Repeated rows are other vectors at cosine 1. Columns besides vec_id, embedding and label play
    no part.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fit = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    classes = rows.filter(fit).groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "pivot-classes")

    def describe(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = np.empty((b.num_rows, listed), np.int64)
            units = [np.asarray(v, float) for v in b.column(1).to_pylist()]
            units = [(v := u / np.abs(u).max()) / np.linalg.norm(v) for u in units]
            size = np.fromiter(map(len, units), np.int64, len(units))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                near = np.stack([units[i] for i in at]) @ reference_points(int(d), pivots)
                lists[at] = np.argsort(-near, axis=1, kind="stable")[:, :listed]
            arrays = [b.column(0), pa.array(list(lists), pa.list_(pa.int64())), pa.array(units, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "pivots", "unit"])

    described = classes.select("node", "v").mapInArrow(describe, "node long, pivots array<long>, unit array<double>")
    described = stage(described.join(classes.select("node", "label", "weight"), "node"), "pivot-lists")
    ordered = F.array_sort("pivots")
    keys = F.array(*[F.concat_ws(" ", F.size("unit"), *[F.element_at(ordered, i + 1) for i in c]) for c in combinations(range(listed), shared)])
    posted = described.select("node", F.explode(keys).alias("key"), "label")
    lengths = posted.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS)).cast("int")
    many = lengths.filter(F.col("n") > SLICE_ROWS).select("label", "key", slices.alias("slices"))
    lists = described.select("node", "weight", "unit", "pivots", "label", F.explode(keys).alias("key")).join(many, ["label", "key"], "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int")
    lists = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    cells = lists.select("node", "weight", "unit", "pivots", "key", "own", F.xxhash64("label", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "label", (F.col("own") == F.col("other")).alias("same"))

    def verify(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        f = pa.Table.from_batches(got).to_pandas()
        counts, a, b = [], [], []
        for (_, _, key, same), g in f.groupby(["cell", "label", "key", "same"], sort=False):
            if len(g) < 2:
                continue
            node, weight, side = g["node"].to_numpy(), g["weight"].to_numpy(), g["own"].to_numpy()
            unit, lists = np.stack(g["unit"].to_numpy()), np.stack(g["pivots"].to_numpy())
            x, y = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
            if not same:
                x, y = (z[side[x] != side[y]] for z in (x, y))
            common = np.where((lists[x][:, :, None] == lists[y][:, None, :]).any(2), lists[x], pivots)
            least = np.sort(common, axis=1)[:, :shared]
            here = (least == np.array(key.split()[1:], np.int64)).all(1)
            x, y = x[here], y[here]
            if not len(x):
                continue
            counts.append(pd.DataFrame({"node": np.r_[node[x], node[y]], "n": np.r_[weight[y], weight[x]]}).groupby("node")["n"].sum())
            root = np.arange(len(g))
            while True:  # each member takes the least of its own root and its partners'
                was = root.copy()
                np.minimum.at(root, x, was[y])
                np.minimum.at(root, y, was[x])
                root = root[root]
                if (root == was).all():
                    break
            at = np.flatnonzero(root != np.arange(len(g)))
            a.append(node[at])
            b.append(node[root[at]])
        if counts:
            n = pd.concat(counts)
            yield pa.RecordBatch.from_arrays([pa.array(n.index.to_numpy()), pa.nulls(len(n), pa.int64()), pa.array(n.to_numpy(), pa.int64())], names=["a", "b", "n"])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])

    found = stage(cells.repartition("cell").mapInArrow(verify, "a long, b long, n long"), "pivot-links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    labels = stage(components(found.filter("b is not null").select("a", "b")).withColumnRenamed("label", "component"), "pivot-components")
    nodes = classes.join(counts, "node", "left").join(labels, "node", "left")
    nodes = nodes.select("node", F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    placed = rows.join(nodes, fit & (rows["label"] == nodes["l"]) & (rows["v"] == nodes["w"]), "left").select("vec_id", "n_links", "root")
    placed = stage(placed, "pivot-rows")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce("least", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
