"""SimHash near-duplicates: fingerprints of word shingles, linked through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes by
position. The index posts each distinct fingerprint under sets of three positional bytes so chosen
that any five shared positions hold at least one of the sets: with the positions in two halves of
four, one half has three of any five, so the triples of either half do. A posting list is
tallied in place: pairs that share fewer than 5 positional bytes go, the rest are verified by bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import carried, claim, drop, restored, stage
from cuebeam.llm.components import components

BYTES = 8
#: Byte positions of each posting: any five positions contain one of these triples.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: A posting list beyond this is posted again under two more of the shared positions.
LONG_LIST = 400
#: Lists up to this length are compared at all distances at once.
SHORT_LIST = 48


def shingle_hashes(text: str | None, shingle: int, seed: int = 42):
    """Hashes of a text's shingles in their order, repeats included; a text of fewer words has one, a text of none has none."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: 1 - shingle].tolist()
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes) -> int:
    """The bits, as a signed long, that over half the hashes have."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each whole text.

    Words are runs of anything but ASCII white space after lower-casing A-Z; shingles are runs of
    words joined by a space, repeats included, each hashed by XXH64. A text of fewer words has one
    shingle, all of it; one without words (null, empty, blank) has fingerprint zero.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("simhash")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([majority(shingle_hashes(t.as_py(), shingle, seed)) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def _byte(k: int):
    return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(0xFF))


def _posting(positions: tuple[int, ...], tag: int):
    key = F.lit(tag).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def spanning_links(key, fp, most_bits: int):
    """Links (two arrays) that connect, in each posting list, what all its verified pairs connect.

    key and fp are arrays. Pairs that share too few positional bytes fall out by count, the rest by
    their differing bits. A long list is walked from one member to the next with only the unreached
    members left to compare, so it gives fewer links than members.
    """
    import numpy as np

    least_shared = BYTES - most_bits
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(key)])

    def linked(x, y):
        d = np.bitwise_xor(x, y)
        shared = (d.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
        keep = np.flatnonzero(shared >= least_shared)
        return keep[np.bitwise_count(d[keep].view(np.uint64)) <= most_bits]

    a, b = [], []
    longest = min(SHORT_LIST, int(counts.max(initial=0)))
    short = np.repeat(counts <= SHORT_LIST, counts)
    for d in range(1, longest):
        at = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
        if not len(at):
            break
        x, y = fp[at], fp[at + d]
        hit = linked(x, y)
        a.append(x[hit])
        b.append(y[hit])
    for s, n in zip(starts[counts > SHORT_LIST], counts[counts > SHORT_LIST], strict=True):
        rest = np.ascontiguousarray(fp[s : s + n])
        todo: list = []
        while len(rest):
            if todo:
                x = todo.pop()
            else:
                x, rest = rest[0], rest[1:]
            hit = linked(np.full(len(rest), x), rest)
            if len(hit):
                found = rest[hit]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                rest = np.delete(rest, hit)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, most_bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all that differ in at most most_bits bits."""
    if not 0 <= most_bits <= 3:
        raise ValueError("the postings cover up to 3 differing bits")
    posts = distinct.select("fp", F.explode(F.array([F.struct(F.lit(k).alias("triple"), _posting(t, k).alias("key")) for k, t in enumerate(TRIPLES)])).alias("p")).select("fp", "p.*")
    lengths = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    long = lengths.filter(F.col("n") > LONG_LIST).select("key", F.lit(True).alias("long"))
    # a pair in a long list shares three positions there and two more at least: each two of the other five
    sets = [[t + pair for pair in combinations([p for p in range(BYTES) if p not in t], 2)] for t in TRIPLES]
    of_triple = "array(" + ", ".join("array(" + ", ".join(f"array({', '.join(map(str, x))})" for x in more) + ")" for more in sets) + ")"
    # as _posting() makes them, in a few nodes: written out, eighty postings weigh on the driver
    finer = F.expr(f"transform({of_triple}[triple], (x, j) -> aggregate(x, cast(16 + 10 * triple + j as bigint), (acc, p) -> shiftleft(acc, 8) | (shiftrightunsigned(fp, 8 * p) & 255)))")
    routed = posts.join(long, "key", "left").select("fp", F.explode(F.when(F.col("long"), finer).otherwise(F.array("key"))).alias("key"))

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            a, b = spanning_links(np.concatenate([g[1] for g in got]), np.concatenate([g[0] for g in got]), most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return routed.repartition("key").mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each document.

    Copies and other texts of one fingerprint are one node of the graph. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null id is
    never a component's id unless the component has no other; an empty table gives no rows. Columns
    of other names play no part.
    """
    signed = stage(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "simhash-fp")
    classes = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    labels = stage(components(links(classes.select("fp"), most_bits)), "simhash-labels")
    labelled = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = stage(labelled.join(least, "label").select("fp", "component_id"), "simhash-classes")
    return signed.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# similarity of shingle sets

#: 64-bit lanes of a set's parity bits that go with each posting, and of those that are fetched for postings with likely partners.
LANES, WIDE_LANES = 4, 16
#: Rounds in which each document tries its nearest partner of another component, before all pairs left apart are met.
NEAREST_ROUNDS = 2
#: Buckets in which shingles are counted. Counts only order the shingles: no result hangs on them.
BUCKETS = 1 << 20
#: Rows that a task hands on at once, and pairs that it looks at before.
FLUSH_ROWS, FLUSH_PAIRS = 400_000, 4_000_000
#: Members of a posting list that are compared with each other, or with as many others, in one task.
SLICE_ROWS = 600


def shingle_set(text: str | None, shingle: int):
    """Ascending distinct hashes of a text's shingles; see shingle_hashes."""
    import numpy as np

    return np.unique(shingle_hashes(text, shingle))


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """Of each row (id, text): same (hash of its set), size, SimHash fingerprint fp, parity bits l0.. and wide; and rows of chunk and counts (shingles by bucket) beside.

    A parity bit tells whether an even or odd number of the set's shingles have its low hash bits. A shingle that
    only one of two sets has flips one bit, so sets differ in at least as many shingles as parity bits. The few
    bits l0.. are the many of wide, folded.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        claim("simhash")
        counts = np.zeros(BUCKETS, np.int32)
        names = ["id", "same", "size", "fp", *[f"l{k}" for k in range(LANES)], "wide", "chunk", "counts"]
        for b in batches:
            out, wide = np.zeros((b.num_rows, LANES + 3), np.int64), [bytes(8 * WIDE_LANES)] * b.num_rows
            for k, t in enumerate(b.column(1)):
                every = shingle_hashes(t.as_py(), shingle)
                if not len(every):
                    continue
                got = np.unique(every)
                np.add.at(counts, _bucket(got), 1)
                out[k, 0] = np.array([h(got.tobytes(), 7)], np.uint64).view(np.int64)[0]
                out[k, 1], out[k, 2] = len(got), majority(every)
                odd = np.bincount((got % np.uint64(64 * WIDE_LANES)).astype(np.int64), minlength=64 * WIDE_LANES) % 2
                bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
                wide[k] = bits.tobytes()
                out[k, 3:] = np.bitwise_xor.reduce(bits.reshape(-1, LANES), axis=0)
            nulls = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out.T), pa.array(wide, pa.binary()), *nulls], names=names)
        parts = [(k, c.tobytes()) for k, c in enumerate(np.split(counts, 64)) if c.any()]
        nulls = [pa.nulls(len(parts), pa.int64())] * (LANES + 4)
        yield pa.RecordBatch.from_arrays([*nulls, pa.nulls(len(parts), pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

    lanes = ", ".join(f"l{k} long" for k in range(LANES))
    return rows.mapInArrow(run, f"id long, same long, size long, fp long, {lanes}, wide binary, chunk int, counts binary")


def _bucket(shingles):
    import numpy as np

    return (shingles >> np.uint64(32)).astype(np.int64) % BUCKETS


def _counts(signed: DataFrame):
    """The counts of all buckets, added up by chunk in tasks."""
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((64, BUCKETS // 64), np.int32)
    for r in signed.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(-1)


def prefixes(rows: DataFrame, counts, shingle: int, similarity: float) -> DataFrame:
    """key, id, place and size: of each row (id, text) the shingles of its prefix, rare ones first.

    Two sets of that similarity have at least similarity * size shingles of either in common. In one order of all
    shingles, the first they share is then in both prefixes of size - that + 1.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        claim("simhash")
        held: list = []

        def flush():
            cols = [np.concatenate([x[k] for x in held]) for k in range(4)]
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["key", "id", "place", "size"])

        n = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = shingle_set(t.as_py(), shingle)
                size = len(got)
                if not size:
                    continue
                prefix = size - ceil(similarity * size - 1e-9) + 1
                got = got[np.lexsort((got, counts[_bucket(got)]))][:prefix]
                held.append((got.view(np.int64), np.full(prefix, i, np.int64), np.arange(prefix, dtype=np.int32), np.full(prefix, size, np.int32)))
                n += prefix
                if n >= FLUSH_ROWS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "key long, id long, place int, size int")


def likely(similarity: float, lanes: list[str]):
    """Condition on two postings (x, y) of one key that a pair of that similarity meets where its prefixes first meet."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = x("size") + y("size")
    differ = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in lanes), F.lit(0))
    return (F.least(x("size") - x("place"), y("size") - y("place")) >= both * (similarity / (1 + similarity)) - 1e-6) & (differ <= both * ((1 - similarity) / (1 + similarity)) + 1e-6)


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets, of rows (id, text), have that Jaccard similarity."""

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("simhash")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["id", "shingles"])

    def verify(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    of = stage(rows.join(asked, "id", "left_semi").mapInArrow(sets, "id long, shingles binary"), "simhash-sets")
    both = pairs.join(of.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a").join(of.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b")
    links = stage(both.select("a", "b", "p", "q").mapInArrow(verify, "a long, b long"), "simhash-links")
    drop(of)
    return links


def mixed_lists(posts: DataFrame) -> DataFrame:
    """posts (key, label, ..) of the keys with differing labels, with n (postings of the key)."""
    mixed = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return posts.join(mixed.select("key", "n"), "key")


def cells(posts: DataFrame) -> DataFrame:
    """posts of mixed_lists() with own (slice) and a, b: each two postings of one key and differing labels meet where own is a or b.

    A list of more than SLICE_ROWS is cut into slices. Those of its most frequent label come first and never meet
    each other, so a large component with a few strays costs no more than its size.
    """
    of_label = posts.filter(F.col("n") > SLICE_ROWS).groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    most = of_label.groupBy("key").agg(F.max(F.struct("m", "label")).alias("most")).select("key", "most.m", F.col("most.label").alias("major"))
    most = most.select("key", "major", F.ceil(F.col("m") / SLICE_ROWS).cast("int").alias("major_slices"), "m")
    major = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
    before = F.coalesce("major_slices", F.lit(0))
    rest = F.ceil((F.col("n") - F.coalesce("m", F.lit(0))) / SLICE_ROWS).cast("int")
    deal = lambda count: F.pmod(F.xxhash64("id"), F.greatest(count, F.lit(1))).cast("int")
    rows = posts.join(most, "key", "left").withColumn("own", F.when(major, deal(before)).otherwise(before + deal(rest)))
    other = F.sequence(F.when(major, before).otherwise(0), before + rest - 1)
    rows = rows.withColumn("other", F.explode(other)).withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    return rows.drop("m", "n", "major", "major_slices", "other")


def partners(cells: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs that may be that similar, by places, sizes and parity bits (lanes, binary), of cells of mixed lists.

    nearest: for each posting with any, one row (key, id, partner, apart: bits that differ, for each shingle);
    else all pairs a, b.
    """
    share, limit = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    names = ["key", "id", "partner", "apart"] if nearest else ["a", "b"]

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, a, b, own, ids, place, size, label = (t[c].to_numpy().astype(np.int64) for c in ("key", "a", "b", "own", "id", "place", "size", "label"))
        order = np.lexsort((ids, b, a, key))
        wide = np.frombuffer(b"".join(t["lanes"].to_pylist()), np.uint64).reshape(len(ids), -1)[order]
        key, a, b, own, ids, left, size, label = (v[order] for v in (key, a, b, own, ids, size - place, size, label))
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        count = np.diff(np.r_[start, len(key)])
        cell = np.repeat(np.arange(len(start)), count)
        found: list = []

        def test(i, j):
            ok = (label[i] != label[j]) & ((own[i] != own[j]) | (a[i] == b[i])) & (np.minimum(left[i], left[j]) >= share * (size[i] + size[j]) - 1e-6)
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
            ok = apart <= limit * (size[i] + size[j]) + 1e-6
            found.append((i[ok], j[ok], apart[ok]))

        def batch():
            x, y, apart = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else [np.zeros(0, np.int64)] * 3
            found.clear()
            if not nearest:
                both = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=names)
            x, y, apart = np.r_[x, y], np.r_[y, x], np.r_[apart, apart]
            each = apart / (size[x] + size[y])
            # of equally near ones another for each: their order is dealt anew from one to the next
            best = np.lexsort(((ids[x] ^ ids[y]) * -7046029254386353131, each, x))
            best = best[np.r_[True, x[best][1:] != x[best][:-1]]] if len(best) else best
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (key[x[best]], ids[x[best]], ids[y[best]], each[best])], names=names)

        short = np.repeat(count <= SHORT_LIST, count)
        for lo, hi in _stretches(start, count):
            for d in range(1, min(SHORT_LIST, int(count[lo:hi].max()))):
                f, e = start[lo], start[hi - 1] + count[hi - 1]
                p = f + np.flatnonzero((cell[f + d : e] == cell[f : e - d]) & short[f + d : e])
                for q in np.array_split(p, len(p) // 200_000 + 1) if len(p) else []:
                    test(q, q + d)
            for s, n in zip(start[lo:hi][count[lo:hi] > SHORT_LIST].tolist(), count[lo:hi][count[lo:hi] > SHORT_LIST].tolist(), strict=True):
                for k in range(0, n, 256):
                    i, j = np.meshgrid(np.arange(s + k, s + min(k + 256, n)), np.arange(s + k, s + n), indexing="ij")
                    later = i < j
                    test(i[later], j[later])
            yield batch()

    return cells.repartition("key", "a", "b").mapInArrow(find, "key long, id long, partner long, apart double" if nearest else "a long, b long")


def _stretches(start, count):
    """Ranges of whole cells, of some pairs to look at each."""
    import numpy as np

    work = np.cumsum(count * np.minimum(count, 2 * SLICE_ROWS))
    cut = np.unique(np.r_[0, np.searchsorted(work, np.arange(1, work[-1] // FLUSH_PAIRS + 1) * FLUSH_PAIRS), len(start)])
    return [(int(lo), int(hi)) for lo, hi in zip(cut, cut[1:], strict=False) if lo < hi]


def left_apart(posts: DataFrame, lanes: list[str], wide: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """links and those that they leave out, or enough of these to connect what all true links of the postings connect.

    Postings without a likely partner of another component go first. Then, in a few rounds, each document tries
    the nearest partner it still has in another component; at last all pairs that are left apart are verified.
    """
    bits = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in lanes])

    def labelled(rows: DataFrame) -> DataFrame:
        known = stage(components(links).withColumnRenamed("node", "id"), "simhash-labels")
        return mixed_lists(rows.join(known, "id", "left").withColumn("label", F.coalesce("label", "id")))

    near = partners(cells(labelled(posts)).select("key", "a", "b", "own", "id", "place", "size", "label", bits.alias("lanes")), similarity, nearest=True)
    near = stage(near, "simhash-near")
    live = posts.select("key", "id", "place", "size").join(near.select("key", "id").distinct(), ["key", "id"])
    live = stage(live.join(wide.select("id", F.col("wide").alias("lanes")), "id"), "simhash-live")
    for k in range(NEAREST_ROUNDS):
        tried = near.groupBy("id").agg(F.min_by("partner", F.struct("apart", "partner")).alias("partner"))
        links = stage(links.unionByName(verified(tried.select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).distinct(), texts, shingle, similarity)), "simhash-links")
        drop(near)
        if k < NEAREST_ROUNDS - 1:
            # within one slice, dealt anew each time
            slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS)).cast("int")
            own = F.pmod(F.xxhash64("id", F.lit(k)), slices).cast("int")
            near = labelled(live).withColumn("own", own).select("*", F.col("own").alias("a"), F.col("own").alias("b")).drop("n")
            near = stage(partners(near, similarity, nearest=True), "simhash-near")
    rest = stage(partners(cells(labelled(live)), similarity, nearest=False).distinct(), "simhash-likely")
    return links.unionByName(verified(rest, texts, shingle, similarity))


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number of each row that stays as it is), doc_id, text and others (all other columns) of docs."""
    return stage(carried(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "simhash-rows")


def fingerprint_pairs(of: DataFrame, most_bits: int = 3) -> DataFrame:
    """Pairs (a, b) that connect all rows (id, fp) whose SimHash fingerprints differ in at most most_bits bits."""
    least = stage(of.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    same = of.join(least, "fp").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id")) for c in "ab")
    near = links(least.select("fp"), most_bits).join(x, "a").join(y, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return same.unionByName(near).distinct()


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """row, doc_id, first (row number) and component_id of each row, by links at Jaccard similarity >= similarity of shingle sets.

    docs has a row number, row, that stays as it is. The first row of all that are linked is that of the smallest doc_id, nulls
    last, and of these of the least row; its id is component_id. Texts with one set are one node. Texts without words
    are alike; a row with neither an id nor words has no row here.

    Pairs of near SimHash fingerprints are tried first. All other links are met, too: two such sets share a shingle of their prefixes, and each prefix is posted whole. Pairs are
    reduced only by true links: after those by fingerprint each posting is compared with a few of its list's, then with the nearest of
    another component, and at last, in lists of documents that these links leave apart, with all that sizes, places
    and parity bits allow. Every pair is verified on the texts' own sets.
    """
    lanes = [f"l{k}" for k in range(LANES)]
    whole = docs.select(F.col("row").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = whole.select("id", "text")
    raw = stage(signatures(texts, shingle), "simhash-sets")
    counts = _counts(raw)
    signed = raw.filter("chunk is null").join(whole.select("id", "doc_id"), "id").filter("doc_id is not null or same <> 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    signed = stage(signed.select("id", "doc_id", "same", "size", *lanes), "simhash-wide")
    classes = stage(signed.groupBy("same", "size", *lanes).agg(F.min(rank).alias("rank")).withColumn("id", F.col("rank.id")), "simhash-classes")

    nodes = texts.join(classes.filter("same <> 0").select("id"), "id", "left_semi")
    posted = stage(prefixes(nodes, counts, shingle, similarity), "simhash-posted")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    posts = stage(posted.join(shared, "key").join(classes.select("id", *lanes), "id").select("key", "id", "place", "size", *lanes), "simhash-posts")
    drop(posted)

    # four orders of the documents, so that a document's lists agree on few partners
    near = F.struct(F.xxhash64("id", F.pmod("key", F.lit(4))).alias("order"), "id", "place", "size", *lanes)
    pivots = posts.groupBy("key").agg(F.min(near).alias("p")).select("key", "p.*").drop("order")
    met = posts.alias("x").join(pivots.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & likely(similarity, lanes))
    first = stage(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "simhash-likely")
    of = raw.select("id", "fp").join(classes.filter("same <> 0").select("id"), "id", "left_semi")
    alike = stage(fingerprint_pairs(of), "simhash-alike")
    links = verified(alike.unionByName(first).distinct(), texts, shingle, similarity)
    found = components(left_apart(posts, lanes, raw.filter("chunk is null"), texts, links, shingle, similarity))

    labels = stage(found.select(F.col("node").alias("id"), "label"), "simhash-labels")
    ranked = classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = ranked.groupBy("label").agg(F.min("rank").alias("least"))
    of_class = stage(ranked.join(least, "label").select("same", "size", *lanes, F.col("least.id").alias("first"), F.col("least.doc_id").alias("component_id")), "simhash-classes")
    return signed.join(of_class, ["same", "size", *lanes]).select(F.col("id").alias("row"), "doc_id", "first", "component_id")


def first_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of linked rows the first, all columns as they are; rows with neither id nor words stay. See similar_rows."""
    rows = numbered(docs)
    gone = similar_rows(rows, shingle, similarity).filter("row <> first").select("row")
    return restored(rows.join(gone, "row", "left_anti"), docs.columns, "doc_id", "text")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (smallest id reachable; null where no row has one) of each row; see similar_rows."""
    return similar_rows(numbered(docs.select("doc_id", "text")), shingle, similarity).select("doc_id", "component_id")


__all__ = ["fingerprint_pairs", "fingerprints", "first_rows", "links", "near_duplicates", "numbered", "similar_groups", "similar_rows", "spanning_links"]
