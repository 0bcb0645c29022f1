"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts earlier. Which strings can be
equal at all is settled first, and exactly: every string of that length (a window) has an anchor, the
32-byte gram of least hash in it, so equal windows have equal anchors at equal places. Windows of
one anchor that stand side by side form a context of at most 168 bytes. Anchors that occur once
hold no repeat; equal contexts under an anchor repeat as wholes, and all but the first go. Only anchors
with different contexts need their windows compared: the first of each such context goes, with its bytes,
to a shard, where a suffix array (Larsson-Sadakane refinement in numpy) with
Kasai's common prefixes finds the equal windows. An anchor with very many contexts is dealt over several
shards, and the sorted first windows of these are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebeam.llm.common import carried, claim, drop, holds, restored, stage

GRAM = 32
#: Bytes that are scanned at once; a longer text is scanned in overlapping parts.
BLOCK = 700_000
#: Bytes of text after which a task hands on the anchors it has.
FLUSH = 24_000_000
#: Contexts of one anchor in a shard; more are dealt over several shards.
SHARD_CONTEXTS = 1500
#: Characters of a suffix array.
SHARD_CHARS = 600_000

_B1, _B2, _M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 1 << 64


@lru_cache(maxsize=2)
def _tables(n: int):
    """Random byte values and the powers, and inverse powers, of the two rolling hashes."""
    import numpy as np

    rng = np.random.default_rng(5)
    grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    byte = rng.integers(1, _M >> 1, (2, 256), dtype=np.uint64)
    return byte, [grow(_B1), grow(_B2)], [grow(pow(_B1, -1, _M)), grow(pow(_B2, -1, _M))]


holds("suffix", _tables.cache_clear)


def contexts(texts: list[bytes], length: int):
    """Anchor hash, context hash, text number, first window, windows less one of each context."""
    import numpy as np

    flat = np.frombuffer(b"".join(texts), np.uint8)
    n = len(flat)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    byte, power, inverse = _tables(max(1 << 20, 1 << int(n).bit_length()))
    sums = [np.zeros(n + 1, np.uint64) for _ in range(2)]
    for k in range(2):
        np.cumsum(byte[k][flat] * power[k][:n], out=sums[k][1:])
    h = (sums[0][GRAM:] - sums[0][:-GRAM]) * inverse[0][: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_B2)
    h ^= h >> np.uint64(29)
    # the least hash in each window, leftmost of equals; the low bits hold the place
    least = (h & np.uint64(_M - (1 << 24))) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    pick = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    ok = size >= length
    inside[start[ok]] += 1
    np.subtract.at(inside, start[ok] + size[ok] - length + 1, 1)
    inside = np.cumsum(inside)[: len(pick)] > 0
    change = np.ones(len(pick) + 1, bool)
    change[1:-1] = (pick[1:] != pick[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(inside & change[:-1])
    last = np.flatnonzero(inside & change[1:])
    # a run of windows never spans two texts: between them lie windows that are not inside
    anchor = pick[first]
    context = (sums[1][last + length] - sums[1][first]) * inverse[1][first] + (anchor - first).astype(np.uint64) * np.uint64(_B1)
    context ^= context >> np.uint64(31)
    context *= np.uint64(_B1)
    text = np.searchsorted(start, first, "right") - 1
    return h[anchor], context, text, first - start[text], last - first


def merged(doc, a, b):
    """Runs (doc, start, end) of ranges that touch or overlap."""
    import numpy as np

    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    base = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
    shift = base * (int(b.max()) + 2)  # documents side by side, so that one running maximum serves all
    top = np.maximum.accumulate(b + shift)
    new = np.r_[True, (a + shift)[1:] > top[:-1]]
    at = np.flatnonzero(new)
    return doc[at], a[at], (top - shift)[np.r_[at[1:], len(doc)] - 1]


def suffix_array(codes):
    """All suffixes of codes (uint8) in order.

    Larsson-Sadakane: ranks by 8 characters, then each round sorts the groups that are still mixed
    by the rank of what follows them, which doubles the depth, until no group is left.
    """
    import numpy as np

    n = len(codes)
    depth = n + 8
    padded = np.r_[codes, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    slot = np.arange(n)
    fresh = np.r_[True, key[sa][1:] != key[sa][:-1]] if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, slot, 0))
    h = 8
    while h < depth:
        single = fresh & np.r_[fresh[1:], True]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        own = rank[sa[at]]
        both = own * (n + 2) + rank[np.minimum(sa[at] + h, n)] + 1
        order = np.argsort(both, kind="stable")
        sa[at] = sa[at][order]
        both = both[order]
        start = np.r_[True, both[1:] != both[:-1]]
        fresh[at] = start
        rank[sa[at]] = np.maximum.accumulate(np.where(start, at, 0))
        h *= 2
    return sa


def common_prefixes(codes, sa, start, windows, length: int):
    """Of each window start, by its place in sa: characters shared with the suffix before, up to length.

    Kasai: from one start to the next at most one character of what is shared goes. All contexts are
    walked side by side. Code 0 ends a context and equals nothing.
    """
    import numpy as np

    n = len(codes)
    codes = np.r_[codes, np.zeros(length + 1, np.uint8)]
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    order = np.argsort(-windows, kind="stable")
    start, windows = start[order], windows[order]
    shared = np.zeros(len(start), np.int64)
    for t in range(int(windows.max(initial=-1)) + 1):
        live = int(np.searchsorted(-windows, -t, "right"))
        i = start[:live] + t
        p = place[i]
        j = sa[np.maximum(p - 1, 0)]
        s = np.maximum(shared[:live] - 1, 0)
        s[p == 0] = 0
        go = np.flatnonzero(p > 0)
        while len(go):
            x = codes[i[go] + s[go]]
            go = go[(x == codes[j[go] + s[go]]) & (x != 0) & (s[go] < length)]
            s[go] += 1
        shared[:live] = s
        out[p] = s
    return out


def equal_windows(found: list[bytes], length: int):
    """(context, offset) of every window of the contexts and its group; equal windows share a group."""
    import numpy as np

    size = np.fromiter(map(len, found), np.int64, len(found))
    text = np.frombuffer(b"".join(found), np.uint8)
    start = np.cumsum(size + 1) - size - 1
    codes = np.zeros(len(text) + len(found), np.uint8)
    at = np.arange(len(text)) + np.repeat(np.arange(len(found)), size)
    # codes 1 to 255 in 8 bits; UTF-8 has no byte 255, so every byte may move up by one
    codes[at] = text + 1
    sa = suffix_array(codes)
    windows = size - length
    shared = common_prefixes(codes, sa, start, windows, length)
    group_of_place = np.cumsum(shared < length)
    place = np.empty(len(codes), np.int64)
    place[sa] = np.arange(len(codes))
    context = np.repeat(np.arange(len(found)), windows + 1)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(windows + 1) - windows - 1, windows + 1)
    return context, offset, group_of_place[place[start[context] + offset]]


def keyed(docs: DataFrame) -> DataFrame:
    """docs, written once, with __doc (the id; null ids as the least long) and __tie, which tells rows of one __doc apart.

    Rows of one id are told apart by their texts, so that a row repeated whole is one document; each row without an id
    is a document of its own.
    """
    tie = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(F.col("text").cast("string")))
    return stage(docs.withColumn("__tie", tie).withColumn("__doc", F.expr("coalesce(cast(doc_id as bigint), -9223372036854775808L)")), "suffix-rows")


def ranked(doc, tie):
    """Places of (doc, tie) in the order of all different ones, and these."""
    import numpy as np

    order = np.lexsort((tie, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, doc[order][new], tie[order][new]


def repeated_spans(rows: DataFrame, length: int = 100) -> DataFrame:
    """__doc, __tie and spans (array of start, end) of the bytes that go, of keyed rows.

    Spans of one document may overlap. Documents without spans have no row.
    """
    if not GRAM < length <= 128:
        raise ValueError(f"length must be over {GRAM} and at most 128")
    spark = rows.sparkSession
    # a few for each partition, of which there are more where there is more to read
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    buckets = 4 * parts

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        claim("suffix")
        held: list = []
        seen = 0

        def flush():
            anchor, context, doc, tie, first, more = (np.concatenate([h[k] for h in held]) for k in range(6))
            held.clear()
            doc, docs, ties = ranked(doc, tie)
            order = np.lexsort((first, doc, context, anchor))
            anchor, context, doc, first, more = (x[order] for x in (anchor, context, doc, first, more))
            same = np.zeros(len(anchor), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
            later = (doc != doc[head]) | (first != first[head])  # else a repeated row
            gone = merged(doc[same & later], first[same & later], (first + more + length)[same & later])
            keep = ~same
            anchor, context, doc, first, more = (x[keep] for x in (anchor, context, doc, first, more))
            bucket = ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # sorted, as anchors are
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            of_gone = np.linspace(0, len(gone[0]), buckets + 1).astype(np.int64)
            cols: list[list] = [[] for _ in range(11)]
            for k in range(buckets):
                a, b, c, d = edge[k], edge[k + 1], of_gone[k], of_gone[k + 1]
                if a < b or c < d:
                    row = (k, anchor[a:b], context[a:b], docs[doc[a:b]], ties[doc[a:b]], first[a:b].astype(np.int64), more[a:b].astype(np.uint8), docs[gone[0][c:d]], ties[gone[0][c:d]], gone[1][c:d], gone[2][c:d])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v if isinstance(v, int) else v.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=names)

        names = ["bucket", "anchor", "context", "doc", "tie", "first", "more", "gone", "gone_tie", "gone_from", "gone_to"]

        def take(texts, ids, ties, offsets):
            found = contexts(texts, length)
            held.append((found[0], found[1], np.array(ids, np.int64)[found[2]], np.array(ties, np.int64)[found[2]], found[3] + np.array(offsets, np.int64)[found[2]], found[4]))

        texts, ids, ties, offsets, size = [], [], [], [], 0
        for batch in batches:
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_py() or b""
                for at in range(0, max(1, len(data) - length + 1), BLOCK):
                    part = data[at : at + BLOCK + length - 1]
                    if len(part) < length:
                        continue
                    texts.append(part)
                    ids.append(doc)
                    ties.append(tie)
                    offsets.append(at)
                    size += len(part)
                    if size >= BLOCK:
                        take(texts, ids, ties, offsets)
                        seen += size
                        texts, ids, ties, offsets, size = [], [], [], [], 0
                        if seen >= FLUSH:
                            yield flush()
                            seen = 0
        if texts:
            take(texts, ids, ties, offsets)
        if held:
            yield flush()

    def settle(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got: list[list] = [[] for _ in range(10)]
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64)
        for batch in batches:
            for k in range(10):
                got[k] += [np.frombuffer(v.as_buffer(), kinds[k]) for v in batch.column(k + 1) if v.as_buffer().size]
        if not any(got):
            return
        anchor, context, doc, tie, first, more, gone_doc, gone_tie, *gone = (np.concatenate(g) if g else np.zeros(0, t) for g, t in zip(got, kinds, strict=True))
        del got
        n = len(doc)
        both, docs, ties = ranked(np.r_[doc, gone_doc], np.r_[tie, gone_tie])
        doc, gone = both[:n], [both[n:], *gone]
        del both, tie, gone_doc, gone_tie
        order = np.lexsort((first, doc, context, anchor))
        anchor, context, doc, first, more = (x[order] for x in (anchor, context, doc, first, more))
        more = more.astype(np.int64)
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= context[1:] != context[:-1]
        of = np.cumsum(new_anchor) - 1
        n = np.bincount(of, weights=new).astype(np.int64)[of] if len(of) else np.zeros(0, np.int64)
        head = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
        later = ~new & ((doc != doc[head]) | (first != first[head]))
        out = merged(*(np.concatenate(x) for x in zip(gone, (doc[later], first[later], (first + more + length)[later]), strict=True)))
        nulls = pa.nulls(len(out[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, (docs[out[0]], ties[out[0]], *out[1:])), nulls, nulls, nulls], names=names)
        ask = np.flatnonzero(new & (n > 1))
        shards = -(-n[ask] // SHARD_CONTEXTS)
        number = np.cumsum(new)[ask] - 1
        salt = number % shards
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[doc[ask]], ties[doc[ask]], first[ask], (first + more + length)[ask], anchor[ask].view(np.int64), salt, shards)], names=names)

    names = ["doc", "tie", "from", "to", "anchor", "salt", "shards"]
    texts = rows.select(F.col("__doc").alias("doc"), F.col("__tie").alias("tie"), F.col("text").cast("string").cast("binary").alias("text"))
    records = texts.mapInArrow(scan, "bucket int, anchor binary, context binary, doc binary, tie binary, first binary, more binary, gone binary, gone_tie binary, gone_from binary, gone_to binary")
    settled = stage(records.repartition(parts, "bucket").mapInArrow(settle, "doc long, tie long, `from` long, `to` long, anchor long, salt long, shards long"), "suffix-settled")

    asked = settled.filter("anchor is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("from", "to", "anchor", "salt", "shards")).alias("asked"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, tie, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_py() or b""
                for a in asks:
                    if a["to"] <= len(data):
                        for col, v in zip(cols, (a["anchor"], a["salt"], a["shards"], doc, tie, a["from"], data[a["from"] : a["to"]]), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=["anchor", "salt", "shards", "doc", "tie", "first", "bytes"])

    pieces = texts.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(cut, "anchor long, salt long, shards long, doc long, tie long, first long, bytes binary")

    def sort_shard(rows):
        """Ranges that go (doc, from, to) and, of anchors over several shards, the first windows (doc, from, window)."""
        import numpy as np

        context, offset, group = equal_windows(rows["bytes"], length)
        doc, at = rows["doc"][context], rows["first"][context] + offset
        order = np.lexsort((at, doc, group))
        g, d, p = group[order], doc[order], at[order]
        head = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
        later = (d != d[head]) | (p != p[head])
        gone = merged(d[later], p[later], p[later] + length)
        many = order[(head == np.arange(len(g))) & (rows["shards"][context[order]] > 1)]
        windows = [rows["bytes"][c][o : o + length] for c, o in zip(context[many].tolist(), offset[many].tolist(), strict=True)]
        return gone, (doc[many], at[many], rows["salt"][context[many]], windows)

    def shards(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("anchor", "ascending"), ("salt", "ascending"), ("doc", "ascending"), ("tie", "ascending"), ("first", "ascending")])
        whole = {k: t[k].to_numpy() for k in ("anchor", "salt", "shards", "doc", "tie", "first")} | {"bytes": t["bytes"].to_pylist()}
        del got, t
        whole["doc"], docs, ties = ranked(whole["doc"], whole.pop("tie"))
        size = np.fromiter(map(len, whole["bytes"]), np.int64, len(whole["bytes"]))
        new = np.r_[True, (whole["anchor"][1:] != whole["anchor"][:-1]) | (whole["salt"][1:] != whole["salt"][:-1])]
        edges, before = np.r_[np.flatnonzero(new), len(size)], np.r_[0, np.cumsum(size)]
        lo = 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(before[edges], before[edges[lo]] + SHARD_CHARS, "right")) - 1)
            a, b = edges[lo], edges[hi]
            gone, firsts = sort_shard({k: v[a:b] for k, v in whole.items()})
            k = len(gone[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (docs[gone[0]], ties[gone[0]], *gone[1:])), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=["doc", "tie", "from", "to", "shard", "window"])
            k = len(firsts[0])
            yield pa.RecordBatch.from_arrays([pa.array(docs[firsts[0]]), pa.array(ties[firsts[0]]), pa.array(firsts[1]), pa.array(firsts[1] + length), pa.array(firsts[2]), pa.array(firsts[3], pa.binary())], names=["doc", "tie", "from", "to", "shard", "window"])
            lo = hi

    compared = stage(pieces.repartition("anchor", "salt").mapInArrow(shards, "doc long, tie long, `from` long, `to` long, shard long, window binary"), "suffix-shards")

    def merge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        window = np.frombuffer(b"".join(t["window"].to_pylist()), f"S{length}")
        doc, tie, at, shard = (t[k].to_numpy() for k in ("doc", "tie", "from", "shard"))
        doc, docs, ties = ranked(doc, tie)
        runs = []
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            runs.append(own[np.argsort(window[own], kind="stable")])
        lost = []
        while len(runs) > 1:
            after = [runs[-1]] if len(runs) % 2 else []
            for left, right in zip(runs[::2], runs[1::2], strict=False):
                here = np.searchsorted(window[left], window[right])
                inside = np.minimum(here, len(left) - 1)
                met = window[left][inside] == window[right]
                x, y = left[inside[met]], right[met]
                wins = (doc[x] < doc[y]) | ((doc[x] == doc[y]) & (at[x] <= at[y]))
                lost.append(np.where(wins, y, x))
                left = left.copy()
                left[inside[met]] = np.where(wins, x, y)
                after.append(np.insert(left, here[~met], right[~met]))
            runs = after
        lost = np.concatenate(lost) if lost else np.zeros(0, np.int64)
        # a repeated row lies in one shard, so the loser of a meeting starts later
        of, *span = merged(doc[lost], at[lost], at[lost] + length)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[of], ties[of], *span)], names=["doc", "tie", "from", "to"])

    across = compared.filter("window is not null").select("doc", "tie", "from", "shard", "window").repartition("window").mapInArrow(merge, "doc long, tie long, `from` long, `to` long")
    span = lambda df: df.select("doc", "tie", "from", "to")
    spans = span(settled.filter("anchor is null")).unionByName(span(compared.filter("window is null"))).unionByName(across)
    return spans.groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def with_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """All columns of docs with spans (null where nothing goes)."""
    rows = keyed(docs)
    spans = repeated_spans(rows, length).withColumnRenamed("spans", "__spans")
    return rows.join(spans, ["__doc", "__tie"], "left").drop("__doc", "__tie")


def kept_bytes(data: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What is left of data, the number of bytes that go, and of maximal runs of them."""
    if not spans:
        return data, 0, 0
    left, removed, runs, end = [], 0, 0, -1
    for a, b in sorted((s["from"], min(s["to"], len(data))) for s in spans):
        if a > end:
            left.append(data[max(end, 0) : a])
            runs += 1
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    left.append(data[max(end, 0) :])
    return b"".join(left), removed, runs


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; all strings are judged on the input.

    Null texts are empty. Texts under `length` bytes stay whole. Rows repeated whole, with
    their id, get the same result and do not count as earlier than each other; other rows of one id come in an order by
    their texts' hash. Rows without an id are documents of their own, before all others. An empty table gives no rows. Columns besides doc_id and text play no part.
    """

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py() or b""
                left, removed, runs = kept_bytes(data, spans)
                for col, v in zip(cols, (len(data), removed, runs, sha256(left).hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), length)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with the text that is left, and all other columns as they are. Where a cut splits a character, its remaining bytes go too."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            k, s = batch.schema.get_field_index("text"), batch.schema.get_field_index("__spans")
            texts = [t.as_py() if not spans else kept_bytes(t.as_py().encode("utf-8"), spans)[0].decode("utf-8", "ignore") for t, spans in zip(batch.column(k), batch.column(s).to_pylist(), strict=True)]
            yield batch.set_column(k, "text", pa.array(texts, pa.string())).remove_column(s)

    rows = carried(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return restored(with_spans(rows, length).mapInArrow(run, T.StructType(rows.schema.fields)), docs.columns, "doc_id", "text")


__all__ = ["common_prefixes", "contexts", "deduplicate", "digests", "drop", "equal_windows", "kept_bytes", "merged", "repeated_spans", "suffix_array", "with_spans"]
