"""Best-fit packing of tokenized documents into sequences of a fixed length.

Hierarchical residual packing: each partition packs its pieces best-fit, largest first. Bins
that can take no more (or nearly) leave the game at once; each underfull bin goes on as one item,
and ever fewer partitions pack these items best-fit again, up a tree with a fixed fan-in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import claim, drop, stage
from cuebeam.llm.tokens import runs_of_texts, tokenizer_path, word_ids

#: A bin with at most this many free places counts as full below the root of the tree.
NEARLY = 8
#: Partitions whose underfull bins meet in the next round.
FAN_IN = 16
#: Items that one partition packs, and the least share of its items that a round over more of them must save to go on.
MOST_ITEMS, LEAST_SAVED = 400_000, 0.002

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, length: int, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: its ids and end_id, cut only where longer than length.

    Null and empty texts have one piece, the end id alone.
    """

    def pieces(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        claim("word ids")
        encode, end = word_ids(tokenizer_file), end_id.to_bytes(4, "little")
        step = 4 * length
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            doc_ids = batch.column(0).to_pylist()
            for first, texts in runs_of_texts(batch.column(1)):
                for doc_id, ids in zip(doc_ids[first : first + len(texts)], encode.many(texts), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, crc32(part)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items from the largest on, each into the fullest bin that can take it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # bins by free places
    rooms: list[int] = []  # free places that some bin has, ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append(own := [])
            room = capacity
        else:
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        own.append(i)
        left = room - sizes[i]
        if not by_room[left]:
            rooms.insert(bisect_left(rooms, left), left)
        by_room[left].append(own)
    return bins


def _pack_round(items: DataFrame, capacity: int, nearly: int, tag: int) -> DataFrame:
    """Pack the items of each partition; an item is a bin of an earlier round or a piece.

    Returns one row for each item: item, size, the bin it went to, its offset there, the bin's
    size, and whether the bin is done.
    """

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        item, size = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        del got
        order = np.lexsort((item, -size))  # the same result in whatever order the rows come
        item, size = item[order], size[order]
        base = (tag << 54) | (TaskContext.get().partitionId() << 32)
        bins = best_fit(size.tolist(), capacity)
        count = np.fromiter(map(len, bins), np.int64, len(bins))
        flat = np.fromiter((i for b in bins for i in b), np.int64, len(item))
        which = np.repeat(np.arange(len(bins)), count)
        s = size[flat]
        ends = np.cumsum(s)
        total = np.add.reduceat(s, np.cumsum(count) - count)
        offset = ends - s - np.repeat(np.cumsum(total) - total, count)
        filled = total[which]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item[flat], s, base + which, offset, filled, filled >= capacity - nearly)], names=["item", "size", "bin", "offset", "filled", "done"])

    return items.select("item", "size").mapInArrow(pack, "item long, size long, bin long, offset long, filled long, done boolean")


def pack(docs: DataFrame, length: int = 2048, tokenizer_file: str | None = None, nearly: int = NEARLY, fan_in: int = FAN_IN) -> DataFrame:
    """Pack whole documents into as few sequences of at most `length` tokens as the tree finds.

    Only documents longer than a sequence are cut. Returns one row for each piece with its
    sequence and the gapless offset in it. Null text packs as empty; an empty table gives no rows;
    repeated rows are packed each; ties are broken by number. Columns besides doc_id and text
    play no part.

    Each round but the last leaves out all bins with at most `nearly` free places, and all that not even the
    least of the others would fit in. A partition gets MOST_ITEMS at most on average; where more than that is left, because hardly
    any two items fit together, the tree ends when a round over newly dealt items saves less than LEAST_SAVED of
    them. So no task's share grows with the input.
    """
    tokenizer_file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    pieces = stage(cut_pieces(docs, length, tokenizer_file).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    items, rounds, tag = pieces.select("item", F.col("length").alias("size")), [], 0
    width, before = max(1, items.rdd.getNumPartitions()), None
    while True:
        last = width == 1
        placed = stage(_pack_round(items, length, 0 if last else nearly, tag), "pack-round")
        rounds.append(placed)
        if last:
            break
        open_bins = placed.filter(~F.col("done")).groupBy(F.col("bin").alias("item")).agg(F.max("filled").alias("size"))
        least = open_bins.agg(F.min("size")).first()[0] or 0
        open_bins = open_bins.filter(F.col("size") <= length - least)
        left = open_bins.count()
        needed = -(-left // MOST_ITEMS)
        if left < 2 or (needed >= width and before is not None and left > before * (1 - LEAST_SAVED)):
            break
        width, before, tag = max(-(-width // fan_in), needed), left, tag + 1
        items = open_bins.repartition(width, F.pmod(F.xxhash64("item", F.lit(tag)), F.lit(1 << 20)))
    # from the root down: where each bin of a round lies in its final sequence
    at = rounds[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for placed in reversed(rounds[:-1]):
        above = at.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
        at = placed.join(above, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("offset"))
    return pieces.join(at, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its pieces in order and its length."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.transform(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))), lambda x: x).alias("pieces"),
    )


__all__ = ["best_fit", "cut_pieces", "drop", "pack", "sequences"]
