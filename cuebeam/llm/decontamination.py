"""Benchmark decontamination: documents are scanned for the word windows of test items, and what is found is removed.

A hash set of the items' windows goes to all tasks. Each task maps its documents' words to numbers of the items'
words, hashes every window of them, looks the hashes up, and compares each hit word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebeam.llm.common import carried, claim, drop, restored, stage
from cuebeam.llm.tokens import runs_of_texts

#: Words of a window; an item of fewer, but not none, is one window.
WINDOW = 10
#: Windows of a broadcast set, some 60 bytes each. More of them are dealt to several sets, and documents scanned once for each.
MOST_WINDOWS = 500_000
#: Words of an item that go into one row: longer items are cut, and neighbours overlap by a window less a word.
ITEM_WORDS = 100_000
#: Fixed value: a word, of text whose A-Z are lower-case: ASCII letters and digits and all beyond ASCII.
WORD = rb"[0-9a-z\x80-\xff]+"

SPANS = "array<struct<first:int,last:int>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, lower-case in A-Z only."""
    import re

    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return re.findall(WORD, data.lower())


@dataclass
class Windows:
    """A set of windows. Words have numbers from 1; windows lie by length, in the order of their hashes."""

    number: dict[bytes, int]
    names: list[str]  # of items
    grams: dict[int, object]  # a row of word numbers for each different window
    hashes: dict[int, object]
    items: dict[int, tuple]  # where each window's items begin, and numbers of items


def row_hash(rows):
    """A 64-bit hash of each row of numbers."""
    import numpy as np

    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        x = (column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = out * np.uint64(0xD6E8FEB86659FD93) + (x ^ (x >> np.uint64(29)))
    return out ^ (out >> np.uint64(32))


def window_set(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Windows:
    """The set of the windows of items (id, words)."""
    import numpy as np

    number: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    place = {name: k for k, name in enumerate(names)}
    found: dict[int, list] = {}
    for name, words in items:
        numbers = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32)
        if length := min(window, len(numbers)):
            rows = np.lib.stride_tricks.sliding_window_view(numbers, length)
            found.setdefault(length, []).append((rows, np.full(len(rows), place[name])))
    grams, hashes, of = {}, {}, {}
    for length, parts in sorted(found.items()):
        rows, at = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
        h = row_hash(rows)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        both = np.unique(np.stack([rank[at.reshape(-1)], np.concatenate([n for _, n in parts])]), axis=1)
        grams[length], hashes[length] = rows[order], h[order]
        of[length] = np.searchsorted(both[0], np.arange(len(order) + 1)), both[1].astype(np.int32)
    return Windows(number, names, grams, hashes, of)


def hits(numbers, known: Windows):
    """(length, places, windows' numbers) of all occurrences of windows in numbers of words (0: unknown)."""
    import numpy as np

    unknown = np.cumsum(np.r_[0, numbers == 0])
    out = []
    for length, table in known.hashes.items():
        if len(numbers) < length:
            continue
        at = np.flatnonzero(unknown[length:] == unknown[:-length])  # windows of known words only
        for lo in range(0, len(at), 200_000):
            here = at[lo : lo + 200_000]
            rows = numbers[here[:, None] + np.arange(length)]
            asked = row_hash(rows)
            k = np.searchsorted(table, asked)
            while len(here):  # over different windows of one hash, of which there is hardly ever a second
                same = k < len(table)
                same[same] = table[k[same]] == asked[same]
                here, rows, asked, k = here[same], rows[same], asked[same], k[same]
                equal = (rows == known.grams[length][k]).all(1)
                if equal.any():
                    out.append((length, here[equal], k[equal]))
                k = k + 1
    return out


def _taken(items: DataFrame, window: int) -> DataFrame:
    """name and words (joined by spaces) of each item that has any; long items in several overlapping rows. Ids are text; a null id is the empty one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                step = range(0, max(1, len(words) - window + 1), ITEM_WORDS)
                rows = [words[k : k + ITEM_WORDS + window - 1] for k in step] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([name or ""] * len(rows), pa.string()), pa.array([b" ".join(r) for r in rows], pa.binary()), pa.array([max(1, len(r) - window + 1) for r in rows], pa.int64())], names=["name", "words", "windows"])

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "name string, words binary, windows long")


def _scan(rows: DataFrame, known, only_hits: bool) -> DataFrame:
    """rows with n_words, spans of hit words (first to last, apart from each other) and items of each text (column text, which goes)."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        claim("decontamination")
        windows = known.value
        get = windows.number.get
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            counts, spans, items = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows, [[]] * b.num_rows
            for first, texts in runs_of_texts(b.column(b.schema.get_field_index("text"))):
                size, numbers = np.zeros(len(texts), np.int64), []
                for k, text in enumerate(texts):
                    words = words_of(text)
                    size[k] = len(words)
                    numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                    numbers.append(np.zeros(1, np.int32))  # windows don't cross documents
                counts[first : first + len(texts)] = size
                flat = np.concatenate(numbers)
                found = hits(flat, windows)
                if not found:
                    continue
                start = np.cumsum(size + 1) - size - 1
                covered = np.zeros(len(flat) + 1, np.int64)
                names: dict[int, set] = {}
                for length, at, k in found:
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + length, -1)
                    begin, of = windows.items[length]
                    pairs = np.unique(np.stack([np.searchsorted(start, at, "right") - 1, k]), axis=1)
                    for d, w in pairs.T.tolist():
                        names.setdefault(d, set()).update(of[begin[w] : begin[w + 1]].tolist())
                edge = np.diff(np.r_[0, (np.cumsum(covered[:-1]) > 0).astype(np.int8), 0])
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                doc = np.searchsorted(start, begin, "right") - 1
                for d, own in names.items():
                    mine = doc == d
                    spans[first + d] = [{"first": x, "last": y} for x, y in zip((begin[mine] - start[d]).tolist(), (end[mine] - start[d]).tolist(), strict=True)]
                    items[first + d] = [windows.names[k] for k in sorted(own)]
            columns = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[f.name for f in schema.fields])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """document (all columns of docs but text), n_words, spans (first and last word, from 0, of each run of hit words) and items (their ids as text, in order).

    A document's word is hit where any occurrence of a window of items (item_id, text) covers it: `window` words of an
    item in a row, or all words of an item of fewer. Texts and items are read whole; words are those of words_of().

    Null and empty texts have no words; items without words have no windows. Items without an id go by the empty one;
    rows of one item id are one item. Repeated documents give repeated rows, and so do rows without an id. Without items nothing is hit.

    The windows are counted first. Up to most_windows go to all tasks as one set and documents are read once; of more,
    sets of about that many are made one after the other, documents are scanned for each, and what is found is put together.
    """
    spark = docs.sparkSession
    rows = carried(docs, "text").withColumn("text", F.col("text").cast("string"))
    taken = stage(_taken(items, window), "decontamination-items")
    sets = max(1, -(-(taken.agg(F.sum("windows")).first()[0] or 0) // most_windows))

    def known(k: int):
        own = taken.filter(F.pmod(F.xxhash64("name", "words"), F.lit(sets)) == k) if sets > 1 else taken
        return spark.sparkContext.broadcast(window_set([(r["name"], bytes(r["words"]).split(b" ")) for r in own.collect()], window))

    if sets == 1:
        out = _scan(rows, known(0), only_hits=False)
    else:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
        texts, found = rows.select("row", "text"), []
        for k in range(sets):
            found.append(stage(_scan(texts, known(k), only_hits=True), "decontamination-hits"))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        joined = every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        words = _scan(rows, spark.sparkContext.broadcast(window_set([], window)), only_hits=False).drop("spans", "items")
        none = F.array().cast(SPANS), F.array().cast("array<string>")
        out = words.join(joined, "row", "left").select("others", "n_words", F.coalesce(merged_spans(F.col("spans")), none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    drop(taken)
    return out.select(F.col("others").alias("document"), "n_words", "spans", "items")


def merged_spans(spans):
    """Spans in order, those that meet or follow each other as one."""
    empty = F.array().cast(SPANS)

    def add(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["first"] <= last["last"] + 1, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.when(spans.isNotNull(), F.aggregate(F.array_sort(spans), empty, add))


def digests(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids in order, joined by commas) and contaminated of each document."""
    found = contamination(docs.select("doc_id", "text"), items, window, most_windows)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        F.col("document.doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without these runs of words, each from the begin of its first word to the end of its last."""
    import re

    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(WORD, data.lower())]
    out, end = [], 0
    for first, last in spans:
        out.append(data[end : at[first][0]])
        end = at[last][1]
    return b"".join([*out, data[end:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs without what the items' windows hit: the runs of hit words (remove="spans") or whole documents ("documents").

    Nulls, repeats and items as in contamination(). Texts without a hit, and all other columns, stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be spans or documents")
    rows = carried(docs, "text").withColumn("kept", F.col("text").cast("string"))
    found = contamination(rows, items, window, most_windows)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [t if not s else without_spans(t, [(x["first"], x["last"]) for x in s]) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], names=["text", "others"])

    if remove == "documents":
        return restored(found.filter(F.size("spans") == 0).select(F.col("document.kept").alias("text"), "document.others"), docs.columns, "text")
    shape = T.StructType([T.StructField("text", T.StringType()), rows.schema["others"]])
    return restored(found.select("document.kept", "spans", "document.others").mapInArrow(cut, shape), docs.columns, "text")


__all__ = ["contamination", "decontaminate", "digests", "hits", "merged_spans", "row_hash", "window_set", "without_spans", "words_of"]
