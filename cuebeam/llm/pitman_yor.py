"""Language-model scoring with a hierarchical Pitman-Yor process, and add-one counts as its base.

Each context, the word before hashed to one of a number of restaurants that grows with the input, seats its
followers as customers; all restaurants share one parent, whose customers are their tables, and the parent falls back
to a uniform dish. Seating is sampled by blocked Gibbs sweeps: a sweep seats all customers of one dish in one
restaurant anew, in turn, given the tables of all others and the parent's probabilities in the state before. A state
is the tables of all pairs, and of all words in the parent for just these tables as customers; so each state's
predictive probabilities sum to one. They are averaged over the states after the first sweeps. Since a sweep is a
function of its seed and of the totals of the state before, states are worked out anew where they are needed; only
totals are kept.

Documents are cut into blocks of tokens, by hash, once. A block sends each distinct (word, context) it has
to the word's bucket, where all restaurants' customers of a word come together, and gets back what its own
words and pairs weigh; so a frequent word costs a block no more than its contexts. What reaches the driver are
totals, and one row for each restaurant, of which there are about as many as the root of the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import claim, drop, holds, stage

#: Restaurants at least, and for each root of the number of bytes, of which vocabularies grow like the root.
LEAST_GROUPS, GROUPS_PER_ROOT = 1 << 16, 2
#: Bytes of text in a block, about.
BLOCK = 8_000_000
#: Bytes of text for each bucket at most, on average.
BUCKET = 6_000_000
#: Bytes of a text that is hashed in one go; a word beyond it is known by a digest.
LONGEST = 2_000_000
#: Strength parameters of the restaurants and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
#: Customers of a dish that are seated one at a time; later ones in runs that grow with what is seated.
SINGLY = 48

_BASE, _M = 0x9E3779B97F4A7C15, 1 << 64
_END = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _tables():
    import numpy as np

    n = 1 << 21
    byte = np.random.default_rng(17).integers(1, _M >> 1, 256, dtype=np.uint64)
    grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    return byte, grow(_BASE), grow(pow(_BASE, -1, _M)), space


holds("pitman-yor", _tables.cache_clear)


def word_hashes(texts: list[bytes]):
    """Hashes of all words of the texts, each text's followed by that of its end, and tokens per text."""
    import numpy as np

    byte, power, inverse, space = _tables()
    hashes, counts = [], []
    run, size = [], 0

    def take():
        flat = np.frombuffer(b"\n".join([*run, b""]), np.uint8)
        lengths = np.fromiter(map(len, run), np.int64, len(run)) + 1
        begin = np.cumsum(lengths) - lengths
        gap = np.r_[True, space[flat]]
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])  # every text is followed by a line end
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(byte[flat] * power[: len(flat)], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_END)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        owner = np.searchsorted(begin, start, "right") - 1
        out = np.full(len(h) + len(run), _END, np.uint64)
        out[np.arange(len(h)) + owner] = h
        hashes.append(out)
        counts.append(np.bincount(owner, minlength=len(run)) + 1)

    for t in texts:
        if size and size + len(t) > 1_000_000:
            take()
            run, size = [], 0
        if len(t) > LONGEST:  # longer than the tables: word by word groups
            parts, words = [], t.split()
            for k in range(0, len(words), 20_000):
                more, _ = word_hashes([b" ".join(words[k : k + 20_000])]) if sum(map(len, words[k : k + 20_000])) < LONGEST - 100_000 else _long(words[k : k + 20_000])
                parts.append(more[:-1])
            if run:
                take()
                run, size = [], 0
            hashes.append(np.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.uint64(_END)))
            counts.append(np.array([len(hashes[-1])]))
            continue
        run.append(t)
        size += len(t) + 1
    if run:
        take()
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else none


def _long(words: list[bytes]):
    """Words of which some are too long for the tables: these by a digest, the others as usual."""
    from hashlib import blake2b

    import numpy as np

    out = np.empty(len(words) + 1, np.uint64)
    out[-1] = _END
    for k, w in enumerate(words):
        out[k] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little") if len(w) > LONGEST else word_hashes([w])[0][0]
    return out, None


def restaurants(size: int) -> int:
    """Number of restaurants, a power of two, for so many bytes of text."""
    return max(LEAST_GROUPS, 1 << int(GROUPS_PER_ROOT * max(size, 1) ** 0.5).bit_length())


def pairs(words, tokens, trains, groups: int):
    """Distinct (word number, context) of a block, sorted: word, context, count in training, and each token's pair."""
    import numpy as np

    before = np.r_[np.uint64(_END), words[tokens[:-1]]]
    context = (before * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)).astype(np.int64) % groups
    key = tokens.astype(np.int64) * groups + context
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    count = np.add.reduceat(trains[order].astype(np.int64), at)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    return key[at] // groups, key[at] % groups, count, of


def seat(count, opening, discount: float, rng, more=None):
    """Tables of each dish after all its customers sat down in turn.

    The next customer opens a table with weight `opening` (and `more` for each table the dish has) and joins one with
    weight seated - discount * tables. The first SINGLY are seated one at a time; from there on, runs of a sixteenth of
    those seated share the weights at the run's start.
    """
    import numpy as np

    tables = np.minimum(count, 1).astype(np.int64)
    more = np.zeros(len(count)) if more is None else more
    live = np.flatnonzero(count > 1)
    seated = 1
    while len(live):
        step = 1 if seated < SINGLY else seated // 16
        t = tables[live]
        a = opening[live] + more[live] * t
        p = a / (a + seated - discount * t)
        tables[live] = t + ((rng.random(len(live)) < p) if step == 1 else rng.binomial(np.minimum(step, count[live] - seated), p))
        seated += step
        live = live[count[live] > seated]
    return tables


class Bucket:
    """All pairs of one bucket: words, first pair of each, contexts, training counts; and who asked for what."""

    FIELDS = "words", "first", "context", "count", "blocks", "n_words", "n_pairs", "word_of", "pair_of"
    TYPES = "u8", "i8", "u4", "i8", "i8", "i8", "i8", "i8", "i8"

    def __init__(self, **fields):
        self.__dict__ |= fields

    @classmethod
    def gather(cls, rows, groups: int):
        """rows: (block, words, pairs of each word, contexts, counts)."""
        import numpy as np

        word = np.concatenate([r[1] for r in rows])
        words, of = np.unique(word, return_inverse=True)
        n = [len(r[1]) for r in rows]
        edges = np.cumsum([0, *n])
        key = np.concatenate([np.repeat(of[a:b], r[2]) for a, b, r in zip(edges, edges[1:], rows, strict=False)]).astype(np.int64) * groups + np.concatenate([r[3] for r in rows])
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]]
        at = np.flatnonzero(new)
        pair_of = np.empty(len(k), np.int64)
        pair_of[order] = np.cumsum(new) - 1
        count = np.add.reduceat(np.concatenate([r[4] for r in rows]).astype(np.int64)[order], at)
        first = np.searchsorted(k[at] // groups, np.arange(len(words)))
        return cls(words=words, first=first, context=k[at] % groups, count=count, blocks=np.array([r[0] for r in rows]), n_words=np.array(n), n_pairs=np.array([len(r[3]) for r in rows]), word_of=of, pair_of=pair_of)

    def row(self) -> list[bytes]:
        import numpy as np

        return [np.ascontiguousarray(getattr(self, f)).astype(t).tobytes() for f, t in zip(self.FIELDS, self.TYPES, strict=True)]

    @classmethod
    def of(cls, values):
        import numpy as np

        b = cls(**{f: np.frombuffer(v, t).astype(np.int64 if f != "words" else np.uint64, copy=False) for f, t, v in zip(cls.FIELDS, cls.TYPES, values, strict=True)})
        b.word = np.repeat(np.arange(len(b.words)), np.diff(np.r_[b.first, len(b.context)]))
        return b

    def by_word(self, x):
        import numpy as np

        return np.add.reduceat(x, self.first) if len(self.first) else x


class Totals:
    """What a sweep needs of all others: sums over the corpus, and tables and customers of each context."""

    def __init__(self, spark_rows, found, groups: int = LEAST_GROUPS):
        import numpy as np

        s = spark_rows
        self.tokens, self.kinds = int(s["tokens"] or 0), int(s["kinds"] or 0)
        self.discount = _discount(s["pair_once"], s["pair_twice"])
        self.parent_discount = _discount(s["word_once"], s["word_twice"])
        self.parent_customers, self.parent_tables = float(s["parent_customers"] or 0), float(s["parent_tables"] or 0)
        self.customers, self.tables = np.zeros(groups), np.zeros(groups)
        self.customers[found[0]], self.tables[found[0]] = found[1], found[2]

    def opening(self):
        return STRENGTH + self.discount * self.tables

    def parent(self, customers, tables):
        """The parent's predictive probability of words with so many customers and tables."""
        whole = PARENT_STRENGTH + self.parent_customers
        return (customers - self.parent_discount * tables) / whole + (PARENT_STRENGTH + self.parent_discount * self.parent_tables) / whole / (self.kinds + 1)


def _discount(once, twice) -> float:
    """The discount that counts of ones and twos suggest, kept inside (0, 1)."""
    once, twice = float(once or 0), float(twice or 0)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def states(b: Bucket, chain: list, seed: int):
    """The states of a bucket, one after another: tables of each pair, customers and tables of each word in the parent.

    chain: the Totals of the states before; the first state, one table for each pair and word, needs none.
    """
    import numpy as np

    t = np.minimum(b.count, 1)
    c0 = b.by_word(t)
    t0 = np.minimum(c0, 1)
    yield t, c0, t0
    for k, totals in enumerate(chain):
        rng = np.random.default_rng([seed + k, int(b.words[0]) if len(b.words) else 0])
        p0 = totals.parent(c0, t0)
        others = STRENGTH + totals.discount * (totals.tables[b.context] - t)  # the tables of the dish itself are seated anew
        own = p0[b.word]
        t = seat(b.count, others * own, totals.discount, rng, totals.discount * own)
        c0 = b.by_word(t)
        # a word's share of the parent's base, with the tables of all other words
        flat = (PARENT_STRENGTH + totals.parent_discount * (totals.parent_tables - t0)) / (totals.kinds + 1)
        t0 = seat(c0, flat, totals.parent_discount, rng, np.full(len(c0), totals.parent_discount / (totals.kinds + 1)))
        yield t, c0, t0


_ROW = "bucket int, " + ", ".join(f"{f} binary" for f in Bucket.FIELDS)


def _total_rows(buckets: DataFrame, chain: list, seed: int, groups: int) -> Totals:
    """Totals of the state after those of chain: a row of sums and a row for each restaurant reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                b = Bucket.of([v.as_buffer() for v in row[1:]])
                if not len(b.count):
                    continue
                for state in states(b, chain, seed):
                    t, c0, t0 = state
                c = b.by_word(b.count)
                sums = [c.sum(), (c > 0).sum(), (b.count == 1).sum(), (b.count == 2).sum(), (c0 == 1).sum(), (c0 == 2).sum(), c0.sum(), t0.sum()]
                customers, tables = np.bincount(b.context, b.count, groups), np.bincount(b.context, t, groups)
                at = np.flatnonzero(customers)
                none = pa.nulls(len(at), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(customers[at]), pa.array(tables[at]), *[none] * 8], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 2, *[pa.array([float(s)]) for s in sums]], names=names)

    sums = ["tokens", "kinds", "pair_once", "pair_twice", "word_once", "word_twice", "parent_customers", "parent_tables"]
    names = ["context", "customers", "tables", *sums]
    rows = buckets.mapInArrow(run, "context long, customers double, tables double, " + ", ".join(f"{s} double" for s in sums))
    # sums of each context, and of everything under a null context
    found = rows.groupBy("context").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    table = found.to_pandas()
    whole = table[table["context"].isna()]
    each = table[table["context"].notna()]
    first = whole.iloc[0].to_dict() if len(whole) else dict.fromkeys(sums)
    return Totals(first, (each["context"].to_numpy().astype(int), each["customers"].to_numpy(), each["tables"].to_numpy()), groups)


def predictive(b: Bucket, chain: list, seed: int, samples: int):
    """Each pair's probability of the word after the context, averaged over the last states of chain."""
    out = 0.0
    for k, (t, c0, t0) in enumerate(states(b, chain[:-1], seed)):
        if k < len(chain) - samples:
            continue
        totals = chain[k]
        p0 = totals.parent(c0, t0)
        out = out + (b.count - totals.discount * t + totals.opening()[b.context] * p0[b.word]) / (STRENGTH + totals.customers[b.context])
    return out / samples


def score(docs: DataFrame, held_out: Column, sweeps: int = 2, samples: int = 2, seed: int = 23) -> DataFrame:
    """Score whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words are runs of anything but ASCII white space after lower-casing A-Z; each text ends with one end
    token, so null, empty and blank texts have that token alone. Rows where held_out is true (null: false) are
    scored but not learned from. base_score sums log10((c + 1) / (N + V + 1)); score is the log10 probability
    under the averaged predictive distribution, which sums to one over the V known words and one unknown.
    Repeated rows count each; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out.cast("boolean"), F.lit(False)).alias("held"), F.col("text").cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = restaurants(size), max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)

    of_context = "u2" if groups <= 1 << 16 else "u4"

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        claim("pitman-yor")
        ids, held, texts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

        def block():
            hashes, n = word_hashes(texts)
            words, tokens = np.unique(hashes, return_inverse=True)
            values = (np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array(held, bool), n.astype(np.int32), words, tokens.astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=["block", "ids", "no_id", "held", "n", "words", "tokens"])

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(i)
                held.append(h)
                texts.append((t.as_py() or b"").lower())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield block()
                    ids, held, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    blocks = stage(rows.mapInArrow(cut, "block long, ids binary, no_id binary, held binary, n binary, words binary, tokens binary"), "hpy-blocks")

    def open_block(held, n, words, tokens):
        import numpy as np

        held, n = np.frombuffer(held, bool), np.frombuffer(n, np.int32)
        words, tokens = np.frombuffer(words, np.uint64), np.frombuffer(tokens, np.uint32)
        return n, words, tokens, pairs(words, tokens, np.repeat(~held, n), groups)

    def edges(words):
        import numpy as np

        return np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                _, words, _, (word, context, count, _) = open_block(*[v.as_buffer() for v in row[1:]])
                per_word = np.bincount(word, minlength=len(words))
                edge = edges(words)
                pair_edge = np.r_[0, np.cumsum(per_word)][edge]
                cols: list[list] = [[] for _ in range(6)]
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    w, p = slice(edge[k], edge[k + 1]), slice(pair_edge[k], pair_edge[k + 1])
                    for col, v in zip(cols, (k, row[0].as_py(), words[w].tobytes(), per_word[w].astype(np.uint32).tobytes(), context[p].astype(of_context).tobytes(), count[p].astype(np.uint32).tobytes()), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["bucket", "block", "words", "per_word", "context", "count"])

    def gather(batches: Iterator) -> Iterator:
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        got: dict[int, list] = defaultdict(list)
        for batch in batches:
            for k, block, *v in zip(*batch.columns, strict=True):
                got[k.as_py()].append((block.as_py(), *[np.frombuffer(x.as_buffer(), t) for x, t in zip(v, ("u8", "u4", of_context, "u4"), strict=True)]))
        for k in sorted(got):
            own = Bucket.gather(sorted(got.pop(k), key=lambda r: r[0]), groups).row()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([v], pa.binary()) for v in own]], names=["bucket", *Bucket.FIELDS])

    asked = blocks.select("block", "held", "n", "words", "tokens").mapInArrow(ask, "bucket int, block long, words binary, per_word binary, context binary, count binary")
    counted = stage(asked.repartition(buckets, "bucket").mapInArrow(gather, _ROW), "hpy-buckets")
    chain = [_total_rows(counted, [], seed, groups)]
    for _ in range(sweeps + samples):
        chain.append(_total_rows(counted, chain, seed, groups))
        chain[-1].discount, chain[-1].parent_discount = chain[0].discount, chain[0].parent_discount
    totals = chain[0]
    of_count = "u4" if totals.tokens < 1 << 32 else "i8"

    def answer(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                number, b = row[0].as_py(), Bucket.of([v.as_buffer() for v in row[1:]])
                p, c = predictive(b, chain, seed, samples).astype(np.float32), b.by_word(b.count).astype(of_count)
                w, q = np.r_[0, np.cumsum(b.n_words)], np.r_[0, np.cumsum(b.n_pairs)]
                cols: list[list] = [[] for _ in range(2)]
                for k in range(len(b.blocks)):
                    for col, v in zip(cols, (c[b.word_of[w[k] : w[k + 1]]], p[b.pair_of[q[k] : q[k + 1]]]), strict=True):
                        col.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(b.blocks), pa.array([number] * len(b.blocks), pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["block", "bucket", "a", "b"])

    answers = counted.mapInArrow(answer, "block long, bucket int, a binary, b binary")
    none = [F.lit(None).cast("binary").alias(c) for c in "ab"]
    fields = ["ids", "no_id", "held", "n", "words", "tokens"]
    both = blocks.select("block", F.lit(-1).alias("bucket"), *none, *fields).unionByName(answers.select("*", *[F.lit(None).cast("binary").alias(f) for f in fields]))

    def add_up(batches: Iterator) -> Iterator:
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa

        own: dict[int, list] = {}
        got: dict[int, list] = defaultdict(list)
        for batch in batches:
            for block, bucket, *v in zip(*batch.columns, strict=True):
                if bucket.as_py() < 0:
                    own[block.as_py()] = [x.as_py() for x in v[2:]]
                else:
                    got[block.as_py()].append((bucket.as_py(), *[x.as_py() for x in v[:2]]))
        for block in sorted(own):
            ids, no_id, held, *rest = own.pop(block)
            n, _, tokens, (_, _, _, of) = open_block(held, *rest)
            replies = sorted(got.pop(block))
            c = np.concatenate([np.frombuffer(r[1], of_count) for r in replies]).astype(np.int64)
            p = np.log10(np.concatenate([np.frombuffer(r[2], np.float32) for r in replies]).astype(float))
            base = np.log10((c + 1) / (totals.tokens + totals.kinds + 1))
            at = np.cumsum(n.astype(np.int64)) - n
            total = [np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64)[tokens], base[tokens], p[of])]
            many = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(no_id, bool)), pa.array(np.frombuffer(held, bool)), pa.array(n.astype(np.int64)), pa.array(total[0]),
                    pa.array(np.full(many, totals.tokens)), pa.array(total[1]), pa.array(total[2]),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return both.repartition("block").mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


__all__ = ["drop", "pairs", "predictive", "restaurants", "score", "seat", "states", "word_hashes"]
