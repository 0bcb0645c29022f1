"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax on top.

A word's vector is the mean of learned vectors of hashed features: the word itself and its
character n-grams with its ends marked. Each two neighbouring words have a hashed vector of their own, and a word
that repeats the one before it adds one more. A document is the mean of its words' and pairs' vectors. All vectors
and the softmax are trained together by stochastic gradient descent in numpy. Since everything after training is
linear, a word and a pair each come down to one number; workers remember those of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebeam.llm.common import claim, holds
from cuebeam.llm.tokens import CACHE_ENTRIES

#: Bound of the training sample: labelled rows of each class.
SAMPLE_ROWS = 1200
#: Hashed features of words, and of pairs of words, as powers of two.
BITS, PAIR_BITS, DIMS, EPOCHS, RATE, SEED = 16, 17, 8, 6, 1.5, 11
GRAMS = (2, 3, 4)
_MIX = 0x9E3779B97F4A7C15
#: The feature of a word that repeats its predecessor, and the first of pairs, stand behind those of words.
AGAIN = 1 << BITS
PAIRS = AGAIN + 1
FEATURES = PAIRS + (1 << PAIR_BITS)


def word_features(words: list[str]):
    """Feature numbers of all words in one array, how many each word has, and each word's hash. Words are not empty."""
    import numpy as np

    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(flat))  # characters up to the word's end
    mixed = (flat + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    found, of = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ mixed[at + k]) * np.uint64(_MIX)
            h ^= h >> np.uint64(31)
        found.append(h)
        of.append(owner[at])
    place = np.arange(len(flat)) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max(initial=1)), _MIX | 1, np.uint64))
    whole = np.add.reduceat(mixed * power[place], start) if len(words) else np.zeros(0, np.uint64)
    whole *= np.uint64(_MIX)
    whole ^= whole >> np.uint64(29)
    found.append(whole * np.uint64(_MIX))
    of.append(np.arange(len(words)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(found)[order] >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(of, minlength=len(words)), whole


def pair_features(first, second):
    """Feature numbers of neighbouring words, by their hashes."""
    import numpy as np

    h = (first * np.uint64(0xC2B2AE3D27D4EB4F) ^ second) * np.uint64(_MIX)
    h ^= h >> np.uint64(31)
    return PAIRS + (h * np.uint64(_MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def document(text: str):
    """Features of a text, ascending, and what each weighs; none for a text without words."""
    from collections import Counter

    import numpy as np

    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    number = {w: k for k, w in enumerate(Counter(words))}
    features, n, whole = word_features(list(number))
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    share = np.repeat(np.bincount(at, minlength=len(number)) / n, n)
    pairs = pair_features(whole[at[:-1]], whole[at[1:]])
    again = int((at[1:] == at[:-1]).sum())
    all_of, weights = np.concatenate([features, pairs, [AGAIN] * (again > 0)]).astype(np.int64), np.concatenate([share, np.ones(len(pairs)), [again] * (again > 0)])
    found, of = np.unique(all_of, return_inverse=True)
    return found, (np.bincount(of, weights) / (len(words) + len(pairs) + again)).astype(np.float32)


@dataclass
class Model:
    """Score = sigmoid(bias + mean over words, pairs and repeats of their weights; a word's is the mean of its features')."""

    weights: object  # numpy array of FEATURES
    bias: float

    def of_words(self, words: list[str]):
        """Weight and hash of each word."""
        import numpy as np

        if not words:
            return np.zeros(0), np.zeros(0, np.uint64)
        features, count, whole = word_features(words)
        return np.add.reduceat(self.weights[features], np.cumsum(count) - count) / count, whole


def fit(docs: list, classes: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train on documents (features, weights) of class 0 or 1 by stochastic gradient descent, one document a step."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array([c for d, c in zip(docs, classes, strict=True) if len(d[0])], np.int64)
    docs = [d for d in docs if len(d[0])]
    vectors = (rng.random((FEATURES, DIMS), np.float32) - 0.5) / DIMS
    top, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, w = docs[i]
            pace = rate * (1 - steps / total)
            steps += 1
            own = vectors[at]
            hidden = w @ own
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = top @ p
            top -= pace * np.outer(hidden, p)
            bias -= pace * 0.1 * p
            # features of short documents weigh more; the size of a step doesn't follow the number of features
            vectors[at] = own - np.outer(w * np.float32(pace / np.sqrt((w * w).sum())), back.astype(np.float32))
    return Model((vectors.astype(float) @ (top[:, 1] - top[:, 0]).astype(float)).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled documents of each class, of any length, chosen by a hash of the id.

    usable says which labelled ids may be learned from. The sample is the only thing that is gathered, in one task, as
    hashed features, of which a document has no more than there are numbers for; the driver gets the weights alone. A class without
    rows leaves a model that gives everything the other class. Rows without a text or words are passed over; of rows of one id, all count.
    """
    import numpy as np

    pick = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if usable is not None:
        pick = pick.filter(usable)
    pick = pick.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    # twice the rows, since some may have no text
    classes = [pick.filter(F.col("quality") == c).orderBy(order, "doc_id").limit(2 * rows) for c in (0, 1)]
    chosen = classes[0].unionByName(classes[1])
    texts = docs.filter(F.col("text").cast("string").rlike("\\S")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("o", order)
    nth = F.row_number().over(Window.partitionBy("quality").orderBy("o", "doc_id", "text"))
    found = found.withColumn("nth", nth).filter(F.col("nth") <= rows)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [document(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype("<i4").tobytes() for x, _ in out], pa.binary()), pa.array([w.tobytes() for _, w in out], pa.binary())], names=["quality", "nth", "at", "w"])

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            rows.sort(key=lambda r: r[:2])
            model = fit([(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(w, np.float32)) for _, _, at, w in rows], [r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    sample = found.select("quality", "nth", "text").mapInArrow(features, "quality int, nth int, at binary, w binary")
    got = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else Model(np.zeros(FEATURES, np.float32), 0.0)


class Words:
    """What a worker remembers of words: a number for each, and by number weight and hash."""

    def __init__(self):
        import numpy as np

        self.number: dict[str, int] = {}
        self.weight, self.hash = np.zeros(1 << 16), np.zeros(1 << 16, np.uint64)

    def learn(self, words: list[str], model: Model) -> None:
        import numpy as np

        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        while len(self.weight) < n + len(words):
            self.weight, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.weight, self.hash))
        self.weight[n : n + len(words)], self.hash[n : n + len(words)] = model.of_words(words)


_remembered: dict[bytes, Words] = {}
holds("quality", _remembered.clear)


def logits(texts: list[str], model: Model, known: Words):
    """Of each text, bias and mean weight; texts without words have the bias alone."""
    import numpy as np

    split = [t.split() for t in texts]
    known.learn(list(set().union(*split).difference(known.number)), model)
    get = known.number.__getitem__
    out = np.full(len(texts), model.bias)
    for k, words in enumerate(split):
        if not words:
            continue
        at = np.fromiter(map(get, words), np.int64, len(words))
        total, n = known.weight[at].sum(), len(words)
        if n > 1:
            h = known.hash[at]
            again = np.count_nonzero(at[1:] == at[:-1])
            total += model.weights[pair_features(h[:-1], h[1:])].sum(dtype=float) + again * float(model.weights[AGAIN])
            n += n - 1 + again
        out[k] += total / n
    return out


def score(docs: DataFrame, model: Model, at_least: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 from at_least on) of each whole text, under these names.

    Texts without words (null, empty, blank) get the bias alone. Repeated rows give repeated rows;
    columns besides text play no part and pass through as they are, but for some of the two names,
    which are replaced.
    """
    import numpy as np

    weights, bias = np.asarray(model.weights, np.float32), model.bias

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import pyarrow as pa

        from cuebeam.llm.tokens import runs_of_texts

        claim("quality")
        own = Model(weights, bias)
        key = blake2b(weights.tobytes()).digest()
        if key not in _remembered:
            _remembered.clear()
        for b in batches:
            z = [np.zeros(0)]
            for _, texts in runs_of_texts(b.column(b.schema.get_field_index("text"))):
                known = _remembered.setdefault(key, Words())
                z.append(logits(texts, own, known))
                if len(known.number) > CACHE_ENTRIES:
                    _remembered.clear()
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= at_least).astype(np.int32))], schema=pa.schema([*b.schema, (names[0], pa.float64()), (names[1], pa.int32())]))

    rows = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
