"""Sharding, tokenizing, packing, classifying: against brute force, with odd rows."""

import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuebeam.llm import byte_bpe, packing, quality, sharding
from cuebeam.llm.tokens import Merger, tokenizer, tokenizer_path, word_ids
from tests.llm.conftest import DOCS, ODD

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 2**62, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_shard(make):
    rows = sharding.shard(make(ODD, extra=True), 4).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        data = (ODD[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), jump(r["doc_id"], 4), jump(r["doc_id"], 5))
        assert r["grown_shard"] in (r["shard"], 4)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shard_nulls_and_nothing(spark, make):
    assert sharding.shard(make([])).count() == 0
    rows = sharding.shard(spark.createDataFrame([(None, "a", None, None, 1)] * 3, DOCS), 2).collect()
    assert sorted(r["slot"] for r in rows) == [0, 1, 2]


def test_word_ids_are_the_librarys():
    lib = tokenizer(WORD)
    for t in [*map(lambda t: t or "", ODD), "Hello, World! it's 2024", "ﬁ ǅ Å"]:
        assert word_ids(WORD)(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_merger_on_all_lengths():
    words = ["".join("etaoinshrdlu"[(k * 7 + j * j) % 12] for j in range(k)) for k in range(1, 60)]
    for path in (WORD, BYTE):
        lib = tokenizer(path)
        assert Merger(path)(words) == [np.array(lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_pack(make):
    rows = packing.pack(make([*ODD, "word " * 9000], extra=True), 64, nearly=4, fan_in=2).collect()
    lib = tokenizer(WORD)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate([*ODD, "word " * 9000]):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [(a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for a in range(0, len(ids), 64)]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    least = -(-sum(r["length"] for r in rows) // 64)
    assert least <= len(by_seq) <= least + 2
    assert packing.pack(make([]), 64).count() == 0
    assert packing.sequences(packing.pack(make(["a b"] * 9), 64)).count() == 1


def test_packing_ends_where_nothing_fits(make, monkeypatch):
    monkeypatch.setattr(packing, "MOST_ITEMS", 20)
    tried = []
    plain = packing._pack_round
    monkeypatch.setattr(packing, "_pack_round", lambda items, *a: tried.append(items.count()) or plain(items, *a))
    rows = packing.pack(make(["word " * 40] * 200, parts=8), 64, fan_in=2).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) == 200 and tried == [200]
    tried.clear()
    rows = packing.pack(make(["word " * 40] * 200 + ["word " * 2], parts=8), 64, fan_in=2).collect()
    assert len({r["sequence_id"] for r in rows}) == 200 and len(rows) == 201 and len(tried) <= 4
    assert all(r["offset"] in (0, 41) for r in rows)


def test_best_fit_fills():
    bins = packing.best_fit([7, 5, 5, 3, 3, 2, 2, 2, 1], 10)
    assert sorted(i for b in bins for i in b) == list(range(9)) and len(bins) == 3


def test_round_trip(make):
    lib = tokenizer(BYTE)
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(make(ODD, extra=True)).collect()}
    for k, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = rows[k]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert byte_bpe.round_trip(make([])).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(make(ODD)))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in enumerate(ODD)}


@pytest.mark.parametrize("alphabet", ["etaoin", "é日😀", "!?'-", "0123"])
def test_tree_concatenation(alphabet):
    bpe, lib = byte_bpe.ByteBpe(BYTE, leaf=16), tokenizer(BYTE)
    rng = np.random.default_rng(3)
    for n in (15, 16, 17, 100, 1000, 3001):
        t = "".join(rng.choice(list(alphabet), n))
        assert bpe.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_quality(spark, make):
    rng = np.random.default_rng(1)
    words = ["harbor", "lantern", "quiet", "meadow", "river", "stone", "walked", "under"]
    good = [" ".join(rng.choice(words, 30)) + "." for _ in range(80)]
    bad = [" ".join(f"{w.upper()}!!" for w in rng.choice(words, 30)) for _ in range(40)] + [f"{w} " * 30 for w in rng.choice(words, 40)]
    texts = [*good, *bad, *ODD]
    labels = spark.createDataFrame([(k, int(k < 80), 0) for k in range(160)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.held_out(F.col("doc_id"))
    docs = make(texts, extra=True)
    model = quality.train(docs, labels, usable=~out)
    got = quality.score(docs, model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"]
    rows = got.withColumn("held", out).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 160]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert Counter((r["doc_id"] < 80) == bool(r["predicted"]) for r in held)[True] >= 0.95 * len(held) > 10
    blank = {r["score"] for r in rows if not (r["text"] or "").split()}
    assert len(blank) == 1
    assert quality.score(make([]), model).count() == 0
    assert quality.train(docs, labels.limit(0)).bias == 0.0


def mix(h, *, shift, by):
    return ((h ^ (h >> shift)) * by) % 2**64


def forward(text, model):
    """The score of one text, feature by feature in whole numbers."""
    mul, big = quality._MIX, 2**64
    weight = [float(x) for x in model.weights]

    def word(w):
        chars = [((ord(c) + 1) * 0xD6E8FEB86659FD93) % big for c in f"<{w}>"]
        chars = [c ^ (c >> 29) for c in chars]
        features = []
        for n in quality.GRAMS:
            for k in range(len(chars) - n + 1):
                h = n
                for c in chars[k : k + n]:
                    h = ((h ^ c) * mul) % big
                    h ^= h >> 31
                features.append(h >> (64 - quality.BITS))
        whole = sum(c * pow(mul | 1, k + 1, big) for k, c in enumerate(chars)) * mul % big
        whole ^= whole >> 29
        features.append((whole * mul % big) >> (64 - quality.BITS))
        return sum(weight[f] for f in features) / len(features), whole

    def pair(a, b):
        h = ((a * 0xC2B2AE3D27D4EB4F % big) ^ b) * mul % big
        h ^= h >> 31
        return weight[quality.PAIRS + ((h * mul % big) >> (64 - quality.PAIR_BITS))]

    words = (text or "").split()
    if not words:
        return 1 / (1 + np.exp(-model.bias))
    known = [word(w) for w in words]
    again = sum(a == b for a, b in zip(words, words[1:]))
    total = sum(k[0] for k in known) + sum(pair(a[1], b[1]) for a, b in zip(known, known[1:])) + again * weight[quality.AGAIN]
    return 1 / (1 + np.exp(-model.bias - total / (2 * len(words) - 1 + again)))


def test_scores_by_hand(make):
    rng = np.random.default_rng(8)
    model = quality.Model(rng.normal(size=quality.FEATURES).astype(np.float32) * 4, 0.3)
    docs = make(ODD, extra=True)
    got = {r["doc_id"]: r["__s"] for r in quality.score(docs, model, names=("__s", "__p")).collect()}
    assert [got[k] for k in range(len(ODD))] == pytest.approx([forward(t, model) for t in ODD], abs=1e-5)
    at, w = quality.document("one two two")
    assert w.sum() == pytest.approx(1) and quality.AGAIN in at and not len(quality.document(" ")[0])
