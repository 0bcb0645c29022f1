"""Near-duplicates, search, repeated strings, language model, pipeline: against brute force, with odd rows."""

import random
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log10

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cuebeam.llm import components, pitman_yor, simhash, suffix_dedup, vectors
from tests.llm.conftest import DOCS, ODD


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("few", [500_000, 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = groups(400, links)
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert sorted(got) == nodes
    assert len({(want[n], got[n]) for n in nodes}) == len({want[n] for n in nodes}) == len({got[n] for n in nodes})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("long_list", [400, 3])
def test_simhash(make, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    monkeypatch.setattr(simhash, "SHORT_LIST", 4)
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)] for _ in range(3)]
    texts = [*ODD, *(" ".join(b) for b in base for _ in range(2))]
    for b in base:
        for _ in range(25):
            c = list(b)
            for _ in range(rng.randint(1, 4)):
                c[rng.randrange(len(c))] = "zz"
            texts.append(" ".join(c))
    f = [fingerprint(t) for t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(make(texts, extra=True)).collect()}
    assert [rows[k]["fingerprint"] for k in range(len(f))] == [f"{x:016x}" for x in f]
    assert [rows[k]["component_id"] for k in range(len(f))] == want
    assert simhash.near_duplicates(make([])).count() == 0


def test_simhash_links_any_three_bits(spark):
    rng = random.Random(1)
    x = [rng.getrandbits(64) for _ in range(30)]
    f = [*x, *(v ^ (1 << a) ^ (1 << b) ^ (1 << c) for v in x for a, b, c in [rng.sample(range(64), 3) for _ in range(3)])]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in f})
    got = {r["node"] for r in components.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    assert got == set(signed)


@pytest.mark.parametrize("slice_rows,short", [(600, 48), (5, 2)])
def test_similar_groups(make, monkeypatch, slice_rows, short):
    monkeypatch.setattr(simhash, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    rng = random.Random(9)
    texts = list(ODD)
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(300)]
        texts += [" ".join(base)] * 2
        for _ in range(12):
            c = list(base)
            for _ in range(rng.randint(1, 9)):
                c[rng.randrange(300)] = "zz"
            texts.append(" ".join(c))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    want = groups(len(texts), links)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(texts, extra=True)).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert simhash.similar_groups(make([])).count() == 0


def jaccard_groups(texts, least=0.8):
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    return groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))])


def families(rng, edits, sizes=(60, 250), n=5, members=60):
    """Texts of families whose members lie around similarity 0.8 of each other."""
    texts = []
    for _ in range(n):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(*sizes))]
        for _ in range(members):
            c = list(base)
            for _ in range(rng.randint(1, max(1, int(edits * len(c))))):
                c[rng.randrange(len(c))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("slice_rows,short", [(600, 48), (9, 3)])
def test_similar_groups_of_long_lists_are_whole(make, monkeypatch, slice_rows, short):
    monkeypatch.setattr(simhash, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    texts = [*ODD, *families(random.Random(12), 0.035)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == jaccard_groups(texts)


def test_similar_groups_of_two_are_all_found(make):
    rng = random.Random(21)
    texts = []
    for _ in range(250):
        n = rng.randint(60, 300)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(base)
        for k in range(0, max(1, (n - 4) // 9)):  # the last words differ: similarity is just over 0.8
            other[n - 1 - k] = f"z{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    want = jaccard_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(make(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want and sum(w != k for k, w in enumerate(want)) >= 240


VECTORS = "vec_id long, embedding array<float>, label int, score long, node long, key string"


def vector_rows(n=260, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    for k in range(0, n - 20, 9):
        v[k + 1] = v[k] + rng.normal(size=dims) * 0.05
        v[k + 2] = v[k] * 3
    v[50:70] = v[50]
    v = v.astype(np.float32)
    rows = [(k, [float(x) for x in r], k % 3 if k < 50 or k >= 70 else 1, 0, 0, "x") for k, r in enumerate(v)]
    for k in range(0, n - 20, 9):
        rows[k + 1] = (*rows[k + 1][:2], rows[k][2], 0, 0, "x")
        rows[k + 2] = (*rows[k + 2][:2], rows[k][2], 0, 0, "x")
    odd = [None, [], [0.0] * dims, [None, *[1.0] * (dims - 1)], [float("nan"), *[1.0] * (dims - 1)], [float("inf"), *[1.0] * (dims - 1)]]
    rows += [(1000 + 50 * k, e, 1, 0, 0, "x") for k, e in enumerate(odd)]
    return [*rows, (2000, rows[0][1], None, 0, 0, "x"), (2001, [1.0, 2.0], 1, 0, 0, "x"), (2002, [1.0, 2.0], 1, 0, 0, "x")]


def good(e):
    return bool(e) and all(x is not None and np.isfinite(x) for x in e)


@pytest.mark.parametrize("chunk,block", [(32768, 1024), (40, 2)])
def test_top_k(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(vectors, "QUERY_ROWS", block)
    rows = vector_rows()
    rows += [rows[0], rows[3], (100, rows[7][1], 1, 0, 0, "x"), (None, rows[50][1], 1, 0, 0, "x"), (None, rows[4][1], 1, 0, 0, "x")]
    assert_top(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert vectors.top_k(spark.createDataFrame(rows, VECTORS).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def assert_top(df):
    """Rankings against all pairs of rows: a row's number, not its id, tells it apart."""
    rows = [(i, [floor(256 * float(x)) if abs(x) < 1e300 else int(x) * 256 for x in e]) for i, e in df.select("vec_id", "embedding").collect() if good(e)]
    want = []
    for k, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for j, (i, w) in enumerate(rows) if j != k and len(w) == len(v))[:5]
            want += [(q, n + 1, None if none else i, -x if -(1 << 63) <= -x < 1 << 63 else None) for n, (x, none, i) in enumerate(s)]
    got = [tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_top_k_of_any_size(spark):
    """Scores that 64 bits don't hold rank where they belong and are null."""
    big = [1e30, 3e17, -2e30, 1e17, 0.5, 2.0**60, -1.0, 1e300, 9e307, -9e307]
    rng = random.Random(2)
    rows = [(k * 25, [rng.choice(big), rng.choice(big) if k % 2 else 1.0]) for k in range(30)]
    assert_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [vectors.beyond(x) for x in (0, 2**63 - 1, -(2**63))] == [None] * 3
    order = sorted([2**63, 2**64, 2**200, -(2**63) - 1, -(2**64), -(2**200), 2**63 + 1], key=vectors.beyond)
    assert order == sorted(order)


@pytest.mark.parametrize("slice_rows", [512, 5])
def test_embedding_near_duplicates(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(vectors, "SLICE_ROWS", slice_rows)
    rows = vector_rows()
    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12:
                    links.append((i, j))
    degree = Counter(k for link in links for k in link)
    root = groups(n, links)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    want = {r[0]: (degree[k], rows[root[k]][0], root[k] == k) for k, r in enumerate(rows)}
    missed = sum(v[0] for v in want.values()) - sum(v[0] for v in got.values())
    assert 0 <= missed <= 0.02 * len(links)  # an index may miss a few
    if not missed:
        assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def removed(docs, length=100):
    first = {}
    for d, t in sorted(docs):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    out = {}
    for d, t in docs:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (d, i):
                mask[i : i + length] = b"\1" * length
        left = bytes(x for x, m in zip(t, mask, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out[d] = (len(t), sum(mask), runs, sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("contexts,block", [(1500, 700_000), (2, 600)])
def test_suffix_dedup(make, monkeypatch, contexts, block):
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefg é", k=rng.randint(100, 350))) for _ in range(5)]
    texts = list(ODD)
    for _ in range(60):
        texts.append("".join(rng.choice(base)[rng.randint(0, 50) :] if rng.random() < 0.6 else "".join(rng.choices("xyz ", k=rng.randint(1, 150))) for _ in range(rng.randint(1, 4))))
    want = removed([(k, (t or "").encode()) for k, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(make(texts, extra=True)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5000
    assert suffix_dedup.digests(make([])).count() == 0


def test_suffix_dedup_repeated_rows(spark, make):
    t = "".join(chr(97 + k * k % 26) for k in range(300)) + "end of it"
    rows = suffix_dedup.digests(spark.createDataFrame([(1, t, None, None, 1)] * 2 + [(2, t, None, None, 1), (None, "x", None, None, 1)], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows)[1:3] == [(1, rows_of(t)), (1, rows_of(t))]
    kept = suffix_dedup.deduplicate(make([t, t + "é", None], extra=True)).orderBy("doc_id").collect()
    assert kept[2]["text"] is None and len(kept[1]["text"]) < 100 and kept[0].asDict().keys() >= {"score", "spans"}


def test_suffix_dedup_null_and_shared_ids(spark):
    rng = random.Random(3)
    t = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(5)]
    rows = [(None, t[0] + t[1]), (None, t[1]), (None, t[0] + t[1]), (None, t[2]), (7, t[3] + t[4]), (7, t[4]), (8, t[2])]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(0 <= r["n_removed"] <= r["n_bytes"] for r in got)
    assert sum(r["n_bytes"] - r["n_removed"] for r in got) == sum(map(len, t)) and {r["doc_id"]: r["n_removed"] for r in got}[8] == 400
    kept = "".join(r["text"] for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(kept) == sum(map(len, t))


def rows_of(t):
    return removed([(1, t.encode())])[1][1]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        c = rng.integers(1, 3, rng.integers(1, 200)).astype(np.uint8)
        b = c.tobytes()
        assert suffix_dedup.suffix_array(c).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_language_model(make):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    chain = lambda n: " ".join(words[k % 60] for k in np.cumsum(rng.choice([1, 1, 1, 7], n)))
    texts = [*ODD, *(chain(80) for _ in range(150)), "unknownword " * 3]
    docs = make(texts, extra=True)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = {r["doc_id"]: r for r in pitman_yor.score(docs, held).collect()}
    tokens = [(t or "").encode().lower().split() for t in texts]
    out = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    c = Counter(x for w, o in zip(tokens, out, strict=True) if not o for x in [*w, None])
    n, v = sum(c.values()), len(c)
    for k, w in enumerate(tokens):
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), abs=1e-6)
        assert r["score"] < 0
    test = [rows[k] for k in range(len(ODD), len(texts) - 1) if out[k]]
    assert sum(r["score"] for r in test) > 0.7 * sum(r["base_score"] for r in test)
    assert pitman_yor.score(make([]), held).count() == 0


def local_chain(b, groups, sweeps, seed=1):
    """Totals of each state of a corpus in one bucket, as the driver gathers them."""
    chain = []
    for _ in range(sweeps + 1):
        for t, c0, t0 in pitman_yor.states(b, chain, seed):
            pass
        c = b.by_word(b.count)
        sums = {"tokens": c.sum(), "kinds": (c > 0).sum(), "pair_once": (b.count == 1).sum(), "pair_twice": (b.count == 2).sum(), "word_once": (c0 == 1).sum(), "word_twice": (c0 == 2).sum(), "parent_customers": c0.sum(), "parent_tables": t0.sum()}
        chain.append(pitman_yor.Totals(sums, (np.arange(groups), np.bincount(b.context, b.count, groups), np.bincount(b.context, t, groups)), groups))
        chain[-1].discount, chain[-1].parent_discount = chain[0].discount, chain[0].parent_discount
    return chain


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    words, groups, tokens = rng.integers(1, 1 << 60, 40).astype(np.uint64), 8, 5000
    count = Counter(zip((rng.zipf(1.5, tokens) % 40).tolist(), rng.integers(0, groups, tokens).tolist(), strict=True))
    every = [(w, u) for w in range(40) for u in range(groups)]  # with pairs that never occur, and so count 0
    b = pitman_yor.Bucket.gather([(0, np.sort(words), np.full(40, groups), np.array([u for _, u in every]), np.array([count[x] for x in every]))], groups)
    b = pitman_yor.Bucket.of(b.row())
    chain = local_chain(b, groups, 5)
    p = pitman_yor.predictive(b, chain, 1, 3)
    known = b.by_word(b.count) > 0
    unknown = np.mean([t.opening() / (pitman_yor.STRENGTH + t.customers) * t.parent(0.0, 0.0) for t in chain[-3:]], axis=0)
    for u in range(groups):
        own = (b.context == u) & known[b.word]
        assert p[own].sum() + unknown[u] == pytest.approx(1, abs=1e-9) and (p[own] > 0).all()
    assert chain[-1].tables.sum() > chain[0].tables.sum()


def test_scores_against_one_bucket(make):
    """score() gives the sum of log10 of the same states' probabilities, worked out in one go."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 50) for _ in range(30)] + [None, "w1 never"]
    docs = make(texts)
    out = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, sweeps=0, samples=1).collect()}
    hashes, n = pitman_yor.word_hashes([(t or "").encode() for t in texts])
    words, tokens = np.unique(hashes, return_inverse=True)
    groups = pitman_yor.restaurants(0)
    word, context, count, of = pitman_yor.pairs(words, tokens, np.repeat(~np.array(out), n), groups)
    b = pitman_yor.Bucket.gather([(0, words, np.bincount(word), context, count)], groups)
    b = pitman_yor.Bucket.of(b.row())
    # several buckets draw from several generators: seating differs, and with it scores, a little
    want = np.add.reduceat(np.log10(pitman_yor.predictive(b, local_chain(b, groups, 1), 1, 1))[of], np.cumsum(n) - n)
    assert [got[k] for k in range(len(texts))] == pytest.approx(want.tolist(), rel=0.03)


def test_seating():
    rng = np.random.default_rng(1)
    count = np.array([0, 1, 2, 10, 1000, 100_000])
    t = pitman_yor.seat(count, np.full(6, 0.5), 0.5, rng)
    assert (t <= count).all() and (t[1:] >= 1).all() and t[0] == 0 and t[-1] > t[3]
    two = pitman_yor.seat(np.full(40_000, 2), np.full(40_000, 0.5), 0.5, rng)
    assert (two == 2).mean() == pytest.approx(0.5 / (0.5 + 0.5), abs=0.02)  # opening / (opening + 1 - discount)
    # runs have nearly the law of seating one at a time
    one_by_one = np.ones(4000, int)
    for s in range(1, 400):
        one_by_one += rng.random(4000) < 3.0 / (3.0 + s - 0.4 * one_by_one)
    many = pitman_yor.seat(np.full(4000, 400), np.full(4000, 3.0), 0.4, rng)
    assert many.mean() == pytest.approx(one_by_one.mean(), rel=0.02) and many.std() == pytest.approx(one_by_one.std(), rel=0.06)


def test_word_hashes():
    h, n = pitman_yor.word_hashes([b"a b  a", b"", b" b\n"])
    assert n.tolist() == [4, 1, 2] and h[0] == h[2] and h[1] == h[5] and h[3] == h[4] == h[6] and len(set(h.tolist())) == 3


def test_word_hashes_of_long_texts(monkeypatch):
    rng = random.Random(5)
    words = [b"w%d" % rng.randrange(300) for _ in range(3000)] + [b"x" * 700, b"y" * 2500]
    whole, n = pitman_yor.word_hashes([b" ".join(words), b"w1"])
    monkeypatch.setattr(pitman_yor, "LONGEST", 110_000)
    again, m = pitman_yor.word_hashes([b" ".join(words * 12), b"w1"])
    assert m.tolist() == [12 * len(words) + 1, 2] and again[: len(words)].tolist() == whole[: len(words)].tolist() and n.tolist() == [len(words) + 1, 2]
