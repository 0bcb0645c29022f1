"""The Merkle manifest, decontamination and whitening: against brute force and their SQL, with odd rows."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from cuebeam.llm import decontamination, merkle, whitening
from cuebeam.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import DOCS, ODD
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op4_exact_top_k", "op10_embedding_near_dedup", "op11_merkle_manifest", "op12_decontamination"])
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), ORACLE[name])


# Merkle manifest


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            lo = at[i] // 16 * 16
            run = nodes[lo : lo + 16]
            path.append(("".join(run[: at[i] - lo]), "".join(run[at[i] - lo + 1 :])))
            at[i] //= 16
        nodes = [sha256("".join(nodes[a : a + 16]).encode()).hexdigest() for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest(rows):
    """Rows of the query, over rows (doc_id, text, lang, source, n_chars)."""
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha256("".join(map(one, (d, s, lang, n, t))).encode()).hexdigest()
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in by[s]]) for s in sources if by[s].sort(key=lambda x: x[:3]) is None}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for (_, _, own, r), path in zip(by[s], trees[s][1], strict=True):
            path = path + up
            at = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = leaf(r[0], None if r[1] is None else r[1].translate(LOW), *r[2:])
            for before, after in path:
                at = sha256((before + at + after).encode()).hexdigest()
            out.append((r[0], own, trees[s][0], root, sha256("".join(b + a for b, a in path).encode()).hexdigest(), at, at == root))
    return sorted(out, key=str)


def test_manifest(spark, make):
    """Sources of none, one and many blocks, null ids and sources, repeated rows, odd texts."""
    rows = [(k, f"Text {k}", "en", None if k % 7 == 0 else "hot" if k < 5000 else f"s{k % 40}", k) for k in range(9000)]
    rows += [(None, None, None, None, None)] * 3 + [(None, "Q", "x", "hot", 1)] * 2 + [(3, "Text 3", "en", "hot", 3)] * 2 + [(5, "Text 3", "en", "hot", 3), (20_000, "a", None, "", 1), (20_001, "a", None, "é", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(map(tuple, merkle.proofs(docs).collect()), key=str) == manifest(rows)
    odd = make(ODD, extra=True)
    got = merkle.proofs(odd)
    assert sorted(map(tuple, got.collect()), key=str) == manifest([tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert merkle.proofs(docs.limit(0)).count() == 0
    (alone,) = merkle.proofs(docs.filter("doc_id = 20001")).collect()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == sha256(b"").hexdigest()


@pytest.mark.parametrize("nodes", [1, 2, 16, 17, 255, 256, 257, 4096])
def test_climb(nodes):
    leaves = [sha256(str(k).encode()).hexdigest() for k in range(nodes)]
    root, expected = tree(leaves)
    paths = [[] for _ in leaves]
    assert merkle.climb(leaves, merkle.height(nodes), paths) == root and paths == expected
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))


# decontamination

BAGS = "alpha beta gamma Delta é x1 ÀB".split()


def contaminated(texts, items, window):
    known = {}
    for item, text in items:
        words = decontamination.words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            known.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in texts:
        words, hit, names = decontamination.words_of(text), set(), set()
        for size in {len(k) for k in known}:
            for k in range(len(words) - size + 1):
                if own := known.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= own
        out.append((doc, len(words), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bags(spark):
    rng = random.Random(5)
    items = [(k, "-".join(rng.choices(BAGS, k=rng.choice([0, 3, 4, 9, 10, 11, 30])))) for k in range(20)] + [(None, "q r s"), (3, "q q"), (4, None), (5, "")]
    texts = [(k, " ".join(rng.choices([*BAGS, "z"], k=rng.choice([0, 5, 40, 200])))) for k in range(40)] + [(None, None), (1, "q, R; s!! q q"), (None, "q r s"), (7, ""), (8, "z " * 30_000 + "Q r S"), (8, "z " * 30_000 + "Q r S")]
    docs = spark.createDataFrame([(*t, 9, 8, 7) for t in texts], "doc_id long, text string, n_words int, spans int, document int").repartition(3)
    return docs, texts, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize(("window", "most"), [(10, 500_000), (10, 7), (4, 60)])
def test_decontamination(spark, monkeypatch, window, most):
    """Also over several sets of windows, and items cut into rows."""
    if most == 7:
        monkeypatch.setattr(decontamination, "ITEM_WORDS", 6)
    docs, texts, known, items = bags(spark)
    expected = contaminated(texts, items, window)
    assert sorted(map(tuple, decontamination.digests(docs, known, window, most).collect()), key=str) == expected
    assert sum(x[5] for x in expected) > 10
    kept = decontamination.decontaminate(docs, known, "documents", window, most)
    assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in expected)
    cut = decontamination.decontaminate(docs, known, "spans", window, most)
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert all((r["n_words"], r["spans"], r["document"]) == (9, 8, 7) for r in rows)
    left = sorted((r["doc_id"], len(decontamination.words_of(r["text"]))) for r in rows if r["doc_id"] is not None)
    assert left == sorted((x[0], x[1] - x[2]) for x in expected if x[0] is not None)


def test_decontamination_of_nothing(spark):
    docs, texts, known, _ = bags(spark)
    assert decontamination.digests(docs.limit(0), known).count() == 0
    none = decontamination.digests(docs, known.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)


def test_spans_are_removed():
    assert decontamination.without_spans("Ab, c d. É f", [(1, 2)]) == "Ab, . É f"
    assert decontamination.without_spans("Ab, c d. É f", [(0, 0), (3, 4)]) == ", c d. "


def test_windows_of_one_hash(monkeypatch):
    """Windows are compared word for word, whatever their hashes."""
    monkeypatch.setattr(decontamination, "row_hash", lambda rows: np.zeros(len(rows), np.uint64))
    known = decontamination.window_set([("a", [b"x", b"y", b"z"]), ("b", [b"y", b"x", b"z"]), ("c", [b"x", b"y", b"z"])])
    numbers = np.array([known.number.get(w, 0) for w in (b"x", b"y", b"z", b"q", b"y", b"x", b"z")])
    found = [(length, int(p), [known.names[i] for i in known.items[length][1][known.items[length][0][w] : known.items[length][0][w + 1]]]) for length, at, k in decontamination.hits(numbers, known) for p, w in zip(at, k, strict=True)]
    assert sorted(found) == [(3, 0, ["a", "c"]), (3, 4, ["b"])]


# whitening


def whitened(rows, components=16):
    out = {}
    fit = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2**46 for c in v)]
    for d in {len(x) for _, x in fit}:
        own = [(i, x) for i, x in fit if len(x) == d]
        different = sorted({tuple(x) for _, x in own})
        n, sums = len(different), [sum(x[k] for x in different) for k in range(d)]
        centred = lambda x: np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, sums, strict=True)])  # noqa: B023, E731
        c = np.stack([centred(x) for x in different])
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in own:
            for k in range(min(components, int((e > e[0] * 1e-12).sum())) if e[0] > 0 else 0):
                row = (n, sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True)), abs(centred(x) @ u[:, k] / np.sqrt(e[k])), e[k] / np.trace(v))
                out.setdefault((i, k + 1), []).append(row)
    return out


def check_whitened(df, components=16):
    expected, got = whitened([(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()], components), {}
    for r in whitening.whiten(df, components).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert set(got) == set(expected)
    for k, rows in expected.items():
        for a, b in zip(sorted(got[k]), sorted(rows), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-7)


def test_whitening(spark):
    check_whitened(spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_whitening_of_odd_rows(spark):
    """Lengths apart, directions without variance, repeats, nulls, what is not finite or too large, clashing columns."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1), rng.gauss(0, 0.1), 1.0]) for k in range(40)] + [(k, [rng.gauss(0, 1)] * 2 + [rng.random()] * 3) for k in range(30)]
    rows += [(None, [1.0, 2.0, 1.0]), (3, [1.0, 2.0, 1.0]), (4, None), (5, []), (6, [float("nan"), 1.0, 2.0]), (7, [None, 1.0, 1.0]), (8, [float("inf")] * 3), (9, [1e30, 0.0, 0.0]), (1, [5.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, n int, x int, component int").repartition(3)
    check_whitened(df)
    check_whitened(df, 1)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("size(embedding) = 1")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 33])
def test_jacobi(n):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-5, 3, size=n)
    m = m.T @ m
    values, vectors = whitening.jacobi(m)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and np.abs((vectors * values) @ vectors.T - m).max() < 1e-13 * np.abs(m).max()
    assert (np.diff(values) <= 0).all()


def test_jacobi_keeps_small_values():
    """A graded matrix: eigenvalues some 30 orders apart come out to almost all digits, where others lose the small ones."""
    scale = 10.0 ** -np.arange(0, 18, 3)
    core = np.full((6, 6), 0.3) + 0.7 * np.eye(6)
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    from decimal import Decimal, getcontext

    getcontext().prec = 90
    exact = [[Decimal(float(core[i, j] * scale[i] * scale[j])) for j in range(6)] for i in range(6)]
    product = Decimal(1)  # the determinant, by elimination
    for k in range(6):
        product *= exact[k][k]
        for i in range(k + 1, 6):
            f = exact[i][k] / exact[k][k]
            exact[i] = [a - f * b for a, b in zip(exact[i], exact[k], strict=True)]
    assert float(np.prod(values / scale**2)) == pytest.approx(float(product / np.prod([Decimal(float(x)) ** 2 for x in scale])), rel=1e-11)


def test_deviations_beyond_64_bits():
    x = np.array([[2**50, 0], [0, 0]])
    assert whitening._deviations(x, 2, [2**50, 0]) == [None, None]
    assert whitening._deviations(np.array([[3, 1], [1, 1]]), 2, [4, 2]) == [4, 4]
