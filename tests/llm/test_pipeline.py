import random

import corpus_pipeline
from cuebeam.llm import suffix_dedup
from tests.llm.test_pairs import jaccard_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "best-fit packing":
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, accepted, distinct, cut = seen
    assert {d for d in before if d in quality and d in accepted} == {d for d in before if quality.get(d) == 1}
    ids, kept = sorted(accepted), sorted(distinct)
    first_of = jaccard_groups([accepted[d] for d in ids])
    assert kept == [d for k, d in enumerate(ids) if first_of[k] == k] and len(kept) < len(ids)
    first = {}
    for d in kept:
        t = distinct[d].encode()
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (d, i))
    for d in kept:
        t = distinct[d].encode()
        spans = [{"from": i, "to": i + 100} for i in range(len(t) - 99) if first[t[i : i + 100]] < (d, i)]
        assert cut[d] == suffix_dedup.kept_bytes(t, spans)[0].decode("utf-8", "ignore")
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(cut)
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 for own in by.values())


def test_nulls_and_clashing_columns(spark):
    rows = [(k, " ".join(random.Random(k % 5).choices("the of a river stone quiet".split(), k=40)), None, None, None, 1) for k in range(12)] + [(None, None, None, None, None, 2), (50, "", None, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")
    kept = corpus_pipeline.simhash_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 50] and kept.columns == docs.columns
    assert corpus_pipeline.suffix_stage(spark, kept, SF).count() == 7
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SF).count() == 0


def test_quality_stage_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "77.0 score", "5 predicted").limit(60)
    odd = spark.createDataFrame([(None, None, 77.0, 5), (9001, "", 77.0, 5), (9001, "", 77.0, 5)], "doc_id long, text string, score double, predicted int")
    kept = corpus_pipeline.quality_stage(spark, docs.selectExpr("doc_id", "text", "double(score) score", "predicted").unionByName(odd), SF)
    rows = kept.collect()
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and all((r["score"], r["predicted"]) == (77.0, 5) for r in rows) and len(rows) > 20
    assert len([r for r in rows if not r["text"]]) in (0, 3)
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), SF).count() == 0


def test_columns_named_like_inner_ones(spark):
    """Columns of any name come out as they went in."""
    names = ["__score", "__accepted", "__row", "row", "first", "__doc", "__tie", "__spans", "spans", "doc", "tie", "others", "Score", "predicted", "id", "label", "a.b", "c`d"]
    words = "the of a river stone quiet walk under old bridge".split()
    rows = [(k, " ".join(random.Random(k % 6).choices(words, k=60)), *[float(k)] * len(names)) for k in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for name, step in corpus_pipeline.STAGES[:3]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(set(r[2:]) == {float(r["doc_id"])} for r in kept), name
        if name == "SimHash near-dedup":
            assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3, 4, 5]
        elif name == "suffix-array dedup":
            assert len(kept) == 12 and [r["text"] for r in kept if r["doc_id"] > 5] == [""] * 6


def test_one_row_of_each_group_stays(spark):
    t = [" ".join(random.Random(k).choices("the of a river stone quiet".split(), k=40)) for k in range(4)]
    rows = [(1, t[0]), (1, t[0]), (2, t[0]), (2, t[1]), (None, t[2]), (None, t[2]), (None, t[0]), (None, t[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, t[0]), (2, t[1]), (None, t[2]), (None, t[3])], key=str)


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    """Pairs that are checked on their sets hold those of near SimHash fingerprints, found through its index."""
    from cuebeam.llm import simhash

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10 + k, f"{t} end") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = []
    plain = simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda *a: pairs.append(plain(*a)) or pairs[0])
    kept = corpus_pipeline.simhash_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    fp = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs, 5).collect()}
    near = sum(bin(fp[k] ^ fp[10 + k]).count("1") <= 3 for k in range(6))
    assert near and pairs[0].count() == near


def test_training_and_index_leave_the_driver_small(spark, monkeypatch):
    """The sample is trained on in a task, texts give fingerprints where their sets are made, and the index's plan is short."""
    from pyspark.sql import functions as F

    from cuebeam.llm import quality, simhash

    here, plain_fit = [], quality.fit  # a worker appends to a copy
    monkeypatch.setattr(quality, "fit", lambda *a: here.append(a) or plain_fit(*a))
    rows = [(k, ("the river is quiet " if k % 2 else "buy now cheap ") * (3 + k % 5), k % 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    scored = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model, at_least=0.5).collect()}
    assert scored == {k: q for k, _, q in rows} and not here

    texts = docs.select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(90, None), (91, " "), (92, "a b")], "id long, text string"))
    plain = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(texts, 3, id_col="id").collect()}
    assert {r["id"]: r["fp"] for r in simhash.signatures(texts, 3).filter("id is not null").collect()} == plain
    assert len(simhash.links(texts.select(F.col("id").alias("fp")))._jdf.queryExecution().analyzed().toString()) < 20_000


def test_finer_postings_of_long_lists(spark, monkeypatch):
    """A list beyond LONG_LIST is posted again under five positions each, with the keys that _posting() gives; the links are the same."""
    from cuebeam.llm import components, simhash

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({(b ^ sum(1 << k for k in rng.sample(range(64), n))) for b in base for n in (0, 1, 2, 3)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    label = lambda: {r["node"]: r["label"] for r in components.components(simhash.links(df)).collect()}
    plain = label()
    monkeypatch.setattr(simhash, "LONG_LIST", 0)
    assert len(plain) > 12 and label() == plain
