"""Segmenting by joins and windows over stretches, against a plain walk over each job."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuebeam.functions import text
from cuebeam.operators import segments, stretches, words
from cuebeam.operators.segments import SegmentOptions, enforce_floors_rows
from tests.plain_segments import segment_job

WORD = "job_id string, word_index long, raw string, norm string, start_ms long, end_ms long"
MENTION = "job_id string, word_index long, word_count long, surface string, start_ms long, end_ms long, entity_id string, confidence double"
VOCABULARY = "the a, and; but while said: went. home! Why? J. he team his label of river Drake Lamar (so) their quiet new".split()


def timelines(seed, jobs=6, longest=400):
    """Words and mentions of random jobs: some without words, without mentions, with pauses, with words of one onset."""
    rng = random.Random(seed)
    heard, said, totals = [], [], []
    for j in range(jobs):
        n, at = rng.choice([0, 1, 5, 60, longest]), rng.choice([0, 700])
        own = []
        for k in range(n):
            raw = rng.choice(VOCABULARY)
            length = rng.choice([1, 150, 300, 600, 2500 if rng.random() < 0.1 else 200])
            own.append((f"j{j}", k, raw, raw.strip(",;:.!?()").lower(), at, at + length))
            at += rng.choice([0 if rng.random() < 0.3 else length, length, length + rng.choice([0, 50, 4000])])
        free = 0
        for k in range(n):
            if k >= free and rng.random() < rng.choice([0.02, 0.3]) and j % 3:
                size = rng.choice([1, 1, 2])
                if k + size <= n:
                    said.append((f"j{j}", k, size, own[k][2], own[k][4], own[k + size - 1][5], rng.choice("abc"), rng.choice([1.0, 0.72])))
                    free = k + size
        heard += own
        totals.append((f"j{j}", rng.choice([0, at // 2, at, at + 30_000]) if n else rng.choice([0, 9000])))
    return heard, said, totals


def plain(heard, said, totals, options):
    out = []
    for job, total in totals:
        w = pd.DataFrame([r[1:] for r in heard if r[0] == job], columns=["word_index", "raw", "norm", "start_ms", "end_ms"])
        m = pd.DataFrame([r[1:] for r in said if r[0] == job], columns=["word_index", "word_count", "surface", "start_ms", "end_ms", "entity_id", "confidence"])
        out += [(job, *[r[c] for c in segments._COLUMNS[1:]]) for r in segment_job(w, m, total, options)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "stretch", "ms", "options"), [
    (1, 50_000, 3_600_000, {}), (2, 7, 5000, {}), (3, 3, 900, {"carry_forward_ms": 2000}), (4, 11, 20_000, {"carry_forward": False}), (5, 5, 3000, {"min_named_ms": 200, "min_broll_ms": 400, "max_duration_ms": 1000}),
])
def test_any_stretch_gives_the_walks_segments(spark, monkeypatch, seed, stretch, ms, options):
    monkeypatch.setattr(stretches, "STRETCH", stretch)
    monkeypatch.setattr(stretches, "MS_STRETCH", ms)
    heard, said, totals = timelines(seed)
    o = SegmentOptions(**options)
    got = segments.build_segments(spark.createDataFrame(heard, WORD), spark.createDataFrame(said, MENTION), spark.createDataFrame(totals, "job_id string, total_ms long"), o)
    assert sorted(map(tuple, got.collect())) == plain(heard, said, totals, o)


def test_words_are_read_once(spark):
    """All steps read blocks, which are made in one pass: no step goes over the words again."""
    heard, said, totals = timelines(9)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    own = spark.createDataFrame(heard, WORD)
    got = segments.build_segments(own.mapInArrow(counted, own.schema), spark.createDataFrame(said, MENTION), spark.createDataFrame(totals, "job_id string, total_ms long"))
    assert sorted(map(tuple, got.collect())) == plain(heard, said, totals, SegmentOptions())
    assert read.value == len(heard)


def test_known_long_timelines_spare_the_others_a_second_look(spark):
    rows = spark.createDataFrame([(j, k, k % 3) for j, n in (("a", 4), ("b", 11), (None, 3)) for k in range(n)], "job_id string, k long, v long")
    columns = {"n": ("sum", F.lit(1)), "was": ("before", F.when(F.col("v") > 0, F.col("v"))), "then": ("next", F.when(F.col("v") == 0, F.col("k")))}
    long = spark.createDataFrame([("b",)], "job_id string")
    plainly = stretches.carry(rows, ["job_id"], "k", columns, stretch=5)
    assert sorted(map(tuple, stretches.carry(rows, ["job_id"], "k", columns, stretch=5, long=long).collect()), key=str) == sorted(map(tuple, plainly.collect()), key=str)


def test_words_that_may_refer_back(spark):
    """No text that refers back only with its last word is left out."""
    texts = ["the team", "The old LABEL.", "his", "he's", "(her)", "the manager's", "the of", "river", "the old"]
    rows = spark.createDataFrame([(t, t.split()[-1]) for t in texts], "text string, word string")
    got = rows.filter(text.refers_back(F.col("text"))).select("text", text.may_refer_back(F.col("word")).alias("may")).collect()
    assert sorted(r["text"] for r in got) == sorted(texts[:6]) and all(r["may"] for r in got)


def test_floors_of_stretches_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(stretches, "STRETCH", 4)
    rng = random.Random(8)
    rows, want = [], []
    for j in range(60):
        own, at = [], 0
        for k in range(rng.randint(1, 40)):
            n = rng.choice([rng.randint(1, 3000), rng.randint(2000, 6000)])
            own.append({"from_word": k, "to_word": k + 1, "start_ms": at, "end_ms": at + n, "entity_id": rng.choice([None, "a", "b"]), "text": str(k)})
            at += n
        rows += [(f"j{j}", *r.values()) for r in own]
        want += [(f"j{j}", *r.values()) for r in enforce_floors_rows(own, 600, 2000)]
    df = spark.createDataFrame(rows, "job_id string, from_word long, to_word long, start_ms long, end_ms long, entity_id string, text string")
    assert sorted(map(tuple, segments.enforce_floors(df).collect())) == sorted(want)


def test_long_job_is_spread(spark, monkeypatch):
    """No task has more than its share of one job's words."""
    monkeypatch.setattr(stretches, "STRETCH", 50)
    rows = spark.createDataFrame([("j", k, f"w{k}", f"w{k}", k, k + 1) for k in range(2000)], WORD)
    out = stretches.carry(rows, ["job_id"], "word_index", {"n": ("sum", F.lit(1))})
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join small partitions
    try:
        assert max(out.rdd.glom().map(len).collect()) < 1200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r["word_index"], r["n"]) for r in out.collect()) == [(k, k + 1) for k in range(2000)]


@pytest.mark.parametrize("ms", [3_600_000, 40])
def test_nearest_onset(spark, monkeypatch, ms):
    monkeypatch.setattr(stretches, "MS_STRETCH", ms)
    rng = random.Random(6)
    heard = [(j, k, t) for j in "ab" for k, t in enumerate(sorted(rng.choices(range(400), k=150)))]
    onset = {r[:2]: r[2] for r in heard}
    asked = []
    for i in range(300):
        a = rng.randrange(-1, 155)
        asked.append((rng.choice("abc"), i, max(0, a), max(0, a) + rng.choice([0, 1, 2, 9, 60]), rng.randrange(-50, 450) + rng.choice([0.0, 0.5])))
    want = []
    for j, i, a, b, t in asked:
        near = [(abs(onset[j, k] - t), k) for k in range(a, b) if (j, k) in onset]
        want += [(j, i, min(near)[1])] if near else []
    got = words.nearest_onset(spark.createDataFrame(heard, "job_id string, word_index long, start_ms long"), spark.createDataFrame(asked, "job_id string, target_id long, from_word long, to_word long, target_ms double"))
    assert sorted((r["job_id"], r["target_id"], r["word_index"]) for r in got.collect()) == sorted(want)
