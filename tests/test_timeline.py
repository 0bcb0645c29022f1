import random

import pytest
from pyspark.sql import functions as F

from cuebeam.operators import mentions, script, segments, shots, words
from cuebeam.operators.segments import SegmentOptions, enforce_floors_rows
from cuebeam.plans import render
from cuebeam.plans.analyse import analyse

LINES = [
    "Drake filed the appeal in January of that year.", "Kendrick Lamar had already moved on completely.", "The label pushed back against every single claim.",
    "Drake returned to court with a brand new argument.", "Faisal drafted the entire brief overnight.", "Kendrick Lamar never responded to any of it.",
]
CLIPS = ["drake_court.mp4", "drake_stage.mp4", "kendrick_lamar_grammys.mp4", "kendrick_lamar_stage.mp4", "faisal_desk.mp4", "city_broll.mp4"]
CLIP = "job_id string, clip_ord long, clip_id string, filename string, tags array<string>, duration_ms long"


def cues(spark, lines, ms=3000, job="j"):
    return spark.createDataFrame([(job, k, k * ms, (k + 1) * ms, t) for k, t in enumerate(lines)], "job_id string, cue_index long, start_ms long, end_ms long, text string")


def clips(spark, names, ms=20_000, tags=None, job="j"):
    return spark.createDataFrame([(job, k, f"c{k}", n, (tags or {}).get(n, []), ms) for k, n in enumerate(names)], CLIP)


def test_weighted_words(spark):
    w = words.word_timeline(cues(spark, ["a unprecedented"], 10_000)).orderBy("word_index").collect()
    assert (w[0]["start_ms"], w[1]["end_ms"]) == (0, 10_000)
    assert w[1]["end_ms"] - w[1]["start_ms"] > 2 * (w[0]["end_ms"] - w[0]["start_ms"])


def test_published_word_times(spark):
    c = spark.createDataFrame([("j", 0, 9866, 14348, "Drake and Kendrick and Faisal all signed the very same agreement that afternoon.")], "job_id string, cue_index long, start_ms long, end_ms long, text string")
    w = words.word_timeline(c).orderBy("word_index").collect()
    assert [r["start_ms"] for r in w] == [9866, 10241, 10438, 10865, 11062, 11454, 11651, 12043, 12240, 12598, 12956, 13545, 13759]
    assert w[-1]["end_ms"] == 14348


def test_sentences(spark):
    s = words.sentences(words.word_timeline(cues(spark, ["Drake spoke. Then J. Cole replied! Was that all?"]))).orderBy("from_word").collect()
    assert len(s) == 3 and "J. Cole" in s[1]["text"]
    assert [r["to_word"] for r in s[:-1]] == [r["from_word"] for r in s[1:]]


def cast_of(spark, names, lines, tags=None):
    w = words.word_timeline(cues(spark, lines))
    return w, mentions.build_cast(clips(spark, names, tags=tags), w)


@pytest.mark.parametrize("names,lines,expected", [
    (["drake_court_01.mp4", "kendrick_lamar_grammys.mp4"], ["Drake met Kendrick Lamar."], {"Drake": 1, "Kendrick Lamar": 1}),
    (["drake_courtroom_wide.mp4"], ["Drake left the courtroom."], {"Drake": 1}),
    (["drake_court_01.mp4", "drake_stage.mp4", "DrakeCloseup.mp4"], ["Drake."], {"Drake": 3}),
    (["drake_court.mp4", "city_timelapse_night.mp4"], ["Drake."], {"Drake": 1}),
])
def test_cast(spark, names, lines, expected):
    assert {r["canonical"]: len(r["clip_ids"]) for r in cast_of(spark, names, lines)[1].collect()} == expected


def test_cast_tags_and_typos(spark):
    _, cast = cast_of(spark, ["IMG_4471.mp4"], ["Drake."], {"IMG_4471.mp4": ["Drake"]})
    assert [r["canonical"] for r in cast.collect()] == ["Drake"]
    w, cast = cast_of(spark, ["kendrick_lamar.mp4"], ["Kendrick Lamar spoke.", "Kendrik left.", "Then Kendrcik came."])
    found = mentions.find_mentions(w, cast).collect()
    assert len(found) == 3 and any(m["corrected"] for m in found)
    starts = {r["word_index"]: r["start_ms"] for r in w.collect()}
    assert all(m["start_ms"] == starts[m["word_index"]] and m["end_ms"] > m["start_ms"] for m in found)


def run(spark, lines, names=CLIPS, ms=3000, total=None, **options):
    totals = spark.createDataFrame([("j", total)], "job_id string, total_ms long") if total else None
    from cuebeam.plans.analyse import Settings

    return analyse(cues(spark, lines, ms), clips(spark, names), totals, settings=Settings(segments=SegmentOptions(**options)))


def tiles(a, total):
    s = a.segments.orderBy("seg_index").collect()
    assert s[0]["start_ms"] == 0 and s[-1]["end_ms"] == total
    assert all(x["end_ms"] == y["start_ms"] for x, y in zip(s, s[1:], strict=False)) and all(x["duration_ms"] > 0 for x in s)
    return s


def test_whole_script(spark):
    a = run(spark, LINES)
    s = tiles(a, 18_000)
    onsets = {r["start_ms"] for r in a.words.collect()} | {0}
    assert all(x["start_ms"] in onsets for x in s if x["text"])
    for m in a.mentions.collect():
        over = [x for x in s if x["start_ms"] <= m["start_ms"] < x["end_ms"]]
        assert over[0]["entity_id"] == m["entity_id"]
    p = a.shots.orderBy("segment_index").collect()
    assert len(p) == len(s) and [x["duration_ms"] for x in p] == [x["duration_ms"] for x in s]
    assert all(x["clip_id"] != y["clip_id"] for x, y in zip(p, p[1:], strict=False))
    stats = a.stats.first()
    assert stats["shot_count"] == len(p) and stats["total_duration_ms"] == 18_000 and stats["clips_used"] == len({x["clip_id"] for x in p})


def test_three_names_in_one_line(spark):
    a = run(spark, ["Drake and Kendrick Lamar and Faisal all signed the agreement"], ms=6000, min_named_ms=300)
    s = tiles(a, 6000)
    assert len({x["entity_id"] for x in s if x["entity_id"]}) == 3
    assert any(0 < x["start_ms"] < 6000 for x in s)


def test_overrun_and_empty(spark):
    s = tiles(run(spark, LINES, total=40_000), 40_000)
    assert all(x["duration_ms"] <= 7000 * 1.25 + 1 for x in s)
    none = segments.build_segments(words.word_timeline(cues(spark, [""])), spark.createDataFrame([], "job_id string, word_index long, start_ms long, end_ms long, surface string, entity_id string, confidence double"), spark.createDataFrame([("j", 9000), ("k", 0)], "job_id string, total_ms long"))
    assert [(r["job_id"], r["end_ms"], r["entity_id"]) for r in none.collect()] == [("j", 9000, None)]


def naive_floors(rows, named, broll):
    out = [dict(r) for r in rows]
    again = True
    while again and len(out) > 1:
        again = False
        for i, s in enumerate(out):
            n = lambda r: r["end_ms"] - r["start_ms"]
            if n(s) >= (named if s["entity_id"] else broll):
                continue
            near = [out[k] for k in (i - 1, i + 1) if 0 <= k < len(out)]
            same = [r for r in near if r["entity_id"] == s["entity_id"]]
            ok = same[:1] or sorted((r for r in near if not s["entity_id"] or not r["entity_id"]), key=n)[:1]
            if ok:
                t = ok[0]
                first, second = (s, t) if s["from_word"] < t["from_word"] else (t, s)
                t |= {"text": f"{first['text']} {second['text']}".strip(), "start_ms": min(s["start_ms"], t["start_ms"]), "end_ms": max(s["end_ms"], t["end_ms"]), "from_word": min(s["from_word"], t["from_word"]), "to_word": max(s["to_word"], t["to_word"])}
                out.pop(i)
                again = True
                break
    return out


def test_floors_settle_as_with_full_restarts():
    rng = random.Random(4)
    for _ in range(400):
        rows, at = [], 0
        for k in range(rng.randint(1, 12)):
            n = rng.randint(1, 3000)
            rows.append({"from_word": k, "to_word": k + 1, "start_ms": at, "end_ms": at + n, "entity_id": rng.choice([None, "a", "b", "c"]), "text": str(k)})
            at += n
        assert enforce_floors_rows(rows, 600, 2000) == naive_floors(rows, 600, 2000)


def test_greedy_spans(spark):
    rng = random.Random(2)
    rows = [(j, s, rng.randint(1, 3)) for j in "ab" for s in sorted(rng.sample(range(60), 30))]
    want = []
    for j in "ab":
        free = 0
        for _, s, n in (r for r in rows if r[0] == j):
            if s >= free:
                want.append((j, s))
                free = s + n
    got = mentions.greedy_spans(spark.createDataFrame(rows, "job_id string, word_index long, word_count long"), ["job_id"])
    assert sorted((r["job_id"], r["word_index"]) for r in got.collect()) == want


@pytest.mark.parametrize("avoid", [True, False])
def test_least_recently_used(spark, avoid):
    """Pools that share clips, against a search of each whole pool."""
    rng = random.Random(9)
    clip_rows, segment_rows, want = [], [], []
    for j in "abc":
        own = [(j, k, f"c{k}", rng.sample(["x", "y", "z"], rng.choice([0, 1, 2, 3]) if j != "c" else 1)) for k in range(rng.randint(1, 9))]
        pools = {e: [c for _, _, c, es in own if e in es] for e in "xyz"}
        rest = [c for _, _, c, es in own if not es] or [c for _, _, c, _ in own]
        last, just = {}, None
        for k in range(80):
            e = rng.choice(["x", "y", "z", "w", None])
            pool = pools.get(e) or rest
            options = [c for c in pool if not (avoid and c == just)] if len(pool) > 1 else pool
            just = min(options, key=lambda c: last.get(c, -1))
            last[just] = k
            want.append((j, k, just))
            segment_rows.append((j, k, e))
        clip_rows += own
    members = shots.pool_members(spark.createDataFrame(clip_rows, "job_id string, clip_ord long, clip_id string, entity_ids array<string>"))
    rows = shots.choose_pools(spark.createDataFrame(segment_rows, "job_id string, seg_index long, entity_id string"), members)
    assert sorted((r["job_id"], r["seg_index"], r["clip_id"]) for r in shots.assign_clips(rows, members, avoid).collect()) == want


def test_fit(spark):
    f = lambda have, need, uses=0: tuple(spark.range(1).select(shots.fit_source(F.lit(have), F.lit(need), F.lit(uses)).alias("f")).first()["f"])
    assert f(60_000, 3000) == (0, 3000, "trim", 1)
    assert f(1000, 3000) == (0, 1000, "loop", 3)
    assert f(100, 3000) == (0, 100, "stretch", 1)
    assert f(500, 90_000)[3] == 6
    assert len({f(60_000, 3000, k)[0] for k in range(3)}) == 3


def test_frames_do_not_drift(spark):
    b = [0]
    for i in range(500):
        b.append(b[-1] + 1000 + (i * 137) % 900)
    rows = spark.createDataFrame([("j", k, x, y) for k, (x, y) in enumerate(zip(b, b[1:], strict=False))], "job_id string, segment_index long, start_ms long, end_ms long")
    spans = [r["frames"] for r in shots.frame_spans(rows, 30).collect()]
    assert sum(spans) == int(b[-1] / 1000 * 30 + 0.5) and min(spans) >= 1
    tiny = spark.createDataFrame([("j", 0, 0, 5), ("j", 1, 5, 1000)], "job_id string, segment_index long, start_ms long, end_ms long")
    assert shots.frame_spans(tiny, 30).orderBy("start_ms").first()["frames"] == 1


def test_render_loop(spark):
    rows = spark.createDataFrame([("j", k, k * 1000, k * 1000 + 1000) for k in range(50)], "job_id string, segment_index long, start_ms long, end_ms long")
    state = render.Loop(lambda df: spark.createDataFrame(df.collect(), df.schema), batch=20, part=40).run(render.start(rows, 30)).first()
    assert state["next_shot"] == 50 and state["assembled_up_to"] == 50 and len(state["parts"]) == 2


def test_options_are_checked():
    with pytest.raises(ValueError):
        SegmentOptions(min_broll_ms=7000)
    with pytest.raises(ValueError):
        SegmentOptions(min_named_ms=100)
    assert SegmentOptions.preset("rapid").max_duration_ms == 4500
    assert SegmentOptions().merged(min_named_ms=None, max_duration_ms=9000).max_duration_ms == 9000


def test_script(spark):
    lines = script.split_lines(spark.createDataFrame([("j", "Short one. And the reason is simple. Drake spoke to nobody about it today! End.")], "job_id string, text string"), spark.createDataFrame([("j", "Drake")], "job_id string, name string"))
    assert [r["text"] for r in lines.orderBy("line_ord").collect()] == ["Short one. And the reason is simple.", "Drake spoke to nobody about it today!", "End."]
    v = script.vary(spark.createDataFrame([("j", k, "a") for k in range(10)], "job_id string, line_ord long, character string"))
    assert [r["line_ord"] for r in v.filter("break_after").orderBy("line_ord").collect()] == [4, 8]
    terms = {r["term"]: r["name"] for r in script.alias_terms(spark.createDataFrame([(0, "Kendrick Lamar", "rapper, aka: K Dot, KD")], "name_ord long, name string, role string")).collect()}
    assert terms == dict.fromkeys(["KENDRICK LAMAR", "K DOT", "KD", "KENDRICK", "LAMAR", "KL"], "Kendrick Lamar")
    w = spark.createDataFrame([("j", 0, k, t, float(k), k + 1.0) for k, t in enumerate("we saw drake argue loudly then leave court early".split())], "job_id string, block_index long, pos long, word string, word_start double, word_end double")
    row = script.align_lines(spark.createDataFrame([("j", 0, "Drake argued, leave court")], "job_id string, line_ord long, text string"), w).first()
    assert row["line_start"] == pytest.approx(1.94) and row["line_end"] == pytest.approx(8.1)


def test_overused_clips_are_those_of_plans_too(spark, tmp_path):
    """Ten users with one clip each to show, against the SQL."""
    from cuebeam.plans.plan_queries import ORACLE, overused_clips
    from tests.oracle import assert_same, duck

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/part.parquet").filter("p_brand not in ('Brand#11', 'Brand#22', 'Brand#33')").orderBy("p_partkey").limit(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("event_id") % 10).write.parquet(str(tmp_path / "events.parquet"))
    con = duck(sf)
    for t in ("part", "events"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = overused_clips(spark, str(tmp_path))
    assert_same(found, con, ORACLE["overused_clips"])
    clip = str(spark.read.parquet(str(tmp_path / "part.parquet")).first()["p_partkey"])
    assert found.filter(F.col("clip_id") == clip).count() == 10 and found.filter("clip_id = 'even'").count() == 5


def test_words_are_neither_dealt_nor_sorted(spark):
    """Times of words come from their cue's own row: no window runs over words, and empty texts and cues without text have none."""
    cues = spark.createDataFrame([("a", 0, 0, 900, "One two, three!"), ("a", 1, 900, 1000, " "), ("a", 2, 1000, 1001, None), ("a", 3, 2000, 2600, "four"), ("b", 0, 0, 10, "é 5")], "job_id string, cue_index long, start_ms long, end_ms long, text string")
    found = words.word_timeline(cues)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    rows = [(r["job_id"], r["word_index"], r["norm"], r["start_ms"], r["end_ms"]) for r in found.orderBy("job_id", "word_index").collect()]
    # weights 236, 136 and 160 of 532; 50 and 192 of 242
    assert rows[:1] == [("a", 0, "one", 0, rows[0][4])] and [r[1:3] for r in rows] == [(0, "one"), (1, "two"), (2, "three"), (3, "four"), (0, ""), (1, "5")]
    assert [r[4] for r in rows[:2]] == [r[3] for r in rows[1:3]] and rows[2][4] == 900 and rows[3][3:] == (2000, 2600)


def test_segments_alone_plan_no_shots(spark, monkeypatch):
    """Queries on segments leave out the shots, and get the segments of the whole analysis."""
    from cuebeam.plans import analyse, plan_queries

    d = "/root/testdata/sf0.001"
    whole = analyse.analyse(*plan_queries._analysed(spark, d)).segments.drop("text").collect()
    monkeypatch.setattr(analyse, "plan_shots", lambda *a: 1 / 0)
    assert sorted(map(str, plan_queries.analyse_segments(spark, d).collect())) == sorted(map(str, whole)) and whole
    assert {(r["gaps"], r["excess"]) for r in plan_queries.analyse_tiling(spark, d).collect()} == {(0, 0)}


def _late_names(spark, tmp_path):
    """One conversation of three turns, in which only the last two have words that are long enough for a name."""
    rows = [(7, 0, "user", "so who was it then"), (7, 1, "assistant", "It was Montgomery all the way. We saw him go out and then come back in, and he did not say a word to any of us at all."), (7, 2, "user", "And Wellington went too. He had his own way to do it, and it took him all day to get it done the way he wants it.")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_segments_are_named_after_words_of_every_cue(spark, tmp_path):
    from cuebeam.plans.plan_queries import analyse_segments

    found = analyse_segments(spark, _late_names(spark, tmp_path)).filter("entity_id is not null").orderBy("seg_index").collect()
    assert [r["entity_id"] for r in found] == ["montgomery", "wellington"]


def test_shots_show_names_of_every_cue(spark, tmp_path):
    from cuebeam.plans.plan_queries import analyse_shots

    found = analyse_shots(spark, _late_names(spark, tmp_path)).filter("entity_id is not null").orderBy("segment_index").collect()
    # names are as frequent as each other, so the first by letters has clips 11 and 12, the next 21 and 22
    assert [(r["entity_id"], r["clip_id"]) for r in found] == [("montgomery", "11"), ("montgomery", "12"), ("wellington", "21"), ("wellington", "22")]


def test_spans_are_taken_whole(spark):
    """Each span taken keeps its other columns, and spans are found once, not once more to be joined to."""
    rows = [("a", 0, 2, "x"), ("a", 1, 3, "y"), ("a", 2, 1, "z"), ("a", 9, 1, None), ("b", 5, 2, "u")]
    found = mentions.greedy_spans(spark.createDataFrame(rows, "job_id string, word_index long, word_count int, name string"), ["job_id"])
    assert found.columns == ["job_id", "word_index", "word_count", "name"] and found.schema["word_count"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect())) == [rows[0], rows[2], rows[3], rows[4]]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 0
