"""Queries on the cast, pools, clip choice, fitting, plans, scripts and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebeam.functions import text
from cuebeam.operators import jobs, script, shots
from cuebeam.operators.mentions import build_cast
from cuebeam.plans.analyse import analyse, segmented
from cuebeam.plans.binding import CLIPS_SQL, MENTIONS_SQL, RUNS_SQL, conversation_cues, conversation_words, event_mentions, part_clips, table
from cuebeam.plans.timeline_queries import event_tiles
from cuebeam.sources.files import concat_line, exact_duration, probe
from cuebeam.staging import stage

#: Entities of events get the clips of a brand; error events name nobody, one type has no clips.
BRAND_OF = {"click": "Brand#11", "purchase": "Brand#22", "view": "Brand#33"}


#: Parts of a library, about.
LIBRARY_PARTS = 20


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Parts dealt over libraries: a part of a listed brand belongs to that brand's event type, others to nobody."""
    entity = F.lit(None).cast("string")
    for e, b in BRAND_OF.items():
        entity = F.when(F.col("p_brand") == b, e).otherwise(entity)
    c = part_clips(spark, d).withColumn("entity_ids", F.when(entity.isNull(), F.array().cast("array<string>")).otherwise(F.array(entity)))
    return _in_library(c, F.col("clip_ord"), spark, d)


def _in_library(rows: DataFrame, number, spark: SparkSession, d: str) -> DataFrame:
    """rows with library: the number dealt over as many as there are parts for, which a subquery counts."""
    libraries = table(spark, d, "part").agg(F.greatest(F.lit(1), F.expr(f"count(1) div {LIBRARY_PARTS}")))
    return rows.withColumn("library", number % libraries.scalar())


def _job_clips(spark: SparkSession, d: str) -> DataFrame:
    """The clips of each user's library."""
    users = _in_library(table(spark, d, "events").select("user_id").distinct(), F.col("user_id"), spark, d)
    return users.select(F.col("user_id").cast("string").alias("job_id"), "library").join(_clips(spark, d), "library").drop("library")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    t = event_tiles(spark, d)
    return t.select("job_id", F.col("ord").alias("seg_index"), "start_ms", "end_ms", ((F.col("end_ms") - F.col("start_ms")) % 9000 + 1).alias("duration_ms"), "entity_id", F.lit("named").alias("source"), F.lit("").alias("text"))


def _pooled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Segments with the names of their pools, and the pools' clips."""
    members = shots.pool_members(_job_clips(spark, d))
    return shots.choose_pools(_segments(spark, d), members), members


def clip_pool_lookup(spark: SparkSession, d: str) -> DataFrame:
    p, members = _pooled(spark, d)
    first = members.filter("place = 0").select("job_id", "pool", F.col("clip_id").alias("first"))
    return p.join(first, ["job_id", "pool"]).select("job_id", "seg_index", "pool_kind", F.col("pool_size").alias("size"), "first")


def lru_assign(spark: SparkSession, d: str) -> DataFrame:
    return shots.assign_clips(*_pooled(spark, d)).select("job_id", "seg_index", "clip_id")


def round_robin_assign(spark: SparkSession, d: str) -> DataFrame:
    return shots.assign_round_robin(*_pooled(spark, d)).select("job_id", "seg_index", "clip_id")


def fit_source(spark: SparkSession, d: str) -> DataFrame:
    p = shots.assign_round_robin(*_pooled(spark, d))
    rows = shots.use_ordinal(p).join(_job_clips(spark, d).select("job_id", "clip_id", F.col("duration_ms").alias("available")), ["job_id", "clip_id"])
    return rows.select("job_id", "seg_index", "uses", shots.fit_source(F.col("available"), F.col("duration_ms"), F.col("uses")).alias("f")).select("job_id", "seg_index", "uses", "f.*")


def _shots(spark: SparkSession, d: str) -> DataFrame:
    p = shots.assign_round_robin(*_pooled(spark, d))
    return p.join(_job_clips(spark, d).select("job_id", "clip_id", F.col("filename").alias("clip_filename")), ["job_id", "clip_id"])


def plan_stats(spark: SparkSession, d: str) -> DataFrame:
    reuse = F.transform(F.array_sort(F.map_entries("clip_reuse")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return shots.plan_stats(_shots(spark, d)).withColumn("clip_reuse", F.array_join(reuse, ","))


def overused_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips that users' plans show too often, and the same of all their events as shots: those of even numbers show one clip, others that of their type.

    Plans go in turn through pools of about twenty clips, so by themselves they may have none.
    """
    events = event_mentions(spark, d).select("job_id", F.when(F.col("event_id") % 2 == 0, "even").otherwise(F.coalesce("entity_id", F.lit("none"))).alias("clip_id"))
    return shots.overused_clips(_shots(spark, d)).unionByName(shots.overused_clips(events))


def unclaimed_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips that no shot uses."""
    used = _shots(spark, d).select("clip_id").distinct()
    return script.unmatched_last(used, _clips(spark, d)).filter("not matched").select("clip_id")


def cast_from_parts(spark: SparkSession, d: str) -> DataFrame:
    """The cast of a library named after parts, against the conversations' words as one script each."""
    clips = _clips(spark, d).select("library", "clip_ord", "clip_id", "filename", F.array().cast("array<string>").alias("tags"))
    w = conversation_words(spark, d)
    words = _in_library(w.select("job_id").distinct(), F.col("job_id").cast("long"), spark, d)
    return build_cast(words.join(clips, "library").drop("library"), w).select("job_id", "entity_ord", "entity_id", "canonical", F.array_join("aliases", "|").alias("aliases"), "kind")


def _analysed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as subtitles; clips of each named after the long words of all its cues, two takes each, and some without a name."""
    cues = conversation_cues(spark, d)
    spoken = cues.select("job_id", F.explode(text.tokens(F.col("text"))).alias("raw")).select("job_id", text.normalize_word(F.col("raw")).alias("norm"))
    long = spoken.filter("length(norm) >= 7").groupBy("job_id", "norm").agg(F.count(F.lit(1)).alias("n"))
    named = long.withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n"), "norm"))).withColumn("take", F.explode(F.sequence(F.lit(1), F.lit(2))))
    clips = named.select("job_id", (F.col("k") * 10 + F.col("take")).cast("long").alias("clip_ord"), F.concat("norm", F.lit("_take_"), "take", F.lit(".mp4")).alias("filename"), (F.col("k") % 9 * 1500 + 500).cast("long").alias("duration_ms"))
    place = F.explode(F.sequence(F.lit(1), F.lit(4)))
    more = cues.select("job_id").distinct().withColumn("k", place).select("job_id", (F.lit(1_000_000_000_000) + F.col("k")).cast("long").alias("clip_ord"), F.concat(F.lit("city_broll_"), "k", F.lit(".mp4")).alias("filename"), (F.col("k") * 4000).cast("long").alias("duration_ms"))
    library = clips.unionByName(more).withColumns({"clip_id": F.col("clip_ord").cast("string"), "tags": F.array().cast("array<string>")})
    return cues, stage(library, "library")


def analyse_shots(spark: SparkSession, d: str) -> DataFrame:
    return analyse(*_analysed(spark, d)).shots.drop("text", "pool_kind")


def analyse_segments(spark: SparkSession, d: str) -> DataFrame:
    return segmented(*_analysed(spark, d)).segments.drop("text")


def analyse_tiling(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the segments of every conversation: they start at 0, leave no gap and end with the last cue."""
    a = segmented(*_analysed(spark, d))
    w = Window.partitionBy("job_id").orderBy("start_ms")
    s = a.segments.withColumn("gap", F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w), F.col("start_ms")))
    return s.groupBy("job_id").agg(F.sum(F.abs("gap")).alias("gaps"), F.max("end_ms").alias("total_ms"), (F.sum("duration_ms") - F.max("end_ms")).alias("excess"))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations; the first one and every sixth from there name a character: the assistant, or else the user."""
    lines = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("job_id"), F.col("turn").cast("long").alias("line_ord"), "text", "role")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("line_ord"))
    named = lines.withColumn("place", place).filter("place % 6 = 1").select("job_id", "line_ord", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("character"))
    return script.match_lines(lines.drop("role"), named)


def plan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Clips for the turns of each conversation: users and assistants have two and three, two belong to nobody."""
    jobs_ = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("job_id")).distinct()
    own = F.when(F.col("clip_ord") < 2, "user").when(F.col("clip_ord") < 5, "assistant")
    clips = jobs_.withColumn("clip_ord", F.explode(F.sequence(F.lit(0), F.lit(6)))).select("job_id", "clip_ord", F.concat(F.lit("c"), "clip_ord").alias("clip_id"), own.alias("character"))
    return script.plan_lines(_cascade(spark, d), clips)


def filename_character(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files, with the character their name gives; known are the first words of all parts' names."""
    c = part_clips(spark, d).select("clip_id", text.filename_character(F.concat(F.lit("AB1_"), "filename")).alias("found"))
    known = table(spark, d, "part").select(F.upper(F.split("p_name", " ")[0]).alias("name")).distinct()
    first = F.split("found", " ")[0]
    return c.join(known, first == known["name"], "left").select("clip_id", F.coalesce("name", "found").alias("character"))


def cast_panel(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as mentions of their type, written like the value's last digit."""
    e = event_mentions(spark, d).filter("entity_id is not null").withColumn("digit", F.floor(F.col("value") * 10).cast("long") % 10)
    m = e.select("job_id", "entity_id", F.concat("entity_id", "digit").alias("surface"), (F.col("digit") % 3 == 0).alias("corrected"), F.col("ord").alias("word_index"))
    s = e.select("job_id", "entity_id", F.when(F.col("digit") > 4, "named").otherwise("held").alias("source"))
    return script.cast_panel(s, m, _job_clips(spark, d)).withColumn("variants", F.array_join("variants", ","))


def clips_for_choice(spark: SparkSession, d: str) -> DataFrame:
    """How many clips of its own character and of others each shot may get."""
    c = script.clips_for_choice(_segments(spark, d).withColumnRenamed("seg_index", "segment_index"), _job_clips(spark, d))
    return c.groupBy("job_id", "segment_index").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("others"))


def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return script.distinct_names(e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("event_type", F.lit("-"), F.col("n") % 7), "n"))).alias("faces")))


def media_probe(spark: SparkSession, d: str) -> DataFrame:
    """Parts printed as an encoder's text and read back."""
    p = table(spark, d, "part")
    log = F.format_string(
        "Input #0, mov, from 'x':\n  Duration: 00:%02d:%02d.%02d, start: 0.0\n  Stream #0:0(und): Video: h264 (High), yuv420p, %dx%d [SAR 1:1], 25 kb/s, %d fps, 25 tbr\n  Stream #0:1: Audio: aac (LC), 44100 Hz\n",
        (F.col("p_partkey") % 60), F.col("p_size") % 60, F.col("p_partkey") % 100, F.col("p_size") * 10 + 100, F.col("p_size") * 9 + 90, F.col("p_size") % 30 + 1,
    )
    return probe(p.select(F.col("p_partkey").alias("object_id"), log.alias("log"))).select("object_id", "duration_ms", "width", "height", F.col("fps").cast("long").alias("fps"), "has_video", "has_audio", "video_codec", "audio_codec", "sample_rate")


def media_duration(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    stamp = lambda s: F.format_string("time=00:00:%02d.%02d", s % 60, F.col("p_partkey") % 100)
    return p.select("p_partkey", exact_duration(F.concat_ws(" ", stamp(F.col("p_size")), F.lit("bitrate"), stamp(F.col("p_size") + 7))).alias("duration_ms"), concat_line(F.concat("p_name", F.lit("'s"))).alias("line"))


def stream_compatible(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        (F.col("p_partkey") % 300).alias("job_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") < 49, "h264").otherwise("vp9").alias("codec"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.when(F.col("p_size") % 2 == 0, 25.0 + F.col("p_size") / 2000).alias("fps"), F.lit("aac").alias("audio_codec"), F.lit(44100).alias("sample_rate"),
    )
    return jobs.stream_compatible(p)


def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"w": F.when(F.col("p_size") % 2 == 0, 1920).otherwise(1280), "h": F.when(F.col("p_size") % 2 == 0, 1080).otherwise(720), "fps": F.when(F.col("p_size") % 3 == 0, 30.0).otherwise(25.0)})
    speed = shots.playback_speed(F.col("p_size") * 20, F.lit(30), 30, F.when(F.col("p_size") < 20, "stretch").otherwise("trim"))
    return p.select("p_partkey", shots.filter_chain({"width": F.col("w"), "height": F.col("h"), "fps": F.col("fps")}, {"width": 1920, "height": 1080, "fps": 30, "fill": "crop"}, speed).alias("chain"))


def render_progress(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", shots.progress(F.col("p_size"), F.lit(50), F.col("p_size") * 1000).alias("p")).select("p_partkey", "p.percent", "p.eta_ms")


def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    e = event_mentions(spark, d).select("job_id", F.col("ord").alias("segment_index"), (F.col("event_id") % 20).alias("clip_id"), ((F.col("event_id") % 20 + 1) * 10).alias("bytes"))
    return shots.pack_batches(e, 500).groupBy("job_id", "batch").agg(F.count(F.lit(1)).alias("n"))


def script_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("job_id"), "text")
    return script.split_lines(t)


def alias_terms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("name_ord"), F.col("p_name").alias("name"), F.concat(F.lit("aka: "), "p_brand", F.lit(", "), "p_type").alias("role"))
    return script.alias_terms(c)


def variety_break(spark: SparkSession, d: str) -> DataFrame:
    e = event_mentions(spark, d).select("job_id", F.col("ord").alias("line_ord"), F.when(F.col("entity_id") == "view", "v").otherwise("o").alias("character"))
    return script.vary(e).select("job_id", "line_ord", "break_after")


def line_context(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations that name nobody take up the last character; users of turns divisible by 3 are named."""
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line_ord"), "text", "role")
    named = lines.filter("line_ord % 3 = 1").select("job_id", "line_ord", F.col("role").alias("character"))
    return script.match_lines(lines.drop("role"), named).select("job_id", "line_ord", "character", "reason")


def face_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    faces = e.select((F.col("event_id") % 50).alias("clip_id"), F.col("event_type").alias("label"))
    tags = e.select((F.col("event_id") % 50).alias("clip_id"), F.lit("view").alias("label")).distinct()
    return script.face_histogram(faces, tags)


QUERIES = {
    f.__name__: f
    for f in (
        clip_pool_lookup, lru_assign, round_robin_assign, fit_source, plan_stats, overused_clips, unclaimed_clips, cast_from_parts, analyse_shots, analyse_segments, analyse_tiling, media_probe,
        media_duration, stream_compatible, filter_chain, render_progress, pack_batches, script_lines, alias_terms, variety_break, line_context, face_histogram,
        plan_lines, filename_character, cast_panel, clips_for_choice, distinct_names,
    )
}

_ENTITY = "CASE " + " ".join(f"WHEN p_brand = '{b}' THEN '{e}'" for e, b in BRAND_OF.items()) + " END"
_POOLS = f"""{RUNS_SQL}, {CLIPS_SQL},
    lib AS (SELECT *, {_ENTITY} AS owner, p.clip_ord % (SELECT greatest(1, count(*) // {LIBRARY_PARTS}) FROM part) AS library FROM clips p),
    lists AS (SELECT library, owner, list(clip_id ORDER BY clip_ord) AS pool FROM lib GROUP BY ALL), every AS (SELECT library, list(clip_id ORDER BY clip_ord) AS pool FROM lib GROUP BY 1),
    job_of AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, user_id % (SELECT greatest(1, count(*) // {LIBRARY_PARTS}) FROM part) AS library FROM events),
    segs AS (SELECT t.job_id, t.ord AS seg_index, t.entity_id, t.end_ms, (t.end_ms - t.start_ms) % 9000 + 1 AS duration_ms, coalesce(p.pool, b.pool, v.pool) AS pool, j.library,
        CASE WHEN p.pool IS NOT NULL THEN 'entity' WHEN t.entity_id IS NOT NULL THEN 'fallback' ELSE 'broll' END AS pool_kind
        FROM tiles t JOIN job_of j USING (job_id) JOIN every v ON v.library = j.library LEFT JOIN lists p ON p.library = j.library AND p.owner = t.entity_id
        LEFT JOIN lists b ON b.library = j.library AND b.owner IS NULL),
    turns AS (SELECT *, pool[(row_number() OVER (PARTITION BY job_id, entity_id ORDER BY seg_index) - 1) % len(pool) + 1] AS clip_id FROM segs),
    used AS (SELECT t.*, row_number() OVER (PARTITION BY job_id, t.clip_id ORDER BY seg_index) - 1 AS uses, l.duration_ms AS available FROM turns t JOIN lib l USING (clip_id))"""

ORACLE = {
    "clip_pool_lookup": f"WITH {_POOLS} SELECT job_id, seg_index, pool_kind, len(pool) AS size, pool[1] AS first FROM segs",
    "round_robin_assign": f"WITH {_POOLS} SELECT job_id, seg_index, clip_id FROM turns",
    "fit_source": f"""WITH {_POOLS}, f AS (SELECT *, available - duration_ms AS slack FROM used), m AS (SELECT *, CASE WHEN slack > 250 THEN (uses * greatest(500, slack // 4)) % (slack + 1) ELSE 0 END AS moved FROM f)
        SELECT job_id, seg_index, uses, CAST(CASE WHEN available >= duration_ms THEN moved ELSE 0 END AS BIGINT) AS in_ms, CAST(CASE WHEN available >= duration_ms THEN moved + duration_ms ELSE available END AS BIGINT) AS out_ms,
        CASE WHEN available >= duration_ms THEN 'trim' WHEN available < 400 THEN 'stretch' ELSE 'loop' END AS fit_mode,
        CAST(CASE WHEN available < duration_ms AND available >= 400 THEN least(6, ceil(CAST(duration_ms AS DOUBLE) / available)) ELSE 1 END AS BIGINT) AS loops FROM m""",
    "plan_stats": f"""WITH {_POOLS}, n AS (SELECT t.job_id, l.filename, t.clip_id, count(*) AS n FROM turns t JOIN lib l USING (clip_id) GROUP BY ALL), f AS (SELECT job_id, filename, arg_max(n, clip_id) AS n FROM n GROUP BY 1, 2),
        r AS (SELECT job_id, string_agg(filename || '=' || n, ',' ORDER BY filename) AS clip_reuse FROM f GROUP BY 1)
        SELECT job_id, max(end_ms) AS total_duration_ms, count(*) AS shot_count, count(*) FILTER (pool_kind = 'entity') AS named_shots, count(*) FILTER (pool_kind = 'broll') AS broll_shots,
        count(*) FILTER (pool_kind = 'fallback') AS unmatched_shots, count(DISTINCT clip_id) AS clips_used, any_value(clip_reuse) AS clip_reuse FROM turns JOIN r USING (job_id) GROUP BY 1""",
    "overused_clips": f"""WITH {_POOLS}, every_shot AS (SELECT 'plan' AS of, job_id, clip_id FROM turns UNION ALL SELECT 'events', job_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE coalesce(entity_id, 'none') END FROM event_mentions),
        u AS (SELECT of, job_id, clip_id, count(*) AS n FROM every_shot GROUP BY ALL), s AS (SELECT of, job_id, sum(n) AS shots FROM u GROUP BY 1, 2)
        SELECT job_id, clip_id, n FROM u JOIN s USING (of, job_id) WHERE n > greatest(6, shots / 3.0)""",
    "unclaimed_clips": f"WITH {_POOLS} SELECT clip_id FROM lib WHERE clip_id NOT IN (SELECT clip_id FROM turns)",
    "lru_assign": f"""WITH RECURSIVE {_POOLS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_index) AS k FROM segs),
        walk AS (SELECT job_id, seg_index, k, pool[1] AS clip_id, [pool[1]] AS used FROM n WHERE k = 1
            UNION ALL SELECT job_id, seg_index, k, clip_id, list_append(list_filter(used, lambda x: x <> clip_id), clip_id) FROM (
                SELECT job_id, seg_index, k, used, coalesce(list_filter(options, lambda x: NOT list_contains(used, x))[1], list_filter(used, lambda x: list_contains(options, x))[1]) AS clip_id FROM (
                    SELECT n.job_id, n.seg_index, n.k, used, CASE WHEN len(n.pool) > 1 THEN list_filter(n.pool, lambda x: x <> walk.clip_id) ELSE n.pool END AS options
                    FROM walk JOIN n ON n.job_id = walk.job_id AND n.k = walk.k + 1)))
        SELECT job_id, seg_index, clip_id FROM walk""",
    "variety_break": f"""WITH RECURSIVE {MENTIONS_SQL}, c AS (SELECT job_id, ord, CASE WHEN entity_id = 'view' THEN 'v' ELSE 'o' END AS c FROM event_mentions),
        s AS (SELECT *, c IS DISTINCT FROM lag(c) OVER o AS new FROM c WINDOW o AS (PARTITION BY job_id ORDER BY ord)),
        g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY job_id ORDER BY ord) AS run FROM s), r AS (SELECT job_id, ord, row_number() OVER (PARTITION BY job_id, run ORDER BY ord) AS n FROM g),
        walk AS (SELECT job_id, ord, 1 AS since, false AS stop FROM r WHERE ord = 0
            UNION ALL SELECT r.job_id, r.ord, CASE WHEN stop THEN 1 ELSE since + 1 END, n >= 5 AND CASE WHEN stop THEN 1 ELSE since + 1 END >= 4 FROM walk JOIN r ON r.job_id = walk.job_id AND r.ord = walk.ord + 1)
        SELECT job_id, ord AS line_ord, stop AS break_after FROM walk""",
    "plan_lines": r"""WITH RECURSIVE l AS (SELECT CAST(conv_id AS VARCHAR) AS job_id, turn, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role FROM conversations),
        n AS (SELECT *, CASE WHEN k % 6 = 1 THEN CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END END AS named FROM l),
        c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM n),
        r AS (SELECT *, CASE WHEN named IS NOT NULL THEN 'name' WHEN regexp_matches(t, '\b(he|his|him|they|their|them)\b') AND NOT regexp_matches(t, '\b(she|her)\b') THEN 'context' ELSE 'continue' END AS reason,
            CASE WHEN owner = 'user' THEN ['c0', 'c1'] ELSE ['c2', 'c3', 'c4'] END AS pool, CASE WHEN owner = 'user' THEN ['c2', 'c3', 'c4'] ELSE ['c0', 'c1'] END AS others, row_number() OVER (PARTITION BY job_id, owner ORDER BY k) AS u FROM c),
        runs AS (SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS owner, 0 AS run, 0 AS since, false AS stop FROM (SELECT DISTINCT job_id FROM r)
            UNION ALL SELECT x.job_id, r.k, r.owner, CASE WHEN r.owner = x.owner THEN run + 1 ELSE 1 END, CASE WHEN stop THEN 1 ELSE since + 1 END, CASE WHEN r.owner = x.owner THEN run + 1 ELSE 1 END >= 5 AND CASE WHEN stop THEN 1 ELSE since + 1 END >= 4 FROM runs x JOIN r ON r.job_id = x.job_id AND r.k = x.k + 1),
        breaks AS (SELECT job_id, k, row_number() OVER (PARTITION BY job_id, owner ORDER BY k) - 1 AS b FROM runs WHERE stop),
        rows_ AS (SELECT job_id, k, 0 AS kind, turn AS line_ord, owner, pool, pool[(u - 1) % len(pool) + 1] AS clip, reason FROM r
            UNION ALL SELECT r.job_id, r.k, 1, NULL, owner, pool, others[b % len(others) + 1], 'break' FROM r JOIN breaks USING (job_id, k)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k, kind) AS p FROM rows_),
        counts AS (SELECT job_id, count(*) FILTER (owner = 'user') AS nu, count(*) FILTER (owner <> 'user') AS na FROM r GROUP BY 1),
        walk AS (SELECT job_id, CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS line_ord, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS clip, CAST(NULL AS VARCHAR) AS reason, nu, na FROM counts
            UNION ALL SELECT job_id, p, line_ord, owner, CASE WHEN same THEN pool[(n + skip) % len(pool) + 1] ELSE clip END, CASE WHEN same THEN reason || ', rotated' ELSE reason END,
                CASE WHEN same AND owner = 'user' THEN nu + skip + 1 ELSE nu END, CASE WHEN same AND owner <> 'user' THEN na + skip + 1 ELSE na END
            FROM (SELECT *, CASE WHEN pool[n % len(pool) + 1] = clip THEN 1 ELSE 0 END AS skip FROM (SELECT w.job_id, q.p, q.line_ord, q.owner, q.clip, q.reason, q.pool, w.nu, w.na, coalesce(q.clip = w.clip, false) AND q.kind = 0 AS same, CASE WHEN q.owner = 'user' THEN w.nu ELSE w.na END AS n
                FROM walk w JOIN placed q ON q.job_id = w.job_id AND q.p = w.p + 1)))
        SELECT job_id, p - 1 AS position, CAST(line_ord AS BIGINT) AS line_ord, owner AS character, clip AS clip_id, reason FROM walk WHERE p > 0""",
    "script_lines": r"""WITH RECURSIVE t AS (SELECT conv_id || ':' || turn AS job_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(regexp_replace(text, '\r?\n', ' ', 'g'), '\s{2,}', ' ', 'g')), '([.!?]+)\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations),
        u AS (SELECT job_id, unnest(p) AS piece, unnest(range(len(p))) AS k, len(p) AS n FROM t), v AS (SELECT *, len(list_filter(regexp_split_to_array(piece, '\s+'), lambda x: x <> '')) AS c FROM u),
        walk AS (SELECT job_id, k, n, piece AS held, c, 0 AS line FROM v WHERE k = 0
            UNION ALL SELECT v.job_id, v.k, v.n, CASE WHEN walk.c >= 6 THEN v.piece ELSE walk.held || ' ' || v.piece END, CASE WHEN walk.c >= 6 THEN v.c ELSE walk.c + v.c END, walk.line + CAST(walk.c >= 6 AS INT) FROM walk JOIN v ON v.job_id = walk.job_id AND v.k = walk.k + 1)
        SELECT job_id, CAST(line AS BIGINT) AS line_ord, held AS text FROM walk WHERE c >= 6 OR k = n - 1""",
    "alias_terms": r"""WITH p AS (SELECT p_partkey AS o, trim(p_name) AS name, string_split(trim(p_name), ' ') AS w, [upper(trim(x)) for x in [p_brand, p_type]] AS nick FROM part),
        t AS (SELECT o, name, unnest(list_concat([upper(name)], nick, CASE WHEN len(w) >= 2 THEN [upper(w[1]), upper(w[-1]), upper(array_to_string(list_transform(w, lambda x: x[1]), ''))] ELSE [] END)) AS term FROM p)
        SELECT term, arg_max(name, o) AS name FROM t GROUP BY 1""",
    "filename_character": """SELECT CAST(p_partkey AS VARCHAR) AS clip_id, upper(split_part(p_name, ' ', 1)) AS character FROM part""",
    "cast_panel": f"""WITH {_POOLS}, e AS (SELECT *, CAST(floor(value * 10) AS BIGINT) % 10 AS digit FROM event_mentions WHERE entity_id IS NOT NULL),
        s AS (SELECT job_id, entity_id, entity_id || digit AS surface, count(*) AS n, min(ord) AS first, digit % 3 = 0 AS corrected FROM e GROUP BY ALL),
        v AS (SELECT job_id, entity_id, CAST(sum(n) AS BIGINT) AS mentions, count(*) FILTER (corrected) AS corrected, array_to_string(list(surface ORDER BY n DESC, first)[1:3], ',') AS variants FROM s GROUP BY 1, 2),
        o AS (SELECT job_id, owner AS entity_id, count(*) AS clips FROM lib JOIN job_of USING (library) WHERE owner IS NOT NULL GROUP BY 1, 2), m AS (SELECT job_id, entity_id, count(*) FILTER (digit > 4) AS named_shots FROM e GROUP BY 1, 2)
        SELECT v.*, coalesce(clips, 0) AS clips, named_shots FROM v LEFT JOIN o USING (job_id, entity_id) JOIN m USING (job_id, entity_id)""",
    "clips_for_choice": f"""WITH {_POOLS} SELECT job_id, seg_index AS segment_index, count(*) FILTER (coalesce(owner = entity_id, false)) AS own, count(*) FILTER (NOT coalesce(owner = entity_id, false)) AS others
        FROM segs JOIN lib USING (library) GROUP BY 1, 2""",
    "distinct_names": "SELECT DISTINCT event_type || '-' || (n % 7) AS name FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)",
    "media_probe": """SELECT p_partkey AS object_id, CAST(((p_partkey % 60) * 60 + p_size % 60) * 1000 + p_partkey % 100 * 10 AS BIGINT) AS duration_ms, p_size * 10 + 100 AS width, p_size * 9 + 90 AS height, CAST(p_size % 30 + 1 AS BIGINT) AS fps,
        true AS has_video, true AS has_audio, 'h264' AS video_codec, 'aac' AS audio_codec, 44100 AS sample_rate FROM part""",
    "media_duration": """SELECT p_partkey, CAST(greatest(p_size % 60, (p_size + 7) % 60) * 1000 + p_partkey % 100 * 10 AS BIGINT) AS duration_ms, 'file ''' || p_name || '''\\''''s''' AS line FROM part""",
    "stream_compatible": """WITH p AS (SELECT p_partkey % 300 AS job_id, p_partkey AS ord, CASE WHEN p_size < 49 THEN 'h264' ELSE 'vp9' END AS codec, CASE WHEN p_size % 2 = 0 THEN 25.0 + p_size / CAST(2000 AS DOUBLE) END AS fps FROM part),
        f AS (SELECT *, first_value(codec) OVER o AS rc, first_value(fps) OVER o AS rf FROM p WINDOW o AS (PARTITION BY job_id ORDER BY ord))
        SELECT job_id, bool_and(codec = rc AND coalesce(abs(fps - rf) < 0.05, true)) AS compatible FROM f GROUP BY 1""",
    "filter_chain": """SELECT p_partkey, CASE WHEN p_size < 20 THEN 'setpts=' || printf('%.6f', 1.0 / greatest(0.25, least(1.0, p_size * 20 / 1000.0))) || '*PTS,' ELSE '' END
        || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'scale=1920:1080:force_original_aspect_ratio=increase,crop=1920:1080,' END || 'setsar=1,' || CASE WHEN p_size < 20 OR p_size % 3 <> 0 THEN 'fps=30,' ELSE '' END || 'format=yuv420p' AS chain FROM part""",
    "render_progress": """SELECT p_partkey, CAST(floor(2 + CAST(p_size AS DOUBLE) / 50 * 78 + 0.5) AS BIGINT) AS percent,
        CASE WHEN CAST(p_size AS DOUBLE) / 50 > 0.03 THEN CAST(floor(p_size * 1000 / (CAST(p_size AS DOUBLE) / 50) - p_size * 1000 + 0.5) AS BIGINT) END AS eta_ms FROM part""",
    "pack_batches": f"""WITH {MENTIONS_SQL}, e AS (SELECT job_id, ord, event_id % 20 AS clip_id, (event_id % 20 + 1) * 10 AS bytes FROM event_mentions),
        n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY job_id, clip_id ORDER BY ord) = 1 THEN bytes ELSE 0 END AS fresh FROM e),
        b AS (SELECT job_id, coalesce(sum(fresh) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS batch FROM n)
        SELECT job_id, CAST(batch AS BIGINT) AS batch, count(*) AS n FROM b GROUP BY 1, 2""",
    "line_context": r"""WITH l AS (SELECT conv_id AS job_id, turn AS line_ord, lower(text) AS t, CASE WHEN turn % 3 = 1 THEN role END AS named FROM conversations),
        c AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS character FROM l)
        SELECT job_id, line_ord, character, CASE WHEN named IS NOT NULL THEN 'name' WHEN character IS NULL THEN 'fallback'
        WHEN regexp_matches(t, '\b(he|his|him|they|their|them)\b') AND NOT regexp_matches(t, '\b(she|her)\b') THEN 'context' ELSE 'continue' END AS reason FROM c""",
    "face_histogram": """WITH b AS (SELECT event_id % 50 AS clip_id, event_type AS label, 1 AS w FROM events UNION ALL SELECT DISTINCT event_id % 50, 'view', 999 FROM events)
        SELECT clip_id, label, CAST(sum(w) AS BIGINT) AS n FROM b GROUP BY 1, 2""",
    "analyse_tiling": "WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[\\s ﻿]+'), lambda x: x <> '')) * 10000 // 29 AS span FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(0 AS BIGINT) AS gaps, CAST(sum(span) + 450 * (count(*) - 1) AS BIGINT) AS total_ms, CAST(0 AS BIGINT) AS excess FROM t GROUP BY 1",
}
