"""Queries on runs, tiles, joins in time and views of a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebeam.functions import text, time
from cuebeam.operators import jobs, segments, shots, words
from cuebeam.operators.script import nearest_descriptor as nearest
from cuebeam.operators.stretches import numbered
from cuebeam.plans.binding import MENTIONS_SQL, RUNS_SQL, WORDS_SQL, conversation_words, event_mentions, table
from cuebeam.sources.files import timeline_export
from cuebeam.staging import stage


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    return segments.collapse_runs(event_mentions(spark, d), ["job_id"], ["ord"], "entity_id")


def collapse_runs(spark: SparkSession, d: str) -> DataFrame:
    return event_runs(spark, d).select("job_id", "ord", "start_ms", "entity_id")


def event_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events as tiles of each user's time, which ends five seconds after the last event."""
    total = event_mentions(spark, d).groupBy("job_id").agg((F.max("start_ms") + 5000).alias("total"))
    return segments.tile(event_runs(spark, d).join(total, "job_id"), ["job_id"], F.col("total")).select("job_id", "ord", "entity_id", "start_ms", "end_ms")


def ceiling_split(spark: SparkSession, d: str) -> DataFrame:
    # a day at most: user timelines are months long
    return segments.split_long(event_tiles(spark, d), 86_400_000).select("job_id", "ord", "part", "start_ms", "end_ms")


def _as_segments(spark: SparkSession, d: str) -> DataFrame:
    e = event_mentions(spark, d).withColumn("end_ms", F.lead("start_ms").over(Window.partitionBy("job_id").orderBy("ord")))
    return e.filter("end_ms is not null").select(
        "job_id", F.col("ord").alias("from_word"), (F.col("ord") + 1).alias("to_word"), "start_ms", "end_ms", "entity_id", F.lit("named").alias("source"), "value", F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("trigger_surface"), F.col("event_id").cast("string").alias("text"),
    )


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return segments.merge_adjacent(_as_segments(spark, d)).select("job_id", "from_word", "to_word", "start_ms", "end_ms", "duration_ms", "entity_id", "text")


def enforce_floors(spark: SparkSession, d: str) -> DataFrame:
    # a second for six minutes: events of a user lie hours apart
    scaled = _as_segments(spark, d).withColumns({c: F.floor(F.col(c) / 360).cast("long") for c in ("start_ms", "end_ms")})
    columns = ("job_id", "from_word", "to_word", "start_ms", "end_ms", "entity_id", "text")
    merged = segments.enforce_floors(scaled.select(*columns), segments.SegmentOptions(min_named_ms=10_000, min_broll_ms=20_000, max_duration_ms=60_000))
    return numbered(merged, ["job_id"], "from_word", "seg_index")


def segment_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Segments of conversations, in which the longer words of the first cue are names; every other one's voice goes on for 30 s."""
    w = stage(conversation_words(spark, d), "timeline-words")
    longer = w.filter("length(norm) >= 6")
    names = longer.filter("cue_index = 0").select("job_id", "norm").distinct()
    said = longer.join(names, ["job_id", "norm"]).select("job_id", "word_index", F.col("raw").alias("surface"), "start_ms", "end_ms", F.col("norm").alias("entity_id"), F.lit(1.0).alias("confidence"))
    totals = w.groupBy("job_id").agg((F.max("end_ms") + F.when(F.col("job_id").cast("long") % 2 == 0, 30_000).otherwise(0)).alias("total_ms"))
    return segments.build_segments(w, stage(said, "timeline-said"), stage(totals, "timeline-totals"))


def stabbing_join(spark: SparkSession, d: str) -> DataFrame:
    """The tile that holds each purchase, of the tiles of the other events."""
    e = event_mentions(spark, d)
    points = e.select("job_id", "event_id", F.col("start_ms").alias("at_ms"))
    return segments.stabbing_join(points, event_tiles(spark, d), ["job_id"], "at_ms").select("job_id", "event_id", F.col("tile_entity_id").alias("entity_id"), F.col("tile_start_ms").alias("start_ms"))


def frame_spans(spark: SparkSession, d: str) -> DataFrame:
    return shots.frame_spans(event_tiles(spark, d), 30).select("job_id", "ord", "frames")


def frame_totals(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each user's tiles against its length: no drift over one and a half frames."""
    t = shots.frame_spans(event_tiles(spark, d), 30).groupBy("job_id").agg(F.sum("frames").alias("frames"), F.max("end_ms").alias("total_ms"))
    return t.withColumn("sound", shots.drifts(F.col("frames"), F.col("total_ms"), 30))


def lane_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = event_tiles(spark, d).withColumnRenamed("ord", "segment_index")
    order = t.filter("entity_id is not null").groupBy("job_id", "entity_id").agg(F.min("segment_index").alias("entity_ord"))
    return shots.lanes(t, order).select("job_id", "lane", F.when(F.col("lane") == "__broll", -1).otherwise(F.col("lane_ord")).cast("long").alias("lane_ord"), F.array_join(F.transform("shots", lambda x: x.cast("string")), ",").alias("shots"))


def median_shot(spark: SparkSession, d: str) -> DataFrame:
    t = event_tiles(spark, d).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return shots.upper_median(t, ["job_id"], "duration_ms")


def timeline_ticks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("total_ms"))
    return o.select("o_orderkey", F.array_join(F.transform(time.ticks(F.col("total_ms")), lambda x: x.cast("string")), ",").alias("ticks"))


def locf_context(spark: SparkSession, d: str) -> DataFrame:
    return words.carry_last(event_mentions(spark, d), ["job_id"], ["ord"], "entity_id", "last_entity").select("job_id", "ord", "last_entity")


def running_offset_export(spark: SparkSession, d: str) -> DataFrame:
    t = event_tiles(spark, d).select("job_id", "ord", F.coalesce("entity_id", F.lit("broll")).alias("clip"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    x = timeline_export(t)
    schema = "struct<duration_ms:bigint,items:array<struct<ord:bigint,clip:string,offset_ms:bigint,duration_ms:bigint>>>"
    p = F.from_json("project", schema)
    return x.select("job_id", p.alias("p")).select("job_id", F.col("p.duration_ms").alias("total_ms"), F.explode("p.items").alias("i")).select("job_id", "total_ms", "i.*")


def nearest_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of one reference vector for each label, where it is nearer than 1.2."""
    e = table(spark, d, "embeddings")
    known = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return nearest(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), known, 1.2).select("row_id", "label", F.round("distance", 4).alias("distance"))


def _orders_as_jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), "o_custkey")


def recent_jobs_topk(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recent(_orders_as_jobs(spark, d), 20).select("job_id", "created_at", "status")


def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return jobs.retain(_orders_as_jobs(spark, d), F.lit("1995-01-01").cast("timestamp_ntz")).select("job_id", "created_at")


def log_ring(spark: SparkSession, d: str) -> DataFrame:
    logs = _orders_as_jobs(spark, d).select(F.col("o_custkey").alias("job_id"), F.col("created_at").alias("logged_at"), F.col("job_id").alias("entry"))
    return jobs.last_logs(logs, 5, ("logged_at", "entry"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.status_counts(_orders_as_jobs(spark, d))


def part_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = event_tiles(spark, d).withColumnRenamed("ord", "segment_index")
    return shots.part_chunks(t, 40).groupBy("job_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("segment_index").alias("first"))


def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that break the chain: none."""
    return shots.contiguous(event_tiles(spark, d)).groupBy().agg(F.count(F.lit(1)).alias("broken"))


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") * 100).cast("long").alias("min_named_ms"), F.when(F.col("c_custkey") % 5 == 0, F.lit(3000)).cast("long").alias("min_broll_ms"))
    return jobs.settings(o, {"min_named_ms": 600, "min_broll_ms": 2000})


def register_new(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order, as files that are not registered yet."""
    known = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return jobs.register_new(known, found)


QUERIES = {
    f.__name__: f
    for f in (
        collapse_runs, event_tiles, ceiling_split, merge_adjacent, enforce_floors, segment_timeline, stabbing_join, frame_spans, frame_totals, lane_buckets, median_shot, timeline_ticks, locf_context,
        running_offset_export, nearest_descriptor, recent_jobs_topk, retention_filter, log_ring, status_counts, part_chunks, contiguity_check, settings_merge, register_new,
    )
}
QUERIES["tile_timeline"] = QUERIES.pop("event_tiles")

_FRAME = "CAST(floor({0} / 1000.0 * 30 + 0.5) AS BIGINT)"
_FRAMES = f"greatest(1, {_FRAME.format('coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms), end_ms)')} - {_FRAME.format('start_ms')})"
_CONNECTORS = ", ".join(f"'{w}'" for w in text.CONNECTORS)
_REFERS = " OR ".join(f"regexp_matches(text, '{p}')" for p in text.REFERS_BACK)
_STEP = "CASE " + " ".join(f"WHEN t / {s * 1000.0} <= 12 THEN {s * 1000}" for s in time.TICK_STEPS) + " ELSE 3600000 END"

ORACLE = {
    "collapse_runs": f"WITH {RUNS_SQL} SELECT job_id, ord, start_ms, entity_id FROM runs",
    "tile_timeline": f"WITH {RUNS_SQL} SELECT * FROM tiles",
    "ceiling_split": f"""WITH {RUNS_SQL}, p AS (SELECT *, end_ms - start_ms AS len, CASE WHEN end_ms - start_ms > 86400000 * 1.25 THEN CAST(ceil((end_ms - start_ms) / 86400000.0) AS BIGINT) ELSE 1 END AS parts FROM tiles),
        q AS (SELECT *, unnest(range(parts)) AS part FROM p)
        SELECT job_id, ord, part, start_ms + CAST(floor(CAST(len * part AS DOUBLE) / parts + 0.5) AS BIGINT) AS start_ms, CASE WHEN part = parts - 1 THEN end_ms ELSE start_ms + CAST(floor(CAST(len * (part + 1) AS DOUBLE) / parts + 0.5) AS BIGINT) END AS end_ms FROM q""",
    "enforce_floors": f"""WITH RECURSIVE {MENTIONS_SQL}, s AS (SELECT * REPLACE (start_ms // 360 AS start_ms), lead(event_mentions.start_ms) OVER (PARTITION BY job_id ORDER BY ord) // 360 AS end_ms FROM event_mentions),
        walk AS (SELECT job_id, 1 AS i, list({{'a': start_ms, 'b': end_ms, 'f': ord, 't': ord + 1, 'e': entity_id, 'x': CAST(event_id AS VARCHAR)}} ORDER BY ord) AS r FROM s WHERE end_ms IS NOT NULL GROUP BY job_id
            UNION ALL SELECT job_id, CASE WHEN k IS NULL THEN i + 1 ELSE greatest(1, least(i, k) - 1) END,
                CASE WHEN k IS NULL THEN r ELSE list_concat(r[1:least(i, k) - 1], [{{'a': r[least(i, k)].a, 'b': r[greatest(i, k)].b, 'f': r[least(i, k)].f, 't': r[greatest(i, k)].t, 'e': r[k].e, 'x': trim(r[least(i, k)].x || ' ' || r[greatest(i, k)].x)}}], r[greatest(i, k) + 1:]) END
            FROM (SELECT *, CASE WHEN r[i].b - r[i].a >= CASE WHEN r[i].e IS NULL THEN 20000 ELSE 10000 END THEN NULL
                WHEN i > 1 AND r[i - 1].e IS NOT DISTINCT FROM r[i].e THEN i - 1 WHEN i < len(r) AND r[i + 1].e IS NOT DISTINCT FROM r[i].e THEN i + 1
                WHEN i > 1 AND (r[i].e IS NULL OR r[i - 1].e IS NULL) AND NOT (i < len(r) AND (r[i].e IS NULL OR r[i + 1].e IS NULL) AND r[i + 1].b - r[i + 1].a < r[i - 1].b - r[i - 1].a) THEN i - 1
                WHEN i < len(r) AND (r[i].e IS NULL OR r[i + 1].e IS NULL) THEN i + 1 END AS k FROM walk WHERE i <= len(r) AND len(r) > 1)),
        u AS (SELECT job_id, unnest(r) AS q, unnest(range(len(r))) AS seg_index FROM walk WHERE i > len(r) OR len(r) = 1)
        SELECT job_id, seg_index, q.f AS from_word, q.t AS to_word, CAST(q.a AS BIGINT) AS start_ms, CAST(q.b AS BIGINT) AS end_ms, q.e AS entity_id, q.x AS text FROM u""",
    # each step as a walk: cuts over mentions, floors over segments, splits over parts
    "segment_timeline": f"""WITH RECURSIVE {WORDS_SQL}, names AS (SELECT DISTINCT job_id, norm FROM words WHERE cue_index = 0 AND length(norm) >= 6),
        ends AS (SELECT job_id, max(word_index) + 1 AS n, max(end_ms) + CASE WHEN CAST(job_id AS BIGINT) % 2 = 0 THEN 30000 ELSE 0 END AS total FROM words GROUP BY job_id),
        said AS (SELECT w.*, lag(w.norm) OVER (PARTITION BY w.job_id ORDER BY word_index) AS b FROM words w JOIN names USING (job_id, norm)),
        changes AS (SELECT job_id, word_index AS m, raw AS surface, end_ms AS until, norm AS e, row_number() OVER (PARTITION BY job_id ORDER BY word_index) AS k FROM said WHERE b IS DISTINCT FROM norm),
        clauses AS (SELECT job_id, list({{'i': i, 'c': c}} ORDER BY i) AS l FROM (SELECT job_id, word_index AS i, CASE WHEN regexp_matches(raw, '[,;:—–-]$') THEN word_index + 1 WHEN norm IN ({_CONNECTORS}) THEN word_index END AS c FROM words) WHERE c IS NOT NULL GROUP BY 1),
        cuts AS (SELECT CAST(NULL AS VARCHAR) AS job_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS cut, CAST(NULL AS VARCHAR) AS e, CAST(NULL AS VARCHAR) AS surface, CAST(0 AS BIGINT) AS until
            UNION ALL SELECT c.job_id, c.k, coalesce(list_filter(l, lambda x: x.i >= greatest(cuts.cut + 1, m - 5) AND x.i < m)[-1].c, greatest(cuts.cut + 1, m)), c.e, c.surface, c.until
            FROM cuts JOIN changes c ON (cuts.job_id = c.job_id OR (cuts.job_id IS NULL AND c.k = 1)) AND c.k = cuts.k + 1 LEFT JOIN clauses ON clauses.job_id = c.job_id),
        spans AS (SELECT c.job_id, cut AS a, coalesce(lead(cut) OVER (PARTITION BY c.job_id ORDER BY c.k), n) AS b, e, surface, until FROM cuts c JOIN ends USING (job_id)),
        inside AS (SELECT s.job_id, s.a, s.until, w.word_index, w.raw, w.start_ms, lag(raw) OVER (PARTITION BY s.job_id, s.a ORDER BY word_index) AS r1 FROM spans s JOIN words w ON w.job_id = s.job_id AND w.word_index >= s.a AND w.word_index < s.b),
        flags AS (SELECT *, sum(CASE WHEN r1 IS NULL OR (regexp_matches(r1, '[.!?]["'')\\]]?$') AND NOT regexp_matches(r1, '^[A-Za-z]\\.$')) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, a ORDER BY word_index) AS q FROM inside),
        sent AS (SELECT job_id, a, q, min(word_index) AS f, arg_min(start_ms, word_index) - any_value(until) AS pause, string_agg(raw, ' ' ORDER BY word_index) AS text FROM flags GROUP BY 1, 2, 3),
        hold AS (SELECT job_id, a, min(f) AS h FROM sent WHERE q > 1 AND NOT (pause <= 9000 AND ({_REFERS})) GROUP BY 1, 2),
        rows0 AS (SELECT job_id, a AS f, coalesce(h, b) AS t, e, 'named' AS s, 1.0 AS c, surface AS g FROM spans LEFT JOIN hold USING (job_id, a)
            UNION ALL SELECT job_id, h, b, NULL, 'broll', 0.0, NULL FROM spans JOIN hold USING (job_id, a)
            UNION ALL SELECT job_id, 0, coalesce(min(a), any_value(n)), NULL, 'broll', 0.0, NULL FROM ends LEFT JOIN spans USING (job_id) GROUP BY job_id HAVING coalesce(min(a), any_value(n)) > 0),
        timed AS (SELECT r.*, x.start_ms AS a, y.end_ms AS b FROM rows0 r JOIN words x ON x.job_id = r.job_id AND x.word_index = f JOIN words y ON y.job_id = r.job_id AND y.word_index = t - 1),
        walk AS (SELECT job_id, 1 AS i, list({{'a': a, 'b': b, 'f': f, 't': t, 'e': e, 's': s, 'c': c, 'g': g}} ORDER BY f) AS r FROM timed GROUP BY job_id
            UNION ALL SELECT job_id, CASE WHEN k IS NULL THEN i + 1 ELSE greatest(1, least(i, k) - 1) END,
                CASE WHEN k IS NULL THEN r ELSE list_concat(r[1:least(i, k) - 1], [{{'a': r[least(i, k)].a, 'b': r[greatest(i, k)].b, 'f': r[least(i, k)].f, 't': r[greatest(i, k)].t, 'e': r[k].e, 's': r[k].s, 'c': r[k].c, 'g': r[k].g}}], r[greatest(i, k) + 1:]) END
            FROM (SELECT *, CASE WHEN r[i].b - r[i].a >= CASE WHEN r[i].e IS NULL THEN 2000 ELSE 600 END THEN NULL
                WHEN i > 1 AND r[i - 1].e IS NOT DISTINCT FROM r[i].e THEN i - 1 WHEN i < len(r) AND r[i + 1].e IS NOT DISTINCT FROM r[i].e THEN i + 1
                WHEN i > 1 AND (r[i].e IS NULL OR r[i - 1].e IS NULL) AND NOT (i < len(r) AND (r[i].e IS NULL OR r[i + 1].e IS NULL) AND r[i + 1].b - r[i + 1].a < r[i - 1].b - r[i - 1].a) THEN i - 1
                WHEN i < len(r) AND (r[i].e IS NULL OR r[i + 1].e IS NULL) THEN i + 1 END AS k FROM walk WHERE i <= len(r) AND len(r) > 1)),
        floored AS (SELECT job_id, unnest(r) AS q FROM walk WHERE i > len(r) OR len(r) = 1),
        segs AS (SELECT job_id, q.a AS a, q.b AS b, q.f AS f, q.t AS t, q.e AS e, q.s AS s, q.c AS c, q.g AS g, CAST(ceil((q.b - q.a) / 7000.0) AS BIGINT) AS parts FROM floored),
        split AS (SELECT job_id, f AS seg, f, t, a, b - a AS len, CASE WHEN b - a > 7000 AND t - f >= 4 THEN parts ELSE 1 END AS parts, CAST(0 AS BIGINT) AS p FROM segs
            UNION ALL SELECT x.job_id, seg, greatest(x.f + 1, least(coalesce(first(word_index ORDER BY abs(w.start_ms - (x.a + x.len / x.parts * (p + 1))), word_index), x.f + 1), x.t)), x.t, x.a, x.len, x.parts, p + 1
            FROM split x LEFT JOIN words w ON w.job_id = x.job_id AND w.word_index > x.f AND w.word_index < x.t WHERE p < x.parts - 1 AND x.f < x.t GROUP BY x.job_id, seg, x.f, x.t, x.a, x.len, x.parts, p),
        parts AS (SELECT x.job_id, x.f, coalesce(lead(x.f) OVER (PARTITION BY x.job_id ORDER BY x.f), x.t) AS t, w.start_ms AS a, s.b, s.e, s.s, s.c, CASE WHEN p = 0 THEN s.g END AS g
            FROM split x JOIN segs s ON s.job_id = x.job_id AND s.f = x.seg JOIN words w ON w.job_id = x.job_id AND w.word_index = x.f WHERE x.f < x.t),
        tiled AS (SELECT p.* EXCLUDE (a, b), CASE WHEN row_number() OVER o = 1 THEN 0 ELSE a END AS a, coalesce(lead(a) OVER o, greatest(total, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE a END + 1)) AS b FROM parts p JOIN ends USING (job_id) WINDOW o AS (PARTITION BY p.job_id ORDER BY a, f)),
        again AS (SELECT *, CASE WHEN b - a > 8750 THEN CAST(ceil((b - a) / 7000.0) AS BIGINT) ELSE 1 END AS n FROM tiled), cut AS (SELECT *, unnest(range(n)) AS p FROM again),
        timeline AS (SELECT job_id, f, t, e, s, c, p, CASE WHEN p = 0 THEN g END AS g, a + CAST(floor((b - a) * p / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS x, CASE WHEN p = n - 1 THEN b ELSE a + CAST(floor((b - a) * (p + 1) / CAST(n AS DOUBLE) + 0.5) AS BIGINT) END AS y FROM cut),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY x, f, p) - 1 AS seg_index FROM timeline),
        texts AS (SELECT r.job_id, r.f, string_agg(raw, ' ' ORDER BY word_index) AS text FROM tiled r JOIN words w ON w.job_id = r.job_id AND w.word_index >= r.f AND w.word_index < r.t GROUP BY 1, 2)
        SELECT job_id, seg_index, CAST(x AS BIGINT) AS start_ms, CAST(y AS BIGINT) AS end_ms, CAST(y - x AS BIGINT) AS duration_ms, e AS entity_id, s AS source, CAST(c AS DOUBLE) AS confidence, CASE WHEN p = 0 THEN text ELSE '' END AS text,
            CAST(f AS BIGINT) AS from_word, CAST(t AS BIGINT) AS to_word, g AS trigger_surface FROM numbered JOIN texts USING (job_id, f) WHERE y > x""",
    "merge_adjacent": f"""WITH {MENTIONS_SQL}, s AS (SELECT *, lead(start_ms) OVER o AS end_ms, lag(entity_id) OVER o AS b, row_number() OVER o AS rn FROM event_mentions WINDOW o AS (PARTITION BY job_id ORDER BY ord)),
        r AS (SELECT *, sum(CASE WHEN rn = 1 OR b IS DISTINCT FROM entity_id THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord) AS run FROM s WHERE end_ms IS NOT NULL)
        SELECT job_id, min(ord) AS from_word, max(ord) + 1 AS to_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(end_ms) - min(start_ms) AS duration_ms, any_value(entity_id) AS entity_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ord) AS text FROM r GROUP BY job_id, run""",
    "stabbing_join": f"WITH {RUNS_SQL} SELECT m.job_id, m.event_id, t.entity_id, t.start_ms FROM event_mentions m JOIN tiles t ON m.job_id = t.job_id AND m.start_ms >= t.start_ms AND m.start_ms < t.end_ms",
    "frame_spans": f"WITH {RUNS_SQL} SELECT job_id, ord, {_FRAMES} AS frames FROM tiles",
    "frame_totals": f"""WITH {RUNS_SQL}, f AS (SELECT *, {_FRAMES} AS frames FROM tiles), t AS (SELECT job_id, CAST(sum(frames) AS BIGINT) AS frames, max(end_ms) AS total_ms FROM f GROUP BY 1)
        SELECT *, abs(frames * CAST(1000 AS DOUBLE) / 30 - total_ms) <= 50.0 AS sound FROM t""",
    "lane_buckets": f"""WITH {RUNS_SQL} SELECT job_id, coalesce(entity_id, '__broll') AS lane, CASE WHEN any_value(entity_id) IS NULL THEN -1 ELSE min(ord) END AS lane_ord, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS shots FROM tiles GROUP BY job_id, entity_id""",
    "median_shot": f"""WITH {RUNS_SQL}, d AS (SELECT job_id, end_ms - start_ms AS median, row_number() OVER (PARTITION BY job_id ORDER BY end_ms - start_ms) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n FROM tiles)
        SELECT job_id, median FROM d WHERE k = n // 2""",
    "timeline_ticks": f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders), s AS (SELECT *, {_STEP} AS step FROM o)
        SELECT o_orderkey, array_to_string(list_transform(range(CAST(floor((t - step * 0.4) / step) AS BIGINT) + 1), lambda k: CAST(k * step AS VARCHAR)), ',') AS ticks FROM s""",
    "locf_context": f"WITH {MENTIONS_SQL} SELECT job_id, ord, last_value(entity_id IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_entity FROM event_mentions",
    "running_offset_export": f"""WITH {RUNS_SQL} SELECT job_id, CAST(sum(end_ms - start_ms) OVER (PARTITION BY job_id) AS BIGINT) AS total_ms, ord, coalesce(entity_id, 'broll') AS clip,
        CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms, end_ms - start_ms AS duration_ms FROM tiles""",
    "nearest_descriptor": """WITH k AS (SELECT label, arg_min(embedding, vec_id) AS k FROM embeddings GROUP BY 1),
        d AS (SELECT vec_id AS row_id, k.label, sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: power(CAST(embedding[i] AS DOUBLE) - CAST(k[i] AS DOUBLE), 2)))) AS distance FROM embeddings, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, label) AS rn FROM d)
        SELECT row_id, label, round(distance, 4) AS distance FROM r WHERE rn = 1 AND distance < 1.2""",
    "recent_jobs_topk": "SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "retention_filter": "SELECT o_orderkey AS job_id, o_orderdate AS created_at FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'",
    "log_ring": "WITH r AS (SELECT o_custkey AS job_id, o_orderdate AS logged_at, o_orderkey AS entry, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT job_id, logged_at, entry FROM r WHERE rn <= 5",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "part_chunks": f"WITH {RUNS_SQL}, c AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1) // 40 AS chunk FROM tiles) SELECT job_id, chunk, count(*) AS n, min(ord) AS first FROM c GROUP BY 1, 2",
    "contiguity_check": f"WITH {RUNS_SQL}, n AS (SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, ord) AS before FROM tiles) SELECT count(*) FILTER (start_ms <> before) AS broken FROM n",
    "settings_merge": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey * 100 AS BIGINT) ELSE 600 END AS min_named_ms, CASE WHEN c_custkey % 5 = 0 THEN 3000 ELSE 2000 END AS min_broll_ms FROM customer",
    "register_new": "SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
}
