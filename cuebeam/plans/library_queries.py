"""Queries on names, aliases, claims, repairs and changes by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebeam.functions import names, text
from cuebeam.operators import cues, jobs, mentions, script, shots
from cuebeam.plans import text_queries
from cuebeam.plans.binding import CLIPS_SQL, MENTIONS_SQL, event_mentions, table
from cuebeam.plans.plan_queries import _POOLS, LIBRARY_PARTS, _clips, _job_clips, _pooled, _shots
from cuebeam.sources import files
from cuebeam.staging import scratch


def osa_distance(spark: SparkSession, d: str) -> DataFrame:
    p = text_queries.edit_budget_blocked_pairs(spark, d)
    return p.select("a", "b", names.osa_distance_udf(F.col("a"), F.col("b")).cast("long").alias("distance"))


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that name the same by their spelling alone."""
    p = text_queries.edit_budget_blocked_pairs(spark, d).withColumn("s", names.similarity_udf(F.col("a"), F.col("b")))
    return p.filter("s.match and s.reason <> 'phonetic'").select("a", "b", "s.score", "s.reason")


def cue_repair(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as cues, three at a time, some without a duration."""
    start = F.floor(F.col("ord") / 3).cast("long") * 1000
    e = event_mentions(spark, d).select("job_id", F.col("ord").alias("line"), start.alias("start_ms"), (start + F.col("event_id") % 5 * 700).alias("end_ms"), F.element_at(F.array(*map(F.lit, ("a", "b c", "d e f"))), (F.col("event_id") % 3 + 1).cast("int")).alias("text"))
    return cues.repair(e)


def expand_aliases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(mentions.expand_aliases(F.array("p_brand", "p_type", F.lit("the")), F.col("p_name")), "|").alias("aliases"))


def observe(spark: SparkSession, d: str) -> DataFrame:
    """Users' event types as entities, one more that nobody names; an event is written like its value's last digit."""
    e = event_mentions(spark, d).filter("entity_id is not null").withColumn("digit", F.floor(F.col("value") * 10).cast("long") % 10)
    nobody = e.select("job_id", F.lit("nobody").alias("entity_id")).distinct()
    entities = e.select("job_id", "entity_id").distinct().unionByName(nobody).withColumn("canonical", F.when(F.col("entity_id") == "purchase", "purchase made").otherwise(F.initcap("entity_id")))
    seen = mentions.observe(entities, e.select("job_id", "entity_id", F.concat("entity_id", "digit").alias("surface"), F.col("ord").alias("word_index")))
    return seen.select("job_id", "entity_id", "canonical", "mention_count", F.array_join(F.transform("variants", lambda v: F.concat_ws(":", v["text"], v["count"])), ",").alias("variants"))


def bind_clips(spark: SparkSession, d: str) -> DataFrame:
    """Parts claimed by every second brand, and over it by one type."""
    c = _clips(spark, d).withColumnRenamed("library", "job_id")
    number = F.substring("p_brand", 7, 9).cast("long")
    brands = c.filter(number % 2 == 0).groupBy("job_id", F.col("p_brand").alias("entity_id"), number.alias("entity_ord")).agg(F.collect_list("clip_id").alias("clip_ids"))
    types = c.filter("p_type = 'ECONOMY'").groupBy("job_id", F.col("p_type").alias("entity_id")).agg(F.collect_list("clip_id").alias("clip_ids")).withColumn("entity_ord", F.lit(1000).cast("long"))
    return mentions.bind_clips(c, brands.unionByName(types)).select("job_id", "clip_id", F.array_join("entity_ids", "|").alias("entities"))


def resolve_tags(spark: SparkSession, d: str) -> DataFrame:
    """Terms for the parts' names, with tags that are a name, a word of one, or the beginning of one."""
    p = table(spark, d, "part")
    terms = script.alias_terms(p.select(F.col("p_partkey").alias("name_ord"), F.concat_ws(" ", "p_name", F.expr("p_partkey % 10")).alias("name"), F.lit("").alias("role")))
    word = F.element_at(F.split("p_name", " "), -1)
    tag = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" 3"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), word)).otherwise(F.expr("substr(p_name, 2, 6)"))
    return script.resolve_tags(terms, p.select(tag.alias("tag"), F.col("p_partkey").alias("tag_ord")))


def plan_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Users' plans, and jobs named after nations that have no clips."""
    s = _shots(spark, d).withColumn("entity_name", F.lit(None).cast("string"))
    every = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id")).distinct().unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("job_id")))
    return shots.plan_warnings(s, _job_clips(spark, d), every)


def replace_clip(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth event's shot gets the first clip of the library by hand."""
    clips = _job_clips(spark, d)
    p = shots.use_ordinal(shots.assign_round_robin(*_pooled(spark, d)))
    rows = p.join(clips.select("job_id", "clip_id", F.col("filename").alias("clip_filename"), F.col("duration_ms").alias("available")), ["job_id", "clip_id"])
    rows = rows.withColumn("f", shots.fit_source(F.col("available"), F.col("duration_ms"), F.col("uses")))
    planned = rows.select("job_id", F.col("seg_index").alias("segment_index"), "duration_ms", "clip_id", "clip_filename", F.col("f.in_ms").alias("source_in_ms"), F.col("f.out_ms").alias("source_out_ms"), "f.fit_mode", "f.loops", F.lit("planned").alias("reason"))
    first = clips.groupBy("job_id").agg(F.min_by("clip_id", "clip_ord").alias("clip_id"))
    return shots.replace_clip(planned, planned.filter("segment_index % 4 = 0").select("job_id", "segment_index").join(first, "job_id"), clips)


def job_summary(spark: SparkSession, d: str) -> DataFrame:
    """Customers as jobs with their orders' priorities as clips and their orders as shots, done with an order that is."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("clips"), F.collect_list("o_orderkey").alias("shots"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("output"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    rows = c.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("stage"), F.col("c_custkey").alias("created_at"), none("clips").alias("clips"), none(F.col("shots").cast("array<string>")).alias("shots"), "output")
    return jobs.summary(rows).withColumns({c: F.col(c).cast("long") for c in ("clips", "shots")})


def admit_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as uploaded files, some of them of no admitted type or with forbidden characters."""
    ending = F.element_at(F.array(*map(F.lit, (".mp4", ".MP3", ".srt", ".exe", "", ".vtt"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, d, "part").select(F.concat(F.lit("..up/"), F.regexp_replace("p_name", " ", ":"), F.col("p_partkey") % 50, ending).alias("name"), (F.col("p_size") % 2).alias("size"))
    return files.admit(p).select("name", "size", "kind", "safe_name")


def declared_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Nations as jobs that declare their customers: some too many, some with names that are too long."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("job_id"), F.col("c_custkey").alias("name_ord"), F.expr("repeat(c_name, int(c_custkey % 6))").alias("name"))
    return mentions.declared_bounds(c)


def known_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a type that the user's even events have, too."""
    e = event_mentions(spark, d).select("job_id", "entity_id", "event_id")
    return mentions.known_mentions(e, e.filter("event_id % 8 = 0").select("job_id", "entity_id"))


def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders as job manifests with their lines as clips, written as JSON and read again."""
    line = F.struct(F.concat(F.lit("c"), "l_linenumber").alias("clip_id"), F.col("l_returnflag").alias("filename"), F.col("l_partkey").cast("string").alias("key"), (F.col("l_quantity") * 100).cast("long").alias("duration_ms"))
    clips = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("clips"))
    o = table(spark, d, "orders").join(clips, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    path = scratch(spark, "manifests")
    files.write_manifests(o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("stage"), F.col("o_custkey").alias("created_at"), "clips"), path)
    read = files.read_manifests(spark, path, lines=True)
    return read.select("job_id", "name", "stage", "created_at", F.coalesce(F.size("clips"), F.lit(0)).cast("long").alias("clips"), F.coalesce(F.aggregate("clips", F.lit(0).cast("long"), lambda n, c: n + c["duration_ms"]), F.lit(0)).alias("duration_ms"), F.col("output").isNull().alias("open"))


def project_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers inserted into a table, every tenth and all suppliers put in or replaced, and a nation's deleted."""
    t = files.Table(spark, scratch(spark, "projects"), "id string, name string, n long")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("n"))
    t.insert(c)
    more = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("n"))
    t.upsert(c.filter("id like '%0'").withColumns({"name": F.upper("name"), "n": F.col("n") + 1}).unionByName(more), "id")
    t.delete(n=3)
    return t.select()


QUERIES = {f.__name__: f for f in (declared_bounds, known_mentions, manifest_roundtrip, project_table, osa_distance, name_similarity, cue_repair, expand_aliases, observe, bind_clips, resolve_tags, plan_warnings, replace_clip, job_summary, admit_files)}

# edit distance with swaps of neighbours, a cell at a time: two rows before, the row before, and this one so far
_CELL = "least(pr[len(cu) + 1] + 1, cu[len(cu)] + 1, pr[len(cu)] + CAST(a[i] <> b[len(cu)] AS INT), CASE WHEN i > 1 AND len(cu) > 1 AND a[i] = b[len(cu) - 1] AND a[i - 1] = b[len(cu)] THEN pp[len(cu) - 1] + 1 ELSE 99 END)"
_DISTANCES = f"""pairs AS ({text_queries.ORACLE['edit_budget_blocked_pairs']}),
    cells AS (SELECT a, b, budget, 1 AS i, CAST([] AS BIGINT[]) AS pp, range(length(b) + 1) AS pr, CAST([1] AS BIGINT[]) AS cu FROM pairs
        UNION ALL SELECT a, b, budget, CASE WHEN len(cu) > length(b) THEN i + 1 ELSE i END, CASE WHEN len(cu) > length(b) THEN pr ELSE pp END, CASE WHEN len(cu) > length(b) THEN cu ELSE pr END,
            CASE WHEN len(cu) > length(b) THEN CAST([i + 1] AS BIGINT[]) ELSE list_append(cu, {_CELL}) END FROM cells WHERE i < length(a) OR len(cu) <= length(b)),
    far AS (SELECT a, b, budget, cu[-1] AS distance FROM cells WHERE i = length(a) AND len(cu) > length(b))"""
_STEM = "regexp_replace(regexp_replace({0}, '(''s|s'')$', ''), 's$', '')"
_FIT = "CASE WHEN {0} >= duration_ms THEN 'trim' WHEN {0} < 400 THEN 'stretch' ELSE 'loop' END"
_LOOPS = "CAST(CASE WHEN {0} < duration_ms AND {0} >= 400 THEN least(6, ceil(CAST(duration_ms AS DOUBLE) / {0})) ELSE 1 END AS BIGINT)"

ORACLE = {
    "declared_bounds": """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS job_id, count(*) AS names, CAST(max(length(repeat(c_name, CAST(c_custkey % 6 AS INTEGER)))) AS BIGINT) AS longest FROM customer GROUP BY 1)
        SELECT *, names <= 60 AND longest <= 80 AS admitted FROM c""",
    "known_mentions": f"""WITH {MENTIONS_SQL} SELECT job_id, entity_id, event_id FROM event_mentions e
        WHERE EXISTS (SELECT 1 FROM event_mentions k WHERE k.event_id % 8 = 0 AND k.job_id = e.job_id AND k.entity_id = e.entity_id)""",
    "manifest_roundtrip": """WITH l AS (SELECT l_orderkey, count(*) AS clips, CAST(sum(CAST(l_quantity * 100 AS BIGINT)) AS BIGINT) AS duration_ms FROM lineitem GROUP BY 1)
        SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS name, o_orderstatus AS stage, o_custkey AS created_at, coalesce(clips, 0) AS clips, coalesce(duration_ms, 0) AS duration_ms, true AS open FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "project_table": """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS name, CAST(c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM customer
        WHERE c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END <> 3 UNION ALL SELECT 's' || s_suppkey, s_name, CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_nationkey <> 3""",
    "osa_distance": f"WITH RECURSIVE {_DISTANCES} SELECT a, b, distance FROM far",
    "name_similarity": f"""WITH RECURSIVE {_DISTANCES}, s AS (SELECT *, {_STEM.format('a')} = {_STEM.format('b')} AS stem FROM far)
        SELECT a, b, CASE WHEN stem THEN 0.98 ELSE 1 - CAST(distance AS DOUBLE) / (greatest(length(a), length(b)) + 1) END AS score, CASE WHEN stem THEN 'exact' ELSE 'edit' END AS reason FROM s WHERE stem OR distance <= budget""",
    "cue_repair": f"""WITH RECURSIVE {MENTIONS_SQL}, c AS (SELECT job_id, ord, ord // 3 * 1000 AS s, ord // 3 * 1000 + event_id % 5 * 700 AS said, ['a', 'b c', 'd e f'][event_id % 3 + 1] AS text, event_id % 3 + 1 AS n FROM event_mentions),
        d AS (SELECT *, CASE WHEN said <= s THEN s + greatest(400, 300 * n) ELSE said END AS e, row_number() OVER (PARTITION BY job_id ORDER BY s, said, ord) - 1 AS k FROM c),
        walk AS (SELECT job_id, k, s, said, e, text, s AS a, e AS b, false AS hit, false AS cut FROM d WHERE k = 0
            UNION ALL SELECT d.job_id, d.k, d.s, d.said, d.e, d.text, CASE WHEN d.s < b AND d.s <= a THEN b ELSE d.s END, CASE WHEN d.s < b AND d.s <= a AND d.e <= b THEN b + 400 ELSE d.e END, d.s < b, d.s < b AND d.s > a
            FROM walk JOIN d ON d.job_id = walk.job_id AND d.k = walk.k + 1)
        SELECT job_id, 'cue' AS kind, k AS cue_index, CAST(a AS BIGINT) AS start_ms, CAST(CASE WHEN lead(cut) OVER o THEN lead(a) OVER o ELSE b END AS BIGINT) AS end_ms, text FROM walk WINDOW o AS (PARTITION BY job_id ORDER BY k)
        UNION ALL SELECT job_id, 'warning', k, NULL, NULL, 'A cue at ' || ((s + 500) // 1000) || 's had no duration - estimated ' || (e - s) || 'ms.' FROM walk WHERE said <= s
        UNION ALL SELECT job_id, 'warning', k, NULL, NULL, 'Overlapping cues near ' || ((a + 500) // 1000) || 's - trimmed to remove the overlap.' FROM walk WHERE hit""",
    "expand_aliases": f"""WITH p AS (SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS type, lower(trim(p_name)) AS name, string_split(lower(trim(p_name)), ' ') AS w FROM part),
        l AS (SELECT p_partkey, list_concat([brand, type, 'the', name], CASE WHEN len(w) > 1 THEN [w[1], w[-1], array_to_string(list_transform(w, lambda x: x[1]), '')] ELSE [] END) AS a FROM p),
        u AS (SELECT p_partkey, unnest(a) AS x, unnest(range(len(a))) AS i FROM l),
        k AS (SELECT p_partkey, x, min(i) AS i FROM u WHERE length(x) >= 2 AND x NOT IN ({text_queries._in(text.COMMON_WORDS)}) GROUP BY 1, 2)
        SELECT p_partkey, string_agg(x, '|' ORDER BY len(string_split(x, ' ')) DESC, length(x) DESC, i) AS aliases FROM k GROUP BY 1""",
    "observe": f"""WITH {MENTIONS_SQL}, e AS (SELECT job_id, entity_id, entity_id || (CAST(floor(value * 10) AS BIGINT) % 10) AS surface, ord FROM event_mentions WHERE entity_id IS NOT NULL),
        s AS (SELECT job_id, entity_id, surface, count(*) AS n, min(ord) AS first FROM e GROUP BY ALL),
        v AS (SELECT job_id, entity_id, CAST(sum(n) AS BIGINT) AS mention_count, string_agg(surface || ':' || n, ',' ORDER BY n DESC, first) AS variants, list(surface ORDER BY n DESC, first)[1] AS top, max(n) AS most FROM s GROUP BY 1, 2)
        SELECT job_id, entity_id, CASE WHEN entity_id = 'purchase' THEN 'purchase made' WHEN most >= 2 THEN top ELSE upper(entity_id[1]) || entity_id[2:] END AS canonical, mention_count, variants FROM v
        UNION ALL SELECT DISTINCT job_id, 'nobody', 'Nobody', 0, '' FROM e""",
    "bind_clips": f"""WITH {CLIPS_SQL} SELECT clip_ord % (SELECT greatest(1, count(*) // {LIBRARY_PARTS}) FROM part) AS job_id, clip_id,
        CASE WHEN p_type = 'ECONOMY' THEN p_type WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN p_brand ELSE '' END AS entities FROM clips""",
    "resolve_tags": """WITH p AS (SELECT p_partkey AS o, upper(p_name || ' ' || (p_partkey % 10)) AS name, p_name, p_partkey % 3 AS m FROM part), w AS (SELECT *, string_split(name, ' ') AS w FROM p),
        t AS (SELECT arg_max(name, o) AS name, term FROM (SELECT o, name, unnest([name, w[1], w[-1], array_to_string(list_transform(w, lambda x: x[1]), '')]) AS term FROM w) GROUP BY term),
        g AS (SELECT tag, min(o) AS tag_ord FROM (SELECT o, trim(upper(CASE m WHEN 0 THEN p_name || ' 3' WHEN 1 THEN string_split(p_name, ' ')[-1] ELSE substr(p_name, 2, 6) END)) AS tag FROM p) GROUP BY tag)
        SELECT term, coalesce(max(tag) FILTER (tag = name), arg_min(tag, tag_ord)) AS tag FROM t JOIN g ON contains(tag, name) OR contains(name, tag) GROUP BY term""",
    "plan_warnings": f"""WITH {_POOLS}, u AS (SELECT job_id, clip_id, count(*) AS n FROM turns GROUP BY 1, 2), s AS (SELECT job_id, count(*) AS shots FROM turns GROUP BY 1)
        SELECT 'n' || n_nationkey AS job_id, 'No clips were provided, so there is nothing to build a video from.' AS warning FROM nation
        UNION ALL SELECT DISTINCT job_id, 'No clip is tagged for "' || entity_id || '" - those moments fall back to b-roll.' FROM turns WHERE pool_kind = 'fallback'
        UNION ALL SELECT job_id, '"' || filename || '" is used ' || n || ' times. Add more clips for that character to reduce repetition.' FROM u JOIN s USING (job_id) JOIN lib USING (clip_id) WHERE n > greatest(6, shots / 3.0)""",
    "replace_clip": f"""WITH {_POOLS}, x AS (SELECT u.*, l.filename, f.clip_id AS by_hand, f.filename AS hand_file, f.duration_ms AS hand_ms, seg_index % 4 = 0 AS changed FROM used u JOIN lib l USING (clip_id) JOIN every v ON v.library = u.library JOIN lib f ON f.clip_id = v.pool[1]),
        m AS (SELECT *, available - duration_ms AS slack, CASE WHEN available - duration_ms > 250 THEN (uses * greatest(500, (available - duration_ms) // 4)) % (available - duration_ms + 1) ELSE 0 END AS moved FROM x)
        SELECT job_id, seg_index AS segment_index, duration_ms, 'planned' AS reason, clip_id, filename AS clip_filename, CAST(CASE WHEN slack >= 0 THEN moved ELSE 0 END AS BIGINT) AS source_in_ms,
            CAST(CASE WHEN slack >= 0 THEN moved + duration_ms ELSE available END AS BIGINT) AS source_out_ms, {_FIT.format('available')} AS fit_mode, {_LOOPS.format('available')} AS loops FROM m WHERE NOT changed
        UNION ALL SELECT job_id, seg_index, duration_ms, 'chosen by hand', by_hand, hand_file, 0, least(duration_ms, hand_ms), {_FIT.format('hand_ms')}, {_LOOPS.format('hand_ms')} FROM m WHERE changed""",
    "job_summary": """SELECT c_custkey AS job_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS stage, c_custkey AS created_at, count(DISTINCT o_orderpriority) AS clips, count(o_orderkey) AS shots, coalesce(bool_or(o_orderstatus = 'F'), false) AS done
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "admit_files": """WITH p AS (SELECT DISTINCT '..up/' || replace(p_name, ' ', ':') || (p_partkey % 50) || ['.mp4', '.MP3', '.srt', '.exe', '', '.vtt'][p_partkey % 6 + 1] AS name, p_size % 2 AS size, ['video', 'audio', 'subtitle', NULL, NULL, 'subtitle'][p_partkey % 6 + 1] AS kind FROM part)
        SELECT name, size, kind, replace(name[6:], ':', '_') AS safe_name FROM p WHERE kind IS NOT NULL""",
}
