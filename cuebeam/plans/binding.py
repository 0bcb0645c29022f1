"""How the general tables are read as timelines, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebeam.operators.words import utterance_cues, word_timeline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("job_id"), F.col("turn").alias("ord"), "text")
    return utterance_cues(t)


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_timeline(conversation_cues(spark, sf_dir))


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions: a user is a job, a type an entity (errors name nobody), times in ms from the user's first."""
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    w = Window.partitionBy("user_id")
    order = w.orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), (F.row_number().over(order) - 1).cast("long").alias("ord"), (ms - F.min(ms).over(w)).alias("start_ms"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("entity_id"), "event_id", "value",
    )


def part_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clips of one library: `small_ring_01.mp4`, a tenth of a second for each unit of size, bound by brand."""
    p = table(spark, sf_dir, "part")
    number = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    return p.select(
        F.col("p_partkey").alias("clip_ord"), F.col("p_partkey").cast("string").alias("clip_id"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), number, F.lit(".mp4")).alias("filename"),
        (F.col("p_size") * 100).cast("long").alias("duration_ms"), "p_brand", "p_type", "p_name",
    )


# the same in SQL

SPACE = "[\\s ﻿]"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda x: x <> '')"


def sql_norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[‘’]', '''', 'g'), '[^a-z0-9'']', '', 'g'), '^''+|''+$', '', 'g')"


def sql_weight(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z0-9'']', '', 'g')"
    return (
        f"CASE WHEN {letters} = '' THEN 50 ELSE greatest(1, len(regexp_extract_all({letters}, '[aeiouy]+'))) * 100 "
        f"+ len(regexp_extract_all({letters}, '[0-9]')) * 80 + length({letters}) * 12 END"
    )


CUES_SQL = f"""
    cue_tokens AS (SELECT CAST(conv_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_index, text, {sql_tokens('text')} AS toks FROM conversations),
    cues AS (SELECT job_id, cue_index, text, toks, len(toks) * 10000 // 29 AS span,
        CAST(coalesce(sum(len(toks) * 10000 // 29 + 450) OVER before, 0) AS BIGINT) AS start_ms,
        CAST(coalesce(sum(len(toks)) OVER before, 0) AS BIGINT) AS first_word FROM cue_tokens
        WINDOW before AS (PARTITION BY job_id ORDER BY cue_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

WORDS_SQL = (
    CUES_SQL
    + f""",
    cue_words AS (SELECT job_id, cue_index, start_ms AS base, span, first_word, unnest(toks) AS raw, unnest(range(len(toks))) AS pos FROM cues),
    weighed AS (SELECT *, {sql_weight('raw')} AS w FROM cue_words),
    summed AS (SELECT *, sum(w) OVER (PARTITION BY job_id, cue_index ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY job_id, cue_index) AS whole FROM weighed),
    words AS (SELECT job_id, CAST(first_word + pos AS BIGINT) AS word_index, CAST(cue_index AS BIGINT) AS cue_index, {sql_norm('raw')} AS norm, raw,
        CAST(base + (2 * (upto - w) * span + whole) // (2 * whole) AS BIGINT) AS start_ms,
        CAST(greatest(base + (2 * upto * span + whole) // (2 * whole), base + (2 * (upto - w) * span + whole) // (2 * whole) + 1) AS BIGINT) AS end_ms FROM summed)"""
)

SENTENCES_SQL = (
    WORDS_SQL
    + r""",
    flagged AS (SELECT *, coalesce(regexp_matches(lag(raw) OVER o, '[.!?]["'')\]]?$') AND NOT regexp_matches(lag(raw) OVER o, '^[A-Za-z]\.$'), true) AS starts FROM words WINDOW o AS (PARTITION BY job_id ORDER BY word_index)),
    numbered AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY job_id ORDER BY word_index) AS s FROM flagged),
    sentences AS (SELECT job_id, min(word_index) AS from_word, max(word_index) + 1 AS to_word, min(start_ms) AS start_ms, arg_max(end_ms, word_index) AS end_ms, string_agg(raw, ' ' ORDER BY word_index) AS text FROM numbered GROUP BY job_id, s)"""
)

MENTIONS_SQL = """
    event_mentions AS (SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
        epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS start_ms,
        CASE WHEN event_type <> 'error' THEN event_type END AS entity_id, event_id, value FROM events)"""

RUNS_SQL = (
    MENTIONS_SQL
    + """,
    runs AS (SELECT * FROM (SELECT *, lag(entity_id) OVER o AS b, row_number() OVER o AS rn FROM event_mentions WINDOW o AS (PARTITION BY job_id ORDER BY ord)) WHERE rn = 1 OR b IS DISTINCT FROM entity_id),
    tiles AS (SELECT job_id, ord, entity_id, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE start_ms END AS start_ms,
        coalesce(lead(start_ms) OVER o, greatest(total, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE start_ms END + 1)) AS end_ms
        FROM runs JOIN (SELECT job_id, max(start_ms) + 5000 AS total FROM event_mentions GROUP BY job_id) USING (job_id) WINDOW o AS (PARTITION BY job_id ORDER BY start_ms, ord))"""
)

CLIPS_SQL = """
    clips AS (SELECT p_partkey AS clip_ord, CAST(p_partkey AS VARCHAR) AS clip_id, replace(p_name, ' ', '_') || '_' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '.mp4' AS filename,
        CAST(p_size * 100 AS BIGINT) AS duration_ms, p_brand, p_type, p_name FROM part)"""
