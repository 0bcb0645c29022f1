"""Queries on tokens, subtitles, names and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebeam.functions import names, text, time
from cuebeam.operators import cues as cue_ops
from cuebeam.operators import mentions, script, words
from cuebeam.staging import stage
from cuebeam.plans.binding import (
    CLIPS_SQL, CUES_SQL, MENTIONS_SQL, SENTENCES_SQL, WORDS_SQL, conversation_cues, conversation_words, event_mentions, part_clips, sql_norm, sql_tokens, sql_weight, table,
)


def _in(words_: object) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words_))


def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    # empty tokens are left out as rows: leaving them out of each array would copy it
    t = table(spark, d, "documents").select(F.explode(F.split("text", text.SPACE + "+")).alias("raw")).filter("raw <> ''")
    # each different token is normalized once
    return t.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).groupBy(text.normalize_word(F.col("raw")).alias("norm")).agg(F.sum("n").alias("n"))


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """The documents as one cue each, in words with times."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.lit(0).alias("ord"), "text")
    return words.word_timeline(words.utterance_cues(docs)).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_ms").alias("starts"), F.max("end_ms").alias("last_ms"))


def clean_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.clean_cue_text(F.col("html")).alias("text"))


def parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = event_mentions(spark, d).select("event_id", time.format_timestamp(F.col("start_ms")).alias("stamp"), "start_ms")
    return e.select("event_id", "stamp", time.parse_timestamp(F.col("stamp")).alias("parsed"), time.format_clock(F.col("start_ms")).alias("clock"), time.to_seconds(F.col("start_ms")).alias("seconds"))


def format_units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n = F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 7).cast("long")
    return o.select("o_orderkey", time.format_bytes(n).alias("bytes"), time.format_duration(n % 9_000_000).alias("duration"))


def srt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    cues, _ = cue_ops.parse_subtitles(cue_ops.render_srt(conversation_cues(spark, d)))
    return cues.select("job_id", "cue_index", "start_ms", "end_ms", "text")


def messy_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """Cues of untidy files, read by the table function parse_srt in SQL: a mark and a header, carriage returns, settings beside times, timings that can't be read, styles, a number alone at the end."""
    tidy = cue_ops.render_srt(conversation_cues(spark, d))
    dirt = F.regexp_replace(F.regexp_replace("text", r"( --> [0-9:,]+)\n", "$1 align:start line:90%\n{\\\\an8}- <i>"), "\n\n", "</i>\n \n\nnever --> ever\n12\n\n\n")
    cue_ops.register(spark)
    tidy.select("job_id", F.concat(F.lit("\ufeffWEBVTT\n\n"), F.regexp_replace(dirt, "\n", "\r\n"), F.lit("\r\n\r\n77")).alias("text")).createOrReplaceTempView("untidy_files")
    return spark.sql("SELECT f.job_id, c.cue_index, c.start_ms, c.end_ms, c.text FROM untidy_files f, LATERAL parse_srt(f.text) c")


def cue_repair_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = event_mentions(spark, d).select("job_id", F.col("ord").alias("cue_index"), "start_ms", (F.col("start_ms") + 1 + F.floor(F.col("value") * 1000).cast("long")).alias("end_ms"))
    return cue_ops.trim_overlaps(e)


def sentence_islands(spark: SparkSession, d: str) -> DataFrame:
    return words.sentences(conversation_words(spark, d))


def filename_tokens(spark: SparkSession, d: str) -> DataFrame:
    return part_clips(spark, d).select("clip_id", F.array_join(text.filename_tokens(F.col("filename")), " ").alias("tokens"))


def stopword_antijoin(spark: SparkSession, d: str) -> DataFrame:
    t = tokenize_words(spark, d)
    stop = spark.createDataFrame([(w,) for w in sorted(text.COMMON_WORDS)], "norm string")
    return t.filter("norm <> ''").join(F.broadcast(stop), "norm", "left_anti")


def slug_title_kind(spark: SparkSession, d: str) -> DataFrame:
    names_ = table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name"))).distinct()
    n = F.col("name")
    return names_.select("name", text.slug(n).alias("slug"), text.title_case(n).alias("title"), text.guess_kind(n).alias("kind"), text.safe_filename(F.concat(F.lit("a/"), n, F.lit("?.MP4")), F.lit("x")).alias("safe"), text.extension_of(F.concat(n, F.lit(".MP4"))).alias("ext"))


def _benchmark_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("t")).select(text.normalize_word(F.col("t")).alias("t")).filter("t <> ''").distinct()


def edit_budget_blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = _benchmark_tokens(spark, d).withColumn("letter", F.substring("t", 1, 1))
    a, b = t.select(F.col("t").alias("a"), "letter"), t.select(F.col("t").alias("b"), "letter")
    budget = names.edit_budget_col(F.greatest(F.length("a"), F.length("b")))
    near = a.join(b, "letter").filter("a < b and abs(length(a) - length(b)) <= 3").withColumn("budget", budget.cast("long"))
    return near.filter("budget > 0 and levenshtein(a, b) <= 2 * budget").select("a", "b", "budget")


def osa_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = edit_budget_blocked_pairs(spark, d)
    return p.withColumn("s", names.similarity_udf(F.col("a"), F.col("b"))).select("a", "b", names.osa_distance_udf(F.col("a"), F.col("b")).alias("distance"), "s.match", "s.score", "s.reason")


def phonetic_match(spark: SparkSession, d: str) -> DataFrame:
    codes = _benchmark_tokens(spark, d).withColumn("c", names.double_metaphone_udf(F.col("t"))).select("t", "c.primary", "c.alternate")
    return codes.filter("primary <> ''").groupBy("primary").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))


def exact_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All places in a conversation of the longer words, and of the pairs of words, that its first cue has."""
    w = stage(conversation_words(spark, d).select("job_id", "word_index", "cue_index", "norm"), "exact-words")
    first = w.filter("cue_index = 0").withColumn("nxt", F.lead("norm").over(Window.partitionBy("job_id").orderBy("word_index")))
    one = first.filter("length(norm) >= 3").select("job_id", F.array("norm").alias("tokens"))
    two = first.filter("norm <> '' and nxt <> ''").select("job_id", F.array("norm", "nxt").alias("tokens"))
    phrases = one.unionByName(two).distinct().withColumn("phrase_id", F.array_join("tokens", " "))
    hits = mentions.phrase_hits(phrases, w, fuzzy=False)
    best = hits.groupBy("job_id", "word_index").agg(F.max_by(F.struct("phrase_id", "word_count"), F.struct("word_count", "phrase_id")).alias("b"))
    return best.select("job_id", "word_index", "b.phrase_id", F.col("b.word_count").cast("long").alias("word_count"))


def similar_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of conversations that may stand for a word of the benchmark, by spelling, with their scores."""
    known = _benchmark_tokens(spark, d).select(F.lit("all").alias("job_id"), F.col("t").alias("known"))
    heard = table(spark, d, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("t")).select(F.lit("all").alias("job_id"), text.normalize_word(F.col("t")).alias("heard"))
    return mentions.token_pairs(known, heard, phonetic=False).filter("known <> heard").select("known", "heard", "score")


def _misspelt_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words of conversations, and as the cast of each the longer words of its first cue, two letters of each swapped, alone and with the next word."""
    w = stage(conversation_words(spark, d), "misspelt-words")
    by = Window.partitionBy("job_id").orderBy("word_index")
    first = w.filter("cue_index = 0").withColumn("nxt", F.lead("norm").over(by)).filter("length(norm) >= 6")
    once = first.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "norm").orderBy("word_index"))).filter("k = 1")
    name = F.concat(F.substring("norm", 1, 2), F.substring("norm", 4, 1), F.substring("norm", 3, 1), F.expr("substring(norm, 5)"))
    pair = F.when(F.coalesce("nxt", F.lit("")) != "", F.concat(name, F.lit(" "), "nxt"))
    ord_ = (F.row_number().over(by) - 1).cast("long")
    return w, once.select("job_id", ord_.alias("entity_ord"), F.concat(F.lit("e"), ord_).alias("entity_id"), name.alias("canonical"), F.array_compact(F.array(pair, name)).alias("aliases"))


def fuzzy_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Where a misspelt cast is mentioned, by spelling alone."""
    return mentions.find_mentions(*_misspelt_names(spark, d), phonetic=False).withColumn("confidence", F.round("confidence", 9))


def conversation_cast(spark: SparkSession, d: str) -> DataFrame:
    """The cast of each conversation, by spelling: clips named after the longer words of its first cue, alone, with the next one or in the plural, some tagged, and one name declared."""
    w = stage(conversation_words(spark, d), "cast-words")
    plain = F.regexp_like("norm", F.lit("^[a-z]{5,}$")) & ~F.col("norm").isin(*sorted(text.QUALIFIERS))
    first = w.filter("cue_index = 0").filter(plain).groupBy("job_id", "norm").agg(F.min("word_index").alias("at"))
    by = Window.partitionBy("job_id").orderBy("at")
    k = F.col("clip_ord")
    named = first.withColumns({"clip_ord": (F.row_number().over(by) - 1).cast("long"), "nxt": F.lead("norm").over(by)})
    filename = F.when(k % 3 == 0, F.concat("norm", F.lit("_take_1.mp4"))).when(k % 3 == 1, F.concat("norm", F.lit("_"), F.coalesce("nxt", F.lit("")), F.lit(".mp4"))).otherwise(F.concat("norm", F.lit("s_02.mp4")))
    tags = F.when(k % 7 == 3, F.array(F.concat("norm", F.lit(" Zed")))).otherwise(F.array().cast("array<string>"))
    clips = named.select("job_id", "clip_ord", F.concat(F.lit("c"), k).alias("clip_id"), filename.alias("filename"), tags.alias("tags"))
    declared = named.filter("clip_ord = 1").select("job_id", F.lit(0).alias("name_ord"), text.title_case(F.col("norm")).alias("name"))
    cast = mentions.build_cast(clips, w, declared, phonetic=False)
    return cast.select("job_id", "entity_ord", "entity_id", "canonical", F.array_join("aliases", "|").alias("aliases"), "kind", F.array_join("clip_ids", ",").alias("clip_ids"))


def phonetic_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The same by spelling and sound."""
    return mentions.find_mentions(*_misspelt_names(spark, d))


def greedy_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions.greedy_spans(exact_mentions(spark, d), ["job_id"])


def variant_mode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("x").alias("job_id"), F.col("lang").alias("entity_id"), F.col("source").alias("surface"), F.col("doc_id").alias("word_index"))
    v = mentions.surface_variants(docs)
    return v.select("entity_id", "mention_count", F.get("variants", F.lit(0))["text"].alias("mode"), F.get("variants", F.lit(0))["count"].alias("n"), F.array_join(F.transform("variants", lambda x: x["text"]), ",").alias("ranked"))


def clause_lookback(spark: SparkSession, d: str) -> DataFrame:
    return words.clause_lookback(conversation_words(spark, d), text.CONNECTORS).select("job_id", "word_index", "clause_start")


def carry_forward_hold(spark: SparkSession, d: str) -> DataFrame:
    """For each conversation, where the first sentence starts that does not refer back or comes over 9 s after the first."""
    s = words.sentences(conversation_words(spark, d)).withColumn("said", F.min(F.col("end_ms")).over(Window.partitionBy("job_id")))
    hold = (F.col("start_ms") - F.col("said") <= 9000) & text.refers_back(F.col("text"))
    return s.groupBy("job_id").agg(F.count(F.lit(1)).alias("sentences"), F.min(F.when((F.col("from_word") > 0) & ~hold, F.col("from_word"))).alias("cutoff"))


def nearest_onset(spark: SparkSession, d: str) -> DataFrame:
    w = stage(conversation_words(spark, d).select("job_id", "word_index", "cue_index", "start_ms", "end_ms"), "onset-words")
    t = w.groupBy("job_id", F.col("cue_index").alias("target_id")).agg(F.min("word_index").alias("from_word"), (F.max("word_index") + 1).alias("to_word"), F.floor((F.min("start_ms") * 2 + F.max("end_ms")) / 3).cast("long").alias("target_ms"))
    return words.nearest_onset(w, t)


def warning_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    w = docs.select(F.col("source").alias("job_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("A cue at "), (F.col("n_chars") % 100), F.lit("s in "), "lang", F.lit(" had "), F.col("n_chars") % 7, F.lit(" words")).alias("warning"))
    return cue_ops.distinct_warnings(w)


def longest_term_match(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("line_id"), "text")
    t = table(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").cast("string").alias("target"))
    more = spark.createDataFrame([("the", "a"), ("the in", "b"), ("of the", "c"), ("in", "d"), ("is", "e"), ("that", "f"), ("you", "g"), ("please", "h")], "term string, target string")
    return words.match_terms(lines, t.unionByName(more))


def clip_tags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    tags = F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_brand"), F.lit(" "), F.col("p_type"))
    return p.select("p_partkey", F.array_join(text.normalize_tags(tags), "|").alias("tags"), text.media_type(F.concat("p_name", F.element_at(F.array(F.lit(".mp4"), F.lit(".WAV"), F.lit(".srt"), F.lit(".exe")), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("kind"))


def highlight_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", text.highlight(F.concat_ws(" and ", "p_type", "p_name", "p_type"), F.col("p_name")).alias("text"))


def strip_transcript(spark: SparkSession, d: str) -> DataFrame:
    srt = cue_ops.render_srt(conversation_cues(spark, d))
    return srt.select("job_id", text.strip_transcript(F.col("text")).alias("text"))


def line_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.explode(text.line_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def align_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where every other turn of a conversation, backwards in its words, is said in it, in seconds."""
    cues = conversation_cues(spark, d).select("job_id", F.col("cue_index").alias("block_index"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    lines = cues.filter("block_index % 2 = 0").select("job_id", F.col("block_index").alias("line_ord"), F.array_join(F.reverse(F.split("text", " ")), " ").alias("text"))
    found = script.align_lines(lines, words.even_timeline(cues))
    return found.select("job_id", "line_ord", F.round("line_start", 6).alias("line_start"), F.round("line_end", 6).alias("line_end"))


def even_word_timing(spark: SparkSession, d: str) -> DataFrame:
    simple = cue_ops.parse_simple_srt(cue_ops.render_srt(conversation_cues(spark, d)))
    w = words.even_timeline(simple)
    return w.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("word_start"), 6).alias("first"), F.round(F.max("word_end"), 3).alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_words, document_words, clean_markup, parse_timestamp, format_units, srt_roundtrip, messy_subtitles, cue_repair_overlap, sentence_islands, filename_tokens, stopword_antijoin,
        slug_title_kind, edit_budget_blocked_pairs, osa_similarity, phonetic_match, similar_tokens, fuzzy_mentions, conversation_cast, phonetic_mentions, exact_mentions, greedy_mentions, variant_mode, clause_lookback, carry_forward_hold,
        nearest_onset, warning_dedupe, longest_term_match, clip_tags, highlight_names, strip_transcript, line_token_counts, even_word_timing, align_lines,
    )
} | {"word_timeline": conversation_words}

_CLEAN = "{0}"
for _p, _b in (("<[^>]*>", ""), (r"\{{[^}}]*\}}", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&#39;|&apos;", "''"), ("(?i)&quot;", '"'), ("(?m)^[\\s ﻿]*-[\\s ﻿]+", ""), ("[\\s ﻿]+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_b}', 'g')"
_CLEAN = f"trim({_CLEAN})"

_STAMP = "printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)"
_COMMA = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_BUDGET = "CASE WHEN greatest(length(a.t), length(b.t)) <= 4 THEN 0 WHEN greatest(length(a.t), length(b.t)) <= 6 THEN 1 WHEN greatest(length(a.t), length(b.t)) <= 10 THEN 2 ELSE 3 END"
_REFERS = " OR ".join(f"regexp_matches(text, '{p}')" for p in text.REFERS_BACK)
_CONNECTOR = _in(text.CONNECTORS)

_EXACT = f"""{WORDS_SQL}, two AS (SELECT *, lead(norm) OVER (PARTITION BY job_id ORDER BY word_index) AS nxt FROM words),
    opening AS (SELECT *, lead(norm) OVER (PARTITION BY job_id ORDER BY word_index) AS nxt FROM words WHERE cue_index = 0),
    p1 AS (SELECT DISTINCT job_id, norm FROM opening WHERE length(norm) >= 3), p2 AS (SELECT DISTINCT job_id, norm, nxt FROM opening WHERE norm <> '' AND nxt <> ''),
    hits AS (SELECT job_id, word_index, norm AS phrase_id, 1 AS word_count FROM words JOIN p1 USING (job_id, norm) UNION ALL SELECT job_id, word_index, norm || ' ' || nxt, 2 FROM two JOIN p2 USING (job_id, norm, nxt)),
    exact AS (SELECT job_id, word_index, arg_max(phrase_id, word_count) AS phrase_id, CAST(max(word_count) AS BIGINT) AS word_count FROM hits GROUP BY 1, 2)"""

_OSA = """list_reduce(list_transform(range(1, length(known) + 1), lambda i: [i]),
        lambda acc, e: list_concat(acc[length(heard) + 2 : 2 * length(heard) + 2], list_reduce(list_transform(range(1, length(heard) + 1), lambda j: [j]),
            lambda r, f: list_append(r, least(acc[length(heard) + 2 + f[1]] + 1, r[-1] + 1, acc[length(heard) + 1 + f[1]] + CAST(known[e[1]] <> heard[f[1]] AS BIGINT),
                CASE WHEN e[1] > 1 AND f[1] > 1 AND known[e[1]] = heard[f[1] - 1] AND known[e[1] - 1] = heard[f[1]] THEN acc[f[1] - 1] + 1 ELSE 999 END)), [e[1]])),
        list_concat(range(0, length(heard) + 1), range(0, length(heard) + 1)))[-1]"""
_STEM = "regexp_replace(regexp_replace({0}, '(''s|s'')$', ''), 's$', '')"
#: Of pairs (known, heard): near (score), all that match by spelling but are not equal. The unrestricted distance is never over the restricted one.
_NEAR = f"""sized AS (SELECT known, heard, greatest(length(known), length(heard)) AS n, {_STEM.format('known')} = {_STEM.format('heard')} AS same FROM pairs
        WHERE known <> heard AND length(known) >= 4 AND length(heard) > 0 AND known[1] = heard[1] AND abs(length(known) - length(heard)) <= 3),
    budgeted AS (SELECT *, CASE WHEN n <= 4 THEN 0 WHEN n <= 6 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END AS budget FROM sized),
    measured AS (SELECT known, heard, n, same, budget, {_OSA} AS d FROM budgeted WHERE same OR (budget > 0 AND damerau_levenshtein(known, heard) <= budget)),
    near AS (SELECT known, heard, CASE WHEN same THEN 0.98 ELSE 1 - d / CAST(n + 1 AS DOUBLE) END AS score FROM measured WHERE same OR (budget > 0 AND d <= budget))"""

_SIMILAR = "({0} = {1} OR list_contains(sims, {0} || ' ' || {1}))"
_KNOWN = f"""len(list_filter(members[j].seeds, lambda a: (len(string_split(a, ' ')) = len(name) AND len(list_filter(range(1, len(name) + 1), lambda q: NOT {_SIMILAR.format("string_split(a, ' ')[q]", 'name[q]')})) = 0)
            OR (len(name) = 1 AND length(name[1]) >= 3 AND len(list_filter(string_split(a, ' '), lambda p: length(p) >= 3 AND {_SIMILAR.format('p', 'name[1]')})) > 0))) > 0"""
_COMMON = _in(text.COMMON_WORDS)

ORACLE = {
    "conversation_cast": rf"""WITH RECURSIVE {WORDS_SQL}, opening AS (SELECT job_id, norm, min(word_index) AS place FROM words WHERE cue_index = 0 AND regexp_matches(norm, '^[a-z]{{5,}}$') AND norm NOT IN ({_in(text.QUALIFIERS)}) GROUP BY 1, 2),
        named AS (SELECT *, row_number() OVER o - 1 AS k, lead(norm) OVER o AS nxt FROM opening WINDOW o AS (PARTITION BY job_id ORDER BY place)),
        readings AS (SELECT job_id, k, k % 7 = 3 AS tagged, CASE WHEN k % 7 <> 3 AND k % 3 = 2 THEN norm || 's' ELSE norm END AS t1, CASE WHEN k % 7 = 3 THEN 'zed' WHEN k % 3 = 1 THEN nxt END AS t2 FROM named),
        toks AS (SELECT DISTINCT job_id, t FROM (SELECT job_id, t1 AS t FROM readings UNION SELECT job_id, t2 FROM readings UNION SELECT job_id, norm FROM named) WHERE t IS NOT NULL),
        pairs AS (SELECT DISTINCT known, heard FROM (SELECT t AS known, job_id FROM toks) JOIN (SELECT norm AS heard, job_id FROM words UNION SELECT t, job_id FROM toks) USING (job_id) WHERE known[1] = heard[1]),
        {_NEAR}, alike AS (SELECT known, heard FROM near UNION SELECT known, heard FROM pairs WHERE known = heard),
        follow AS (SELECT job_id, norm, lead(norm) OVER (PARTITION BY job_id ORDER BY word_index) AS nxt FROM words),
        one AS (SELECT DISTINCT r.job_id, k FROM readings r JOIN alike ON known = t1 JOIN words w ON w.job_id = r.job_id AND w.norm = heard),
        two AS (SELECT DISTINCT r.job_id, k FROM readings r JOIN alike a ON a.known = t1 JOIN alike b ON b.known = t2 JOIN follow f ON f.job_id = r.job_id AND f.norm = a.heard AND f.nxt = b.heard),
        resolved AS (SELECT job_id, k, 'c' || k AS clip, NULL AS shown, CASE WHEN two.k IS NOT NULL THEN [t1, t2] WHEN one.k IS NOT NULL AND t1 NOT IN ({_COMMON}) THEN [t1] WHEN tagged THEN [t1, t2] END AS name
            FROM readings LEFT JOIN one USING (job_id, k) LEFT JOIN two USING (job_id, k)),
        entries AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k) AS i FROM (SELECT * FROM resolved WHERE name IS NOT NULL UNION ALL SELECT job_id, -1, NULL, upper(norm[1]) || norm[2:], [norm] FROM named WHERE k = 1)),
        simset AS (SELECT t.job_id, list(n.known || ' ' || n.heard) AS sims FROM toks t JOIN near n ON n.known = t.t JOIN toks u ON u.job_id = t.job_id AND u.t = n.heard GROUP BY 1),
        known_pairs AS (SELECT job_id, coalesce(any_value(sims), CAST([] AS VARCHAR[])) AS sims FROM entries LEFT JOIN simset USING (job_id) GROUP BY 1),
        walk AS (SELECT job_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(shown VARCHAR, seeds VARCHAR[], clips VARCHAR[])[]) AS members FROM (SELECT DISTINCT job_id FROM entries)
            UNION ALL SELECT job_id, i, CASE WHEN j IS NULL THEN list_append(members, {{'shown': shown, 'seeds': [array_to_string(name, ' ')], 'clips': CASE WHEN clip IS NULL THEN CAST([] AS VARCHAR[]) ELSE [clip] END}})
                WHEN clip IS NULL THEN members ELSE list_concat(members[1:j - 1], [{{'shown': members[j].shown, 'seeds': CASE WHEN list_contains(members[j].seeds, array_to_string(name, ' ')) THEN members[j].seeds ELSE list_append(members[j].seeds, array_to_string(name, ' ')) END, 'clips': list_append(members[j].clips, clip)}}], members[j + 1:]) END
            FROM (SELECT w.job_id, e.i, w.members, e.name, e.clip, e.shown, list_filter(range(1, len(members) + 1), lambda j: {_KNOWN})[1] AS j
                FROM walk w JOIN entries e ON e.job_id = w.job_id AND e.i = w.i + 1 JOIN known_pairs kp ON kp.job_id = w.job_id)),
        done AS (SELECT job_id, unnest(members) AS m, unnest(range(len(members))) AS entity_ord FROM walk QUALIFY i = max(i) OVER (PARTITION BY job_id)),
        titled AS (SELECT job_id, entity_ord, m.seeds AS seeds, m.clips AS clips, coalesce(m.shown, array_to_string(list_transform(string_split(m.seeds[1], ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS canonical FROM done),
        whole AS (SELECT *, list_filter(list_append(seeds, lower(canonical)), lambda x: length(x) >= 2 AND x NOT IN ({_COMMON})) AS own FROM titled),
        every AS (SELECT *, list_filter(list_concat(own, flatten(list_transform(list_filter(own, lambda x: contains(x, ' ')), lambda x: [string_split(x, ' ')[1], string_split(x, ' ')[-1], array_to_string(list_transform(string_split(x, ' '), lambda y: y[1]), '')]))), lambda x: length(x) >= 2 AND x NOT IN ({_COMMON})) AS a FROM whole),
        ranked AS (SELECT job_id, entity_ord, x, min(n) AS n FROM (SELECT job_id, entity_ord, unnest(a) AS x, unnest(range(len(a))) AS n FROM every) GROUP BY 1, 2, 3),
        aliases AS (SELECT job_id, entity_ord, string_agg(x, '|' ORDER BY len(string_split(x, ' ')) DESC, length(x) DESC, n) AS aliases FROM ranked GROUP BY 1, 2),
        slugs AS (SELECT *, replace(lower(canonical), ' ', '-') AS slug, row_number() OVER (PARTITION BY job_id, replace(lower(canonical), ' ', '-') ORDER BY entity_ord) AS n FROM titled)
        SELECT job_id, entity_ord, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS entity_id, canonical, coalesce(aliases, '') AS aliases,
            CASE WHEN regexp_matches(canonical, '{text.ORGANISATION}') THEN 'organisation' ELSE 'person' END AS kind, array_to_string(clips, ',') AS clip_ids FROM slugs LEFT JOIN aliases USING (job_id, entity_ord)""",
    "similar_tokens": f"""WITH k AS (SELECT DISTINCT {sql_norm('raw')} AS known FROM (SELECT unnest({sql_tokens('text')}) AS raw FROM benchmark)), h AS (SELECT DISTINCT {sql_norm('raw')} AS heard FROM (SELECT unnest({sql_tokens('text')}) AS raw FROM conversations)),
        pairs AS (SELECT known, heard FROM k JOIN h ON known[1] = heard[1]), {_NEAR} SELECT known, heard, score FROM near""",
    "fuzzy_mentions": rf"""WITH RECURSIVE {WORDS_SQL}, opening AS (SELECT *, lead(norm) OVER (PARTITION BY job_id ORDER BY word_index) AS nxt FROM words WHERE cue_index = 0),
        once AS (SELECT *, norm[1:2] || norm[4] || norm[3] || norm[5:] AS name FROM opening WHERE length(norm) >= 6 QUALIFY row_number() OVER (PARTITION BY job_id, norm ORDER BY word_index) = 1),
        cast_of AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY word_index) - 1 AS entity_ord, name, nxt FROM once),
        aliases AS (SELECT job_id, entity_ord, name, 0 AS alias_ord, name AS t1, nxt AS t2, 2 AS word_count FROM cast_of WHERE nxt <> '' UNION ALL SELECT job_id, entity_ord, name, 1, name, NULL, 1 FROM cast_of),
        follow AS (SELECT *, lead(norm) OVER (PARTITION BY job_id ORDER BY word_index) AS nxt FROM words),
        pairs AS (SELECT DISTINCT known, heard FROM (SELECT DISTINCT job_id, t1 AS known FROM aliases UNION SELECT DISTINCT job_id, t2 FROM aliases WHERE t2 IS NOT NULL) JOIN (SELECT DISTINCT job_id, norm AS heard FROM words) USING (job_id) WHERE known[1] = heard[1]),
        {_NEAR}, alike AS (SELECT known, heard, score FROM near UNION ALL SELECT known, heard, 1.0 FROM pairs WHERE known = heard),
        one AS (SELECT a.job_id, word_index, entity_ord, alias_ord, name, word_count, score, t2, f.nxt FROM aliases a JOIN alike ON known = t1 JOIN follow f ON f.job_id = a.job_id AND f.norm = heard),
        hits AS (SELECT job_id, word_index, entity_ord, alias_ord, name, 1 AS word_count, score FROM one WHERE t2 IS NULL
            UNION ALL SELECT job_id, word_index, entity_ord, alias_ord, name, 2, least(one.score, alike.score) FROM one JOIN alike ON known = t2 AND heard = nxt),
        best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY job_id, word_index ORDER BY word_count DESC, score DESC, entity_ord, alias_ord) = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY word_index) AS k FROM best),
        walk AS (SELECT *, word_index + word_count AS free, true AS taken FROM n WHERE k = 1
            UNION ALL SELECT n.*, CASE WHEN n.word_index >= free THEN n.word_index + n.word_count ELSE free END, n.word_index >= free FROM walk JOIN n ON n.job_id = walk.job_id AND n.k = walk.k + 1)
        SELECT m.job_id, 'e' || entity_ord AS entity_id, m.word_index, m.word_count, min(w.start_ms) AS start_ms, arg_max(w.end_ms, w.word_index) AS end_ms, round(any_value(score), 9) AS confidence,
            string_agg(regexp_replace(regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}'']+$', ''), ' ' ORDER BY w.word_index) AS surface, any_value(score) < 1 OR bool_or(norm <> name) AS corrected
        FROM walk m JOIN words w ON w.job_id = m.job_id AND w.word_index BETWEEN m.word_index AND m.word_index + m.word_count - 1 WHERE taken GROUP BY m.job_id, entity_ord, m.word_index, m.word_count""",
    "word_timeline": f"WITH {WORDS_SQL} SELECT * FROM words",
    "tokenize_words": f"SELECT {sql_norm('raw')} AS norm, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS raw FROM documents) GROUP BY 1",
    "clean_markup": f"SELECT page_id, {_CLEAN.format('html')} AS text FROM pages",
    "parse_timestamp": f"""WITH {MENTIONS_SQL} SELECT event_id, {_STAMP} AS stamp, start_ms AS parsed,
        CASE WHEN start_ms >= 3600000 THEN printf('%d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) ELSE printf('%d:%02d', start_ms // 60000, start_ms // 1000 % 60) END AS clock,
        start_ms / 1000.0 AS seconds FROM event_mentions""",
    "format_units": """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_totalprice / 7) AS BIGINT) AS n FROM orders), t AS (SELECT *, CAST(floor(n % 9000000 / 1000.0 + 0.5) AS BIGINT) AS s FROM o)
        SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f', n / 1024.0) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MB' ELSE printf('%.2f', n / 1073741824.0) || ' GB' END AS bytes,
        CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration FROM t""",
    "srt_roundtrip": f"""WITH {CUES_SQL}, cleaned AS (SELECT job_id, start_ms, start_ms + span AS end_ms, {_CLEAN.format('text')} AS text FROM cues)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms) - 1 AS cue_index, start_ms, end_ms, text FROM cleaned WHERE text <> ''""",
    "messy_subtitles": f"""WITH {CUES_SQL}, cleaned AS (SELECT job_id, start_ms, start_ms + span AS end_ms, {_CLEAN.format('text')} AS text FROM cues)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms) - 1 AS cue_index, start_ms, end_ms, text FROM cleaned WHERE text <> ''""",
    "cue_repair_overlap": f"""WITH {MENTIONS_SQL}, c AS (SELECT job_id, ord AS cue_index, start_ms, start_ms + 1 + CAST(floor(value * 1000) AS BIGINT) AS end_ms FROM event_mentions)
        SELECT job_id, cue_index, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms, cue_index), end_ms)) AS end_ms FROM c""",
    "sentence_islands": f"WITH {SENTENCES_SQL} SELECT * FROM sentences",
    "filename_tokens": f"""WITH {CLIPS_SQL}, t AS (SELECT clip_id, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(filename, '(?i)\\.[a-z0-9]{{1,8}}$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: {sql_norm('x')}) AS w FROM clips)
        SELECT clip_id, coalesce(array_to_string(list_filter(w, lambda x: x <> '' AND x NOT IN ({_in(text.QUALIFIERS)}) AND NOT regexp_matches(x, '^(\\d+|v\\d+|\\d+(k|p|fps))$')), ' '), '') AS tokens FROM t""",
    "stopword_antijoin": f"WITH t AS (SELECT {sql_norm('raw')} AS norm, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS raw FROM documents) GROUP BY 1) SELECT * FROM t WHERE norm <> '' AND norm NOT IN ({_in(text.COMMON_WORDS)})",
    "slug_title_kind": f"""WITH n AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part)
        SELECT name, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'character') AS slug,
        array_to_string(list_transform({sql_tokens('name')}, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title,
        CASE WHEN regexp_matches(name, '{text.ORGANISATION}') OR regexp_matches(name, '^[A-Z]{{2,6}}$') THEN 'organisation' WHEN len({sql_tokens('name')}) <= 3 THEN 'person' ELSE 'unknown' END AS kind,
        name || '_.MP4' AS safe, '.mp4' AS ext FROM n""",
    "edit_budget_blocked_pairs": f"""WITH t AS (SELECT DISTINCT {sql_norm('raw')} AS t FROM (SELECT unnest({sql_tokens('text')}) AS raw FROM benchmark)), w AS (SELECT * FROM t WHERE t <> ''),
        p AS (SELECT a.t AS a, b.t AS b, CAST({_BUDGET} AS BIGINT) AS budget FROM w a JOIN w b ON substr(a.t, 1, 1) = substr(b.t, 1, 1) WHERE a.t < b.t AND abs(length(a.t) - length(b.t)) <= 3)
        SELECT a, b, budget FROM p WHERE budget > 0 AND levenshtein(a, b) <= 2 * budget""",
    "exact_mentions": f"WITH {_EXACT} SELECT * FROM exact",
    "greedy_mentions": f"""WITH RECURSIVE {_EXACT}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY word_index) AS k FROM exact),
        walk AS (SELECT *, word_index + word_count AS free, true AS taken FROM n WHERE k = 1
            UNION ALL SELECT n.*, CASE WHEN n.word_index >= free THEN n.word_index + n.word_count ELSE free END, n.word_index >= free FROM walk JOIN n ON n.job_id = walk.job_id AND n.k = walk.k + 1)
        SELECT job_id, word_index, phrase_id, word_count FROM walk WHERE taken""",
    "document_words": f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, {sql_tokens('text')} AS toks FROM documents), u AS (SELECT job_id, len(toks) * 10000 // 29 AS span, unnest(toks) AS raw, unnest(range(len(toks))) AS pos FROM t),
        w AS (SELECT *, {sql_weight('raw')} AS w FROM u), s AS (SELECT *, sum(w) OVER (PARTITION BY job_id ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY job_id) AS whole FROM w),
        x AS (SELECT job_id, (2 * (upto - w) * span + whole) // (2 * whole) AS a, (2 * upto * span + whole) // (2 * whole) AS b FROM s)
        SELECT job_id, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(max(greatest(b, a + 1)) AS BIGINT) AS last_ms FROM x GROUP BY 1""",
    "strip_transcript": rf"""WITH {CUES_SQL}, f AS (SELECT job_id, string_agg((cue_index + 1) || chr(10) || {_COMMA.format('start_ms')} || ' --> ' || {_COMMA.format('(start_ms + span)')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_index) AS t FROM cues GROUP BY 1)
        SELECT job_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\d+\r?\n', '', 'g'), '[\d:,]+ --> [\d:,.]+', '', 'g'), '<[^>]+>', '', 'g'), 'WEBVTT.*\n', '', 'g'), '\n{{2,}}', ' ', 'g')) AS text FROM f""",
    # a plain scan of all windows that a line may be in
    "align_lines": rf"""WITH RECURSIVE {CUES_SQL}, said AS (SELECT job_id, cue_index, start_ms / 1000.0 AS a, (start_ms + span) / 1000.0 AS b, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM cues),
        every AS (SELECT job_id, cue_index, unnest(w) AS word, unnest(range(len(w))) AS pos, CAST(a AS DOUBLE) AS a, (CAST(b AS DOUBLE) - CAST(a AS DOUBLE)) / len(w) AS step FROM said),
        script AS (SELECT job_id, list(word ORDER BY cue_index, pos) AS words, list(a + pos * step ORDER BY cue_index, pos) AS starts, list(a + (pos + 1) * step ORDER BY cue_index, pos) AS ends FROM every GROUP BY 1),
        lines AS (SELECT job_id, cue_index AS line_ord, row_number() OVER (PARTITION BY job_id ORDER BY cue_index) AS k, list_filter(regexp_split_to_array(regexp_replace(lower(array_to_string(list_reverse(string_split(text, ' ')), ' ')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1 AND x NOT IN ({_in(text.LINE_STOP_WORDS)})) AS toks FROM cues WHERE cue_index % 2 = 0),
        wanted AS (SELECT *, list_distinct(toks) AS u, greatest(3 * len(list_distinct(toks)), 25) AS width FROM lines),
        walk AS (SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS free, CAST(NULL AS BIGINT) AS line_ord, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y FROM script
            UNION ALL SELECT job_id, k, coalesce(list_max(inside) + 1, free), line_ord, list_min(inside), list_max(inside)
            FROM (SELECT *, CASE WHEN hit IS NOT NULL THEN list_filter(range(hit, least(hit + width, len(words))), lambda i: list_contains(u, words[i + 1])) END AS inside
                FROM (SELECT *, CASE WHEN len(toks) > 0 AND list_max(scores) > 0 THEN free + coalesce(list_position(list_transform(scores, lambda v: v >= ceil(len(u) * 0.85)), true), list_position(scores, list_max(scores))) - 1 END AS hit
                    FROM (SELECT w.job_id, l.k, w.free, l.line_ord, l.toks, l.u, l.width, s.words,
                            list_transform(range(w.free, greatest(w.free, least(w.free + greatest(8 * l.width, 300), len(s.words)) - len(l.toks) + 1)), lambda p: len(list_intersect(l.u, s.words[p + 1 : p + l.width]))) AS scores
                        FROM walk w JOIN wanted l ON l.job_id = w.job_id AND l.k = w.k + 1 JOIN script s ON s.job_id = w.job_id))))
        SELECT job_id, CAST(line_ord AS BIGINT) AS line_ord, CASE WHEN x IS NOT NULL THEN round(greatest(0.0, starts[x + 1] - 0.06), 6) END AS line_start, round(ends[y + 1] + 0.10, 6) AS line_end FROM walk JOIN script USING (job_id) WHERE k > 0""",
    "even_word_timing": rf"""WITH {CUES_SQL}, w AS (SELECT job_id, start_ms / 1000.0 AS a, (start_ms + span) / 1000.0 AS b, len(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(text, '<[^>]+>', '', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> '')) AS n FROM cues)
        SELECT job_id, CAST(sum(n) AS BIGINT) AS n, CAST(round(min(a), 6) AS DOUBLE) AS first, CAST(round(max(a + n * ((b - a) / n)), 3) AS DOUBLE) AS last FROM w WHERE n > 0 GROUP BY 1""",
    "variant_mode": """WITH c AS (SELECT lang AS entity_id, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)
        SELECT entity_id, CAST(sum(n) AS BIGINT) AS mention_count, first(source ORDER BY n DESC, f) AS mode, max(n) AS n, string_agg(source, ',' ORDER BY n DESC, f) AS ranked FROM c GROUP BY 1""",
    "clause_lookback": f"""WITH {WORDS_SQL}, h AS (SELECT *, CASE WHEN regexp_matches(raw, '[,;:—–-]$') THEN word_index + 1 WHEN norm IN ({_CONNECTOR}) THEN word_index END AS here FROM words)
        SELECT job_id, word_index, coalesce(last_value(here IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY word_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), word_index) AS clause_start FROM h""",
    "carry_forward_hold": f"""WITH {SENTENCES_SQL}, s AS (SELECT *, min(end_ms) OVER (PARTITION BY job_id) AS said FROM sentences)
        SELECT job_id, count(*) AS sentences, min(CASE WHEN from_word > 0 AND NOT (start_ms - said <= 9000 AND ({_REFERS})) THEN from_word END) AS cutoff FROM s GROUP BY 1""",
    "nearest_onset": f"""WITH {WORDS_SQL}, t AS (SELECT job_id, cue_index AS target_id, (min(start_ms) * 2 + max(end_ms)) // 3 AS target_ms FROM words GROUP BY 1, 2),
        r AS (SELECT w.job_id, target_id, word_index, row_number() OVER (PARTITION BY w.job_id, target_id ORDER BY abs(start_ms - target_ms), word_index) AS rn FROM words w JOIN t ON w.job_id = t.job_id AND w.cue_index = t.target_id)
        SELECT job_id, target_id, word_index FROM r WHERE rn = 1""",
    "warning_dedupe": r"""WITH w AS (SELECT source AS job_id, doc_id AS ord, 'A cue at ' || n_chars % 100 || 's in ' || lang || ' had ' || n_chars % 7 || ' words' AS warning FROM documents),
        f AS (SELECT *, row_number() OVER (PARTITION BY job_id, regexp_replace(warning, '\d+', '#', 'g') ORDER BY ord) AS rn FROM w), g AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS k FROM f WHERE rn = 1)
        SELECT job_id, ord, warning FROM g WHERE k <= 40""",
    "longest_term_match": r"""WITH terms AS (SELECT n_name AS term, CAST(n_nationkey AS VARCHAR) AS target FROM nation UNION ALL VALUES ('the', 'a'), ('the in', 'b'), ('of the', 'c'), ('in', 'd'), ('is', 'e'), ('that', 'f'), ('you', 'g'), ('please', 'h')),
        hits AS (SELECT conv_id || ':' || turn AS line_id, term, target, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(term) DESC, term DESC) AS rn FROM conversations JOIN terms
        ON regexp_matches(text, '(?i)(^|[^A-Za-z])' || regexp_replace(term, '\s+', '[\\s-]+', 'g') || '($|[^A-Za-z])'))
        SELECT line_id, term, target FROM hits WHERE rn = 1""",
    "clip_tags": """SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS tags, ['video', 'audio', 'subtitle', NULL][p_partkey % 4 + 1] AS kind FROM part""",
    "highlight_names": r"""SELECT p_partkey, regexp_replace(p_type || ' and ' || p_name || ' and ' || p_type, '(?i)(' || split_part(p_name, ' ', 1) || '\w*)', '<b>\1</b>', 'g') AS text FROM part""",
    "line_token_counts": rf"""WITH t AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+')) AS token FROM conversations)
        SELECT token, count(*) AS n FROM t WHERE length(token) > 1 AND token NOT IN ({_in(text.LINE_STOP_WORDS)}) GROUP BY 1""",
}
