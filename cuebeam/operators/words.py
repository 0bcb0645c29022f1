"""Words with times, sentences and what is found along them."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.functions.text import count_words, ends_sentence, normalize_word, speech_weights, tokens
from cuebeam.operators import stretches
from cuebeam.operators.stretches import carry


def utterance_cues(utterances: DataFrame, words_per_10_s: int = 29, gap_ms: int = 450) -> DataFrame:
    """Cues from texts in order (job_id, ord, text): a steady rate of speech, and a pause after each."""
    span = F.floor(count_words(F.col("text")) * 10000 / words_per_10_s).cast("long")
    before = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1
    rows = utterances.withColumn("span", span).withColumn("start_ms", F.coalesce(F.sum(F.col("span") + gap_ms).over(before), F.lit(0)).cast("long"))
    return rows.select("job_id", place.cast("long").alias("cue_index"), "start_ms", (F.col("start_ms") + F.col("span")).alias("end_ms"), "text")


def running_sums(numbers: Column) -> Column:
    """The sums of an array up to each of its numbers; of null none."""

    @F.arrow_udf("array<bigint>")
    def sums(lists: pa.Array) -> pa.Array:
        import numpy as np

        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.r_[0, np.cumsum(size)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat - np.repeat(np.r_[0, flat][ends[:-1]], size), pa.int64()))

    return sums(numbers)


def word_timeline(cues: DataFrame) -> DataFrame:
    """Each cue's words (word_index, cue_index, norm, raw, start_ms, end_ms) with their share of its time by speech weight.

    Numbers of words before a cue come from the cues alone. Weights are summed in each cue's row, so words are neither dealt nor sorted.
    """
    cues = cues.withColumn("_tokens", tokens(F.col("text")))
    before = Window.partitionBy("job_id").orderBy("cue_index").rowsBetween(Window.unboundedPreceding, -1)
    cues = cues.withColumn("_n", F.size("_tokens")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    cues = cues.withColumn("_weights", speech_weights(F.col("_tokens"))).withColumn("_sums", running_sums(F.col("_weights")))
    words = cues.select(
        "job_id", "cue_index", F.col("start_ms").alias("_from"), (F.col("end_ms") - F.col("start_ms")).alias("_span"), "_first", F.get("_sums", F.col("_n") - 1).alias("_all"),
        F.posexplode(F.arrays_zip(F.col("_tokens").alias("raw"), F.col("_weights").alias("w"), F.col("_sums").alias("s"))).alias("pos", "_word"),
    ).select("*", F.col("_word.raw").alias("raw"), F.col("_word.w").alias("_w"), F.col("_word.s").alias("_sum"))
    # the nearest millisecond, halves up, in whole numbers
    at = lambda acc: F.col("_from") + F.expr(f"(2 * ({acc}) * _span + _all) div (2 * _all)")
    words = words.withColumn("start_ms", at("_sum - _w"))
    return words.select(
        "job_id", (F.col("_first") + F.col("pos")).alias("word_index"), "cue_index", normalize_word(F.col("raw")).alias("norm"), "raw", "start_ms",
        F.greatest(at("_sum"), F.col("start_ms") + 1).alias("end_ms"),
    )


def even_timeline(cues: DataFrame) -> DataFrame:
    """Words of entries in seconds (start, end, text), each with the same share."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")
    rows = cues.withColumn("_n", F.greatest(F.size(words), F.lit(1))).select("*", F.posexplode(words).alias("pos", "word"))
    step = (F.col("end") - F.col("start")) / F.col("_n")
    return rows.select("job_id", "block_index", "pos", "word", (F.col("start") + F.col("pos") * step).alias("word_start"), (F.col("start") + (F.col("pos") + 1) * step).alias("word_end"))


def sentence_starts(words: DataFrame) -> DataFrame:
    order = Window.partitionBy("job_id").orderBy("word_index")
    return words.withColumn("starts", F.coalesce(ends_sentence(F.lag("raw").over(order)), F.lit(True)))


def sentences(words: DataFrame) -> DataFrame:
    """from_word, to_word (past the end), start_ms, end_ms and text of each sentence."""
    order = Window.partitionBy("job_id").orderBy("word_index")
    numbered = sentence_starts(words).withColumn("_s", F.sum(F.col("starts").cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_index", "raw"))), lambda w: w["raw"]), " ")
    return numbered.groupBy("job_id", "_s").agg(
        F.min("word_index").alias("from_word"), (F.max("word_index") + 1).alias("to_word"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "word_index").alias("end_ms"), text.alias("text"),
    ).drop("_s")


def nearest_onset(words: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (job_id, target_id, from_word, to_word, target_ms), the word in [from, to) whose onset is nearest; ties to the earlier.

    Words of a job have numbers without holes, in order of time. A target takes the last onset up to its time and the
    first one after it, from one pass over both in order of time, cut into stretches: no word meets a target.
    """
    bound = lambda name, at: words.select("job_id", (F.col("word_index") + at).alias(name), F.col("start_ms").alias(f"_{name}_ms"))
    asked = targets.filter("from_word < to_word").join(bound("from_word", 0), ["job_id", "from_word"]).join(bound("to_word", 1), ["job_id", "to_word"], "left")
    # outside its words' onsets a target is nearest to the first or last of them
    at = F.least(F.greatest(F.col("target_ms"), "_from_word_ms"), "_to_word_ms").cast("double")
    onsets = words.groupBy("job_id", "start_ms").agg(F.min("word_index").alias("word"))
    word = F.struct(F.col("word").alias("word"), F.col("start_ms").cast("double").alias("ms"))
    asks = F.struct("target_id", "from_word", "to_word", F.col("target_ms").cast("double").alias("ms"))
    kind = {"_word": asked.sparkSession.createDataFrame([], "w struct<word:bigint,ms:double>").schema[0].dataType, "_asks": asked.select(asks).schema[0].dataType}
    both = onsets.select("job_id", F.col("start_ms").cast("double").alias("_at"), F.lit(0).alias("_k"), word.alias("_word"), F.lit(None).cast(kind["_asks"]).alias("_asks")).unionByName(
        asked.select("job_id", at.alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast(kind["_word"]).alias("_word"), asks.alias("_asks"))
    )
    met = carry(both, ["job_id"], "_at", {"_low": ("last", F.col("_word")), "_high": ("next", F.col("_word"))}, ["_k"], stretches.MS_STRETCH).filter("_k = 1")
    low = F.greatest("_low.word", "_asks.from_word")
    later = (F.col("_high.word") < F.col("_asks.to_word")) & (F.col("_low.word").isNull() | (F.col("_high.ms") - F.col("_asks.ms") < F.col("_asks.ms") - F.col("_low.ms")))
    found = met.select("job_id", F.col("_asks.target_id").alias("target_id"), F.when(F.coalesce(later, F.lit(False)), F.col("_high.word")).otherwise(low).alias("word_index"), "_asks.from_word", "_asks.to_word", "_low")
    return found.filter("_low is not null and word_index >= from_word and word_index < to_word").select("job_id", "target_id", "word_index")


def clause_lookback(words: DataFrame, connectors: tuple[str, ...], reach: int = 5) -> DataFrame:
    """words with clause_start: the clause begin at most `reach` words before each, or the word itself.

    It lies behind a word that ends in a pause mark, or on a connector.
    """
    order = Window.partitionBy("job_id").orderBy("word_index")
    here = F.when(F.regexp_like("raw", F.lit("[,;:—–-]$")), F.col("word_index") + 1).when(F.col("norm").isin(*connectors), F.col("word_index"))
    back = F.last(here, ignorenulls=True).over(order.rowsBetween(-reach, -1))
    return words.withColumn("clause_start", F.coalesce(back, "word_index"))


def match_terms(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """The longest term that stands in each line (line_id, text) between non-letters, any case; terms (term, target).

    A term meets only lines that hold its first word, so no line meets all terms. Terms are a dictionary, which goes to
    all tasks; lines, a row for each word here, never go to the driver, however small their files are.
    """
    first = lambda c: F.lower(F.regexp_extract(c, "([A-Za-z0-9]+)", 1))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    by_word = lines.select("line_id", "text", F.explode(words).alias("w"))
    quoted = F.regexp_replace(F.regexp_replace("term", r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"[\\s-]+")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z])"), quoted, F.lit("(?![A-Za-z])"))
    hits = by_word.join(F.broadcast(terms.withColumn("w", first(F.col("term")))), "w").filter(F.regexp_like("text", pattern))
    best = F.max_by(F.struct("term", "target"), F.struct(F.length("term"), "term"))
    return hits.groupBy("line_id").agg(best.alias("b")).select("line_id", "b.term", "b.target")


def carry_last(rows: DataFrame, partition: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
