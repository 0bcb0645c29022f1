import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuebeam.functions import names, text, time
from cuebeam.operators import cues


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("s,ms", [("00:00:01,500", 1500), ("00:00:01.500", 1500), ("01:02:03,004", 3723004), ("00:01:23", 83000), ("00:00:00,5", 500), ("1:23.4", 83400), ("nonsense", None), ("", None)])
def test_parse_timestamp(spark, s, ms):
    assert one(spark, time.parse_timestamp(F.col("s")), s=s) == ms


def test_formats(spark):
    assert one(spark, time.format_timestamp(F.lit(3723004))) == "01:02:03.004"
    assert one(spark, time.format_timestamp(F.lit(0))) == "00:00:00.000"
    assert one(spark, time.format_clock(F.lit(3723004))) == "1:02:03"
    assert one(spark, time.format_bytes(F.lit(1536))) == "2 KB"
    assert one(spark, time.half_up(F.lit(-2.5))) == -2
    assert one(spark, time.ticks(F.lit(46_500)))[-1] <= 46_500


@pytest.mark.parametrize("name,tokens", [("drake_court_01.mp4", ["drake", "court"]), ("kendrick-lamar-grammys-4k-v2.mov", ["kendrick", "lamar", "grammys"]), ("DrakeStage_Wide_1080p.mp4", ["drake", "stage"]), ("clip_003_final.mp4", [])])
def test_filename_tokens(spark, name, tokens):
    assert one(spark, text.filename_tokens(F.col("n")), n=name) == tokens


def test_words_and_names(spark):
    assert one(spark, text.normalize_word(F.lit("“Beyoncé’s”"))) == "beyonc's"
    assert one(spark, text.slug(F.lit("Kendrick Lamar!"))) == "kendrick-lamar"
    assert one(spark, text.slug(F.lit("!!"))) == "character"
    assert one(spark, text.guess_kind(F.lit("Acme Records"))) == "organisation"
    assert one(spark, text.clean_cue_text(F.lit("<i>{\\an8}- &quot;Hi&quot;  you</i>"))) == '"Hi" you'
    assert one(spark, text.safe_filename(F.lit("a\\b/..x?.mp4"), F.lit("f"))) == "x_.mp4"


@pytest.mark.parametrize("a,b,match,reason", [("kendrick", "kendrik", True, "edit"), ("kendrick", "kendrcik", True, "edit"), ("faisal", "faysal", True, "edit"), ("drake", "drake's", True, "exact"), ("drake", "blake", False, "none"), ("drake", "drama", False, "none"), ("umg", "umh", False, "none")])
def test_similarity(a, b, match, reason):
    got = names.similarity(a, b)
    assert (got[0], got[2]) == (match, reason)
    if reason == "edit":
        assert got[1] == 1 - 1 / (max(len(a), len(b)) + 1)


def test_osa_is_not_unrestricted():
    assert names.osa_distance("ca", "abc") == 3
    assert names.osa_distance("kendrick", "kendrcik") == 1


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=60, deadline=None)
def test_osa_is_symmetric_and_bounded(a, b):
    d = names.osa_distance(a, b)
    assert d == names.osa_distance(b, a) <= max(len(a), len(b)) and (d == 0) == (a == b)


@pytest.mark.parametrize("word,codes", [("smith", ("SM0", "XMT")), ("schmidt", ("XMT", "SMT")), ("thomas", ("TMS", "TMS")), ("knight", ("NT", "NT")), ("phone", ("FN", "FN")), ("xavier", ("SF", "SFR")), ("", ("", ""))])
def test_double_metaphone(word, codes):
    assert names.double_metaphone(word) == codes


def parse(spark, body):
    c, w = cues.parse_subtitles(spark.createDataFrame([("j", body)], "job_id string, text string"))
    return sorted((r["start_ms"], r["end_ms"], r["text"]) for r in c.collect()), [r["warning"] for r in w.collect()]


def test_messy_subtitles(spark):
    body = "﻿1\r\n00:00:00,000 --> 00:00:02,000\r\n<i>Drake</i> walked in.\r\n\r\n00:00:02,000 --> 00:00:05,000\r\n{\\an8}Then he\r\n\r\nsat down again.\r\n\r\n3\r\n00:00:06,000 --> 00:00:05,500\r\nReversed times.\r\n\r\n4\r\n00:00:08,000 --> 00:00:10,000\r\n&amp; entities &quot;too&quot;\r\n"
    got, warnings = parse(spark, body)
    assert [t for *_, t in got] == ["Drake walked in.", "Then he sat down again.", "Reversed times.", '& entities "too"']
    assert got[2][:2] == (6000, 6600) and warnings


def test_overlap_and_nothing(spark):
    got, warnings = parse(spark, "1\n00:00:00,000 --> 00:00:05,000\na b\n\n2\n00:00:03,000 --> 00:00:07,000\nc\n")
    assert got == [(0, 3000, "a b"), (3000, 7000, "c")] and len(warnings) == 1
    got, warnings = parse(spark, "this is not a subtitle file")
    assert not got and "No readable cues" in warnings[0]


def test_strict_srt(spark):
    rows = cues.parse_simple_srt(spark.createDataFrame([("j", "1\n00:00:01,500 --> 00:00:02,000\n<b>Hi</b> there\n\nbad\nblock")], "job_id string, text string")).collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [(1.5, 2.0, "Hi there")]


def test_bytes_are_rounded_as_sql_does(spark):
    """Halves between two numbers of the digits shown, which 150,000 orders at sf0.1 don't have."""
    import duckdb

    n = [0, 512, 1023, 1024, 1536, 2560, 3584, 1048064, 1048575, 1310720, 1835008, 5505024, (1 << 30) - 1, 1 << 30, 5 << 27, 9 << 27, 1207959552 + 134217728, 35713311435, (1 << 50) + (1 << 27), 2**52 + 12345]
    sql = "SELECT CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f', n / 1024.0) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MB' ELSE printf('%.2f', n / 1073741824.0) || ' GB' END FROM (SELECT unnest(?) AS n)"
    got = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "k int, n long").select("k", time.format_bytes(F.col("n")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [r[0] for r in duckdb.connect().execute(sql, [n]).fetchall()]


def test_case_of_all_letters(spark):
    rows = spark.range(1, 0x3000).filter("id < 55296").selectExpr("concat('aB', char(id), 'Z''9', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')) t").unionByName(spark.sql("select 'ABC xyz' t union all select 'Kİé'"))
    t = F.translate(F.col("t"), "‘’", "''")
    old = F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9']+", ""), F.lit("'"))
    bad = rows.filter((text.normalize_word(F.col("t")) != old) | (text.lower(F.col("t")) != F.lower("t")) | (text.upper(F.col("t")) != F.upper("t")))
    assert bad.count() == 0


def test_words_are_normalized_without_tables_of_all_letters():
    assert "lower" not in str(text.normalize_word(F.col("t"))) and "lower" not in str(text.speech_weight(F.col("t")))


def test_words_of_documents_are_counted_without_copies_of_arrays(spark, tmp_path):
    from cuebeam.plans.text_queries import tokenize_words

    every = "".join(map(chr, range(1, 0x300))) + "\u2003\u2028\u3000 a\u00a0b\ufeffc\x85d\x1ce "
    spark.createDataFrame([(every,), ("",), (None,), (" \t",), ("a  a\n",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = tokenize_words(spark, str(tmp_path))
    old = F.filter(F.split("text", "[\\s\u00a0\ufeff]+"), lambda x: x != "")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.explode(old).alias("raw")).groupBy(text.normalize_word(F.col("raw")).alias("norm")).count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "lambdafunction" not in found._jdf.queryExecution().executedPlan().toString()
