import pytest
from pyspark.sql import functions as F

from cuebeam.sources import files
from cuebeam.streaming import live


def test_manifests_and_listing(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nHi\n")
    (tmp_path / "b.txt").write_text("x")
    assert files.read_subtitles(spark, str(tmp_path / "a.srt")).count() == 1
    assert [r["size"] for r in files.list_objects(spark, str(tmp_path), "*.txt").collect()] == [1]
    (tmp_path / "job.json").write_text('{"job_id": "j", "clips": [{"clip_id": "c", "duration_ms": 5}], "unknown": 1}')
    assert files.read_manifests(spark, str(tmp_path / "job.json")).first()["clips"][0]["duration_ms"] == 5


def test_admission(spark):
    f = spark.createDataFrame([("a.MP4", 1), ("a.MP4", 1), ("b.exe", 2)], "name string, size long")
    assert [(r["kind"], r["safe_name"]) for r in files.admit(f).collect()] == [("video", "a.MP4")]


def test_table(spark, tmp_path):
    t = files.Table(spark, str(tmp_path / "t"), "id string, n long")
    t.insert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"))
    t.upsert(spark.createDataFrame([("b", 5), ("c", 6)], "id string, n long"), "id")
    t.delete(id="a")
    assert [(r["id"], r["n"]) for r in t.select(order_by="n", descending=True).collect()] == [("c", 6), ("b", 5)]


def test_probe(spark):
    log = "Input #0, mov\n Duration: 00:01:02.50, start\n Stream #0:0: Video: h264, yuv420p, 1280x720 [SAR 1:1], 29.97 fps\n Stream #0:1: Audio: aac, 48000 Hz"
    r = files.probe(spark.createDataFrame([("x", log), ("y", "nothing")], "object_id string, log string")).orderBy("object_id").collect()
    assert (r[0]["duration_ms"], r[0]["width"], r[0]["fps"], r[0]["audio_codec"], r[0]["sample_rate"]) == (62500, 1280, 29.97, "aac", 48000)
    assert not r[1]["readable"] and r[1]["duration_ms"] == 0 and not r[1]["has_video"]
    assert spark.range(1).select(files.exact_duration(F.lit("time=00:00:01.50 time=00:00:02.25"))).first()[0] == 2250


@pytest.mark.parametrize("batches", [1, 3])
def test_collapse_live(spark, tmp_path, batches):
    rows = [("j", k, k, e) for k, e in enumerate(["a", "a", None, None, "b", "a", "a"])]
    for b in range(batches):
        part = rows[b * len(rows) // batches : (b + 1) * len(rows) // batches]
        spark.createDataFrame(part, "job_id string, ts long, ord long, entity_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("job_id string, ts long, ord long, entity_id string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    name = f"live{batches}"
    q = live.collapse_live(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ord"] for r in spark.table(name).collect()) == [0, 2, 4, 5]


def test_progress_table(spark, tmp_path):
    """A row for each query: what it has read, and how it ended."""
    import time

    from cuebeam.streaming import progress

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = progress.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        good = source.writeStream.format("noop").queryName("good").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        bad = source.selectExpr("raise_error('no')").writeStream.format("noop").queryName("bad").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        good.awaitTermination()
        with pytest.raises(Exception):  # noqa: B017
            bad.awaitTermination()
        for _ in range(100):
            if {v["state"] for v in listener.seen.values()} == {"done", "failed"} and len(listener.seen) == 2:
                break
            time.sleep(0.3)
        time.sleep(2)
        rows = {r["name"]: r for r in progress.read_progress(spark, str(tmp_path / "progress")).collect()}
    finally:
        spark.streams.removeListener(listener)
    assert set(rows) == {"good", "bad"} and (rows["good"]["state"], rows["good"]["rows_total"], rows["good"]["batch_id"]) == ("done", 30, 2)
    assert rows["bad"]["state"] == "failed" and "no" in rows["bad"]["error"]
