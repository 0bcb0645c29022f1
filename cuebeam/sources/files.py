"""Reading and writing: subtitle files, manifests, listings, concat lists, project tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebeam.functions.text import media_type, safe_filename

MANIFEST = (
    "job_id string, name string, stage string, created_at long, clips array<struct<clip_id:string,filename:string,key:string,duration_ms:bigint,width:int,height:int,fps:double,has_audio:boolean,tags:array<string>,entity_ids:array<string>>>, "
    "shots array<struct<segment_index:bigint,start_ms:bigint,end_ms:bigint,clip_id:string>>, output string, render struct<next_shot:bigint,assembled_up_to:bigint,frames:array<bigint>,parts:array<string>,work_ms:bigint>"
)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Whole subtitle files as job_id (the file's path) and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("job_id"), F.col("value").alias("text"))


def read_manifests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Job manifests under a fixed schema: one JSON document a file or, as write_manifests() writes them, a line."""
    return spark.read.schema(MANIFEST).json(path, multiLine=not lines)


def write_manifests(jobs: DataFrame, path: str) -> None:
    """Manifests as JSON lines. Spark's commit protocol makes the files appear whole or not at all."""
    jobs.write.mode("overwrite").json(path)


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key and size of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"))


def admit(files: DataFrame) -> DataFrame:
    """files (name, size) of an admitted type, with kind and a safe name; one of each name and size."""
    kind = media_type(F.col("name"))
    return files.dropDuplicates(["name", "size"]).withColumns({"kind": kind, "safe_name": safe_filename(F.col("name"), F.lit("file"))}).filter("kind is not null")


def concat_line(path: Column) -> Column:
    """A line of an encoder's concat list, quotes escaped."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def write_concat_list(parts: DataFrame, path: str) -> None:
    """One list a job, its parts (job_id, ord, path) in order."""
    lines = parts.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", concat_line(F.col("path")).alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("job_id").text(path)


#: How an encoder prints a file's length and streams.
LENGTH = r"Duration:\s*(\d+):(\d+):(\d+)\.(\d+)"
VIDEO_LINE, FRAME_SIZE, FRAME_RATE = r"(Stream #\d+:\d+.*?: Video: [^\s,]+.*)", r"[,\s](\d{2,5})x(\d{2,5})[\s,]", r"([\d.]+)\s*fps"
VIDEO_CODEC, AUDIO_CODEC = r"Stream #\d+:\d+.*?: Video: ([^\s,]+)", r"Stream #\d+:\d+.*?: Audio: ([^\s,]+)"
AUDIO_LINE, SAMPLE_RATE, HEADER = r"(Audio:.*)", r"(\d{3,6})\s*Hz", "Input #0"


def probe(logs: DataFrame) -> DataFrame:
    """Columns of media files from the text an encoder prints about them (object_id, log). Null where it can't be read."""
    got = lambda pattern, k=1: F.regexp_extract("log", pattern, k)
    number = lambda c, t="long": F.nullif(c, F.lit("")).try_cast(t)
    part = lambda k: number(got(LENGTH, k))
    duration = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.substring(F.rpad(got(LENGTH, 4), 3, "0"), 1, 3).try_cast("long")
    video = got(VIDEO_LINE)
    size = lambda k: number(F.regexp_extract(video, FRAME_SIZE, k), "int")
    codec = F.nullif(got(VIDEO_CODEC), F.lit(""))
    audio = F.nullif(got(AUDIO_CODEC), F.lit(""))
    return logs.select(
        "object_id", F.coalesce(duration, F.lit(0)).alias("duration_ms"), F.coalesce(size(1), F.lit(0)).alias("width"), F.coalesce(size(2), F.lit(0)).alias("height"),
        F.coalesce(number(F.regexp_extract(video, FRAME_RATE, 1), "double"), F.lit(0.0)).alias("fps"), codec.isNotNull().alias("has_video"), audio.isNotNull().alias("has_audio"),
        codec.alias("video_codec"), audio.alias("audio_codec"), number(F.regexp_extract(got(AUDIO_LINE), SAMPLE_RATE, 1), "int").alias("sample_rate"), F.col("log").contains(HEADER).alias("readable"),
    )


def exact_duration(log: Column) -> Column:
    """The latest time= stamp of a decoding log in milliseconds; 0 without any."""
    stamps = F.regexp_extract_all(log, F.lit(r"time=\s*(\d+:\d+:\d+\.\d+)"), F.lit(1))

    def ms(s: Column) -> Column:
        p = F.split(s, "[:.]")
        return (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")) * 1000 + F.substring(F.rpad(p[3], 3, "0"), 1, 3).cast("long")

    return F.coalesce(F.array_max(F.transform(stamps, ms)), F.lit(0).cast("long"))


def timeline_export(items: DataFrame) -> DataFrame:
    """job_id and project: a nested JSON document of each job's items (ord, clip, duration_ms) with running offsets."""
    from pyspark.sql import Window

    before = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("offset_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).cast("long"))
    one = F.struct("ord", "clip", "offset_ms", "duration_ms")
    return rows.groupBy("job_id").agg(F.to_json(F.struct(F.sum("duration_ms").alias("duration_ms"), F.sort_array(F.collect_list(one)).alias("items"))).alias("project"))


PROJECT_TABLES = {
    "projects": "id string, name string, status string, characters array<string>, created_at timestamp",
    "project_clips": "project_id string, clip_index int, filename string, script_matches string, face_results string, duration decimal(12,3)",
    "characters": "id string, name string, role string, descriptors array<array<float>>, created_at timestamp",
}


def create_project_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in PROJECT_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


class Table:
    """Select, insert, upsert and delete on a Parquet folder; changes write a new copy beside the old and swap it in."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.columns = T.StructType.fromDDL(schema).names
        self._mend()

    def _mend(self) -> None:
        """Bring back the table that a crash in the middle of a swap left aside."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        own, aside = (jvm.org.apache.hadoop.fs.Path(self.path + end) for end in ("", ".before"))
        fs = own.getFileSystem(conf)
        if fs.exists(aside) and not fs.exists(own):
            fs.rename(aside, own)

    def select(self, order_by: str | None = None, descending: bool = False, **equal) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        for k, v in equal.items():
            rows = rows.filter(F.col(k) == v)
        return rows.orderBy(F.desc(order_by) if descending else order_by) if order_by else rows

    def insert(self, rows: DataFrame) -> None:
        rows.select(*self.columns).write.mode("append").parquet(self.path)

    def _swap(self, rows: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        old, new = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(self.path + ".next")
        fs = old.getFileSystem(conf)
        aside = jvm.org.apache.hadoop.fs.Path(self.path + ".before")
        rows.write.mode("overwrite").parquet(str(new))
        # at every moment a whole table lies under one of the names; _mend() finds it after a crash
        fs.delete(aside, True)
        fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)
        self.spark.catalog.refreshByPath(self.path)

    def delete(self, **equal) -> None:
        hit = F.lit(True)
        for k, v in equal.items():
            hit = hit & F.col(k).eqNullSafe(F.lit(v))
        self._swap(self.select().filter(~hit))

    def upsert(self, rows: DataFrame, key: str) -> None:
        self._swap(self.select().join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows))
