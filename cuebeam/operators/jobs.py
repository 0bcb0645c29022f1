"""Jobs as a table: listing, retention, logs, settings and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(jobs: DataFrame, limit: int = 20, created: str = "created_at", key: str = "job_id") -> DataFrame:
    """The newest jobs, each once; ties go to the smaller id. A top-k in every task, merged: no full sort."""
    return jobs.dropDuplicates([key]).orderBy(F.desc(created), key).limit(limit)


def retain(jobs: DataFrame, cutoff: Column, created: str = "created_at") -> DataFrame:
    """Jobs not older than the cutoff."""
    return jobs.filter(F.col(created) >= cutoff)


def last_logs(logs: DataFrame, keep: int = 200, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The last entries of each job's log."""
    w = Window.partitionBy("job_id").orderBy(*[F.desc(c) for c in order])
    return logs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def summary(jobs: DataFrame) -> DataFrame:
    """id, name, stage, numbers of clips and shots, and whether there is an output."""
    return jobs.select("job_id", "name", "stage", "created_at", F.size("clips").alias("clips"), F.size("shots").alias("shots"), F.col("output").isNotNull().alias("done"))


def register_new(known: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """found rows whose key is not known yet, each key once."""
    return found.join(known.select(key), key, "left_anti").dropDuplicates([key])


def settings(overrides: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Overrides with defaults where they are null."""
    return overrides.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def stream_compatible(probes: DataFrame) -> DataFrame:
    """job_id and compatible: whether all of a job's files have one codec, size and sound, and frame rates within 0.05.

    A file that could not be read makes its job incompatible; a missing frame rate agrees with any.
    """
    first = lambda c: F.min_by(c, "ord")
    refs = probes.groupBy("job_id").agg(*[first(F.struct(c)).alias(f"r_{c}") for c in ("codec", "width", "height", "fps", "audio_codec", "sample_rate")])
    rows = probes.join(refs, "job_id")
    same = F.col("codec").isNotNull()
    for c in ("codec", "width", "height", "audio_codec", "sample_rate"):
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}.{c}"))
    same = same & F.coalesce(F.abs(F.col("fps") - F.col("r_fps.fps")) < 0.05, F.lit(True))
    return rows.groupBy("job_id").agg(F.every(same).alias("compatible"))
