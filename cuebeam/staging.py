"""Written stages: a table in the folder that all executors share, read again in place of its lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only where the setting is absent (tests in one JVM) a local folder is chosen.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "cuebeam-stages")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before the process
            return


atexit.register(_sweep)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, of no table yet, that goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran. The
    table goes when the process ends, or earlier through drop().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(staged: DataFrame) -> None:
    """Remove a table made by stage() that nothing reads any more."""
    path = getattr(staged, "_stage_path", None)
    if path:
        _remove(staged.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]
