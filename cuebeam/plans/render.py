"""Resumable rendering state: what a step does next, kept in a small table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.operators.shots import frame_spans


def start(shots: DataFrame, fps: int) -> DataFrame:
    """The initial state of each job: frames of its shots frozen, nothing done."""
    rows = frame_spans(shots, fps).groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "frames"))), lambda x: x["frames"]).alias("frames"))
    zero = F.lit(0).cast("long")
    return rows.select("job_id", "frames", zero.alias("next_shot"), zero.alias("assembled_up_to"), F.array().cast("array<string>").alias("parts"), zero.alias("work_ms"))


def phase(state: DataFrame) -> DataFrame:
    """state with phase: encode, then assemble, then finalise."""
    n = F.size("frames")
    return state.withColumn("phase", F.when(F.col("next_shot") < n, "encode").when(F.col("assembled_up_to") < n, "assemble").otherwise("finalise"))


def advance(state: DataFrame, batch: int = 8, part: int = 40) -> DataFrame:
    """state after one step of each job: a batch of shots encoded, or a part assembled. A step done twice gives the same state."""
    n, p = F.size("frames").cast("long"), phase(state)
    return p.select(
        "job_id", "frames", F.when(F.col("phase") == "encode", F.least(n, F.col("next_shot") + batch)).otherwise(F.col("next_shot")).alias("next_shot"),
        F.when(F.col("phase") == "assemble", F.least(n, F.col("assembled_up_to") + part)).otherwise(F.col("assembled_up_to")).alias("assembled_up_to"),
        F.when(F.col("phase") == "assemble", F.concat("parts", F.array(F.concat(F.lit("part_"), F.lpad(F.size("parts").cast("string"), 4, "0"))))).otherwise(F.col("parts")).alias("parts"), "work_ms",
    )


@dataclass
class Loop:
    """Steps until every job is finished; save writes a state and returns it as read again, so that a restart goes on there."""

    save: Callable[[DataFrame], DataFrame]
    batch: int = 8
    part: int = 40

    def run(self, state: DataFrame, most: int = 10_000) -> DataFrame:
        for _ in range(most):
            if phase(state).filter("phase <> 'finalise'").isEmpty():
                return state
            state = self.save(advance(state, self.batch, self.part))
        raise RuntimeError("rendering did not finish")
