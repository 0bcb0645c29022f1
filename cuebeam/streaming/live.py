"""Streaming forms of collapse, carry and windowed counts over live mentions. An extension: batch is the model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collapse_live(events: DataFrame) -> DataFrame:
    """Changes of each job's entity, as they come: events (job_id, ts, ord, entity_id) whose entity is not the one before.

    Only the last entity of a job is kept as state. Within a micro-batch rows are ordered by (ts, ord).
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"], kind="stable")
        known, last = state.exists, state.get[0] if state.exists else None
        keep = []
        for e in rows["entity_id"].where(rows["entity_id"].notna(), None):
            keep.append(not known or e != last)
            known, last = True, e
        state.update((last,))
        yield rows[keep][["job_id", "ts", "ord", "entity_id"]]

    types = dict(events.dtypes)
    schema = f"job_id {types['job_id']}, ts {types['ts']}, ord {types['ord']}, entity_id string"
    return events.select("job_id", "ts", "ord", "entity_id").groupBy("job_id").applyInPandasWithState(run, schema, "entity_id string", "append", GroupStateTimeout.NoTimeout)


def mention_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Mentions of each entity in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "entity_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entity_id", "n")


def sessions(events: DataFrame, gap: str = "9 seconds", late: str = "5 minutes") -> DataFrame:
    """Stretches in which one entity is mentioned again before a gap passes."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "job_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).select("job_id", "entity_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
