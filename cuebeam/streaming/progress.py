"""Progress of running queries as a small table: of each query the last state, which replaces the one before."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query_id string, name string, state string, batch_id long, rows long, rows_total long, rows_per_second double, watermark string, error string, updated_at timestamp"


class ProgressTable(StreamingQueryListener):
    """Writes each query's state below a folder: running after every batch, at last done or failed.

    spark.streams.addListener(ProgressTable(spark, path)); read_progress(spark, path) from anywhere. A row replaces the
    query's last one, so the table has as many rows as there are queries.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.total, self.seen = spark, path.rstrip("/"), {}, {}

    def _put(self, query_id: str, **values) -> None:
        row = self.seen.get(query_id, {"name": None, "state": "started", "batch_id": None, "rows": None, "rows_total": 0, "rows_per_second": None, "watermark": None, "error": None}) | values
        self.seen[query_id] = row
        one = (query_id, *[row[c] for c in ("name", "state", "batch_id", "rows", "rows_total", "rows_per_second", "watermark", "error")], datetime.now(UTC))
        self.spark.createDataFrame([one], PROGRESS).coalesce(1).write.mode("overwrite").json(f"{self.path}/{query_id}")

    def onQueryStarted(self, event) -> None:
        self._put(str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        self.total[key] = self.total.get(key, 0) + p.numInputRows
        self._put(key, name=p.name, state="running", batch_id=p.batchId, rows=p.numInputRows, rows_total=self.total[key], rows_per_second=float(p.processedRowsPerSecond), watermark=p.eventTime.get("watermark"))

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self._put(str(event.id), state="failed" if event.exception else "done", error=event.exception)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(f"{path.rstrip('/')}/*")
