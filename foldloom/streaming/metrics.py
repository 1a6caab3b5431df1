"""Run metrics of streaming queries as rows: name, start_us, end_us, niter, in_rows, out_rows, stop."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "name string, start_us long, end_us long, niter long, in_rows long, out_rows long, stop string"


class Recorder(StreamingQueryListener):
    """Keeps one row for each batch of each query, for the last `max_age` seconds."""

    def __init__(self, max_age: float = 1200.0):
        self.max_age, self.rows, self.names = max_age, [], {}

    def _add(self, row: tuple) -> None:
        self.rows.append(row)
        oldest = time.time() * 1e6 - self.max_age * 1e6
        self.rows = [r for r in self.rows if r[2] >= oldest]

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        start = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1e6)
        took = int(p.durationMs.get("triggerExecution", 0)) * 1000
        stop = "nodata" if p.numInputRows == 0 else "max"
        self._add((p.name or str(p.id), start, start + took, 1, int(p.numInputRows), max(0, int(p.sink.numOutputRows)), stop))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        now = int(time.time() * 1e6)
        self._add((self.names.get(str(event.runId), str(event.id)), now, now, 0, 0, 0, "error" if event.exception else "end"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
