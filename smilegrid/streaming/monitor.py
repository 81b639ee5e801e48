"""Watching streams: bounded histories of metrics and alerts, and limits that stop a query."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: How many metrics and alerts are remembered.
MOST_METRICS, MOST_ALERTS = 10_000, 5_000


def watched(frame: DataFrame, name: str = "limits", **metrics: Column) -> DataFrame:
    """``frame`` with aggregates that each batch reports to a monitor while it runs; nothing is read twice."""
    return frame.observe(name, F.count("*").alias("rows"), *[c.alias(k) for k, c in metrics.items()])


class Monitor(StreamingQueryListener):
    """Keeps each batch's metrics, raises alerts where a limit is broken, and stops the query where a limit says so.

    ``limits`` has for each alert (is it broken by these metrics?, does it stop the query?); metrics are batch, input_rows and what
    ``watched`` reports, absent ones are None. Histories are cut to their newest entries. A listener must not wait for its query, so stopping is left to a thread.
    """

    def __init__(self, spark: SparkSession, limits: dict[str, tuple[Callable[[dict], bool], bool]], *, name: str = "limits", most_metrics: int = MOST_METRICS, most_alerts: int = MOST_ALERTS) -> None:
        self.spark, self.limits, self.name = spark, limits, name
        self.metrics: deque[dict] = deque(maxlen=most_metrics)
        self.alerts: deque[dict] = deque(maxlen=most_alerts)
        self.stopped: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802  (Spark's names)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        row = {"query": str(p.id), "batch": p.batchId, "input_rows": p.numInputRows} | (seen.asDict() if seen is not None else {})
        self.metrics.append(row)
        for alert, (broken, stops) in self.limits.items():
            if not broken(row):
                continue
            self.alerts.append({"query": row["query"], "batch": row["batch"], "alert": alert, "level": "CRITICAL" if stops else "WARNING"})
            if stops and row["query"] not in self.stopped:
                self.stopped[row["query"]] = alert
                threading.Thread(target=self._stop, args=(row["query"],), daemon=True).start()

    def _stop(self, query: str) -> None:
        found = self.spark.streams.get(query)
        if found is not None:
            found.stop()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def table(self, kind: str = "metrics") -> DataFrame:
        """The history as a table (one JSON text a row, ready for ``write.text``: a JSONL file)."""
        return self.spark.createDataFrame([(json.dumps(r, default=str),) for r in getattr(self, kind)], "value string")
