"""Progress of streaming queries as a table and as a text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

ROWS = "query STRING, batch BIGINT, input_rows BIGINT, rows_per_second DOUBLE, state_rows BIGINT, duration_ms BIGINT"


class Progress(StreamingQueryListener):
    """Keeps each query's last batch and its totals: as many entries as there are queries."""

    def __init__(self):
        self.last: dict[str, tuple] = {}
        self.total: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self.last[name] = (name, p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0), state, (p.durationMs or {}).get("triggerExecution", 0))
        self.total[name] = self.total.get(name, 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.last.values()), ROWS)

    def text(self) -> str:
        """One sample per line, as scrapers read them."""
        out = []
        for name, batch, _, speed, state, took in sorted(self.last.values()):
            for metric, value in (("input_rows_total", self.total[name]), ("batch", batch), ("rows_per_second", speed), ("state_rows", state), ("batch_ms", took)):
                out.append(f'stream_{metric}{{query="{name}"}} {value}')
        return "\n".join([*out, ""])
