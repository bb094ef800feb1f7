"""Progress of a running stream as a table that others can read meanwhile."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from framewise.sources.shared import Store

LINE = "run string, batch long, rows long, done long, ended boolean, seconds double"


class Progress(StreamingQueryListener):
    """Adds a line to the table ``progress`` of the store for each batch that has rows, as Spark reports it: how many rows
    it had, what is done (the sum of the observed metric ``done`` or, without one, of the rows), and seconds since the
    start. The end of a run is a line, too. Runs of others are left alone."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.runs: dict[str, tuple[float, int]] = {}
        self.over = threading.Event()

    def _add(self, run: str, batch: int, rows: int, done: int, ended: bool) -> None:
        line = [(run, batch, rows, done, ended, time.monotonic() - self.runs[run][0])]
        self.store.spark.createDataFrame(line, LINE).coalesce(1).write.mode("append").parquet(self.store.path("progress"))

    def onQueryStarted(self, event) -> None:
        if event.name and event.name.startswith(self.name):
            self.runs[str(event.runId)] = (time.monotonic(), 0)

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        if run in self.runs and p.numInputRows:
            seen = p.observedMetrics.get("progress")
            done = self.runs[run][1] + (seen["done"] if seen else p.numInputRows)
            self.runs[run] = (self.runs[run][0], done)
            self._add(run, p.batchId, p.numInputRows, done, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if run in self.runs:
            self._add(run, -1, 0, self.runs[run][1], True)
            self.over.set()

    def lines(self) -> DataFrame:
        """What has been said so far; none before the first batch is through."""
        spark = self.store.spark
        if not self.store.exists("progress"):
            return spark.createDataFrame([], LINE)
        return spark.read.schema(LINE).parquet(self.store.path("progress"))


def remaining(lines: DataFrame, whole: int) -> DataFrame:
    """(batch, rows, done, share, left, seconds_left): what a run of ``whole`` rows still has to do after each batch, and how
    long that takes at its pace so far."""
    said = lines.where("not ended")
    share = F.col("done") / F.lit(float(max(whole, 1)))
    return said.select("batch", "rows", "done", share.alias("share"), (F.lit(whole) - F.col("done")).alias("left"), F.try_divide(F.col("seconds") * (F.lit(whole) - F.col("done")), F.col("done")).alias("seconds_left"))


def watched(rows: DataFrame, batch: str, store: Store, write) -> Progress:
    """Runs ``write`` over ``rows`` as one stream, a file a batch, with its progress in the table; waits for its end and for
    the last line. The rows of a batch come together in one file, as a trigger reads whole files: a batch's size is the
    caller's choice."""
    spark, name = rows.sparkSession, f"watched-{uuid.uuid4().hex}"
    for _, part in sorted(((i, rows.where(F.col(batch) == i)) for (i,) in rows.select(batch).distinct().collect()), key=lambda x: x[0]):
        part.coalesce(1).write.mode("append").parquet(store.path("in"))
    progress = Progress(store, name)
    spark.streams.addListener(progress)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(store.path("in"))
        stream = stream.observe("progress", F.count(F.lit(1)).alias("done"))
        run = write(stream, store).queryName(name).option("checkpointLocation", store.path("state")).trigger(availableNow=True).start()
        run.awaitTermination()
        progress.over.wait(60)
    finally:
        spark.streams.removeListener(progress)
    return progress
