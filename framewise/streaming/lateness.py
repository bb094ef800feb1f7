"""Late rows kept apart: what a watermark would drop goes to a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.sources.shared import Store

CLOCK = "batch long, latest timestamp"


class Gate:
    """Parts each batch of a stream at the watermark that it began with: the latest time of the batches before it, less
    ``delay``. Rows before that are refused, all others kept; a null time is refused. Both parts and the clock are written
    by batch number, over what a failed try of that batch has left, so each row is in one of the two tables once."""

    def __init__(self, store: Store, time: str, delay: str):
        self.store, self.time, self.delay = store, time, F.expr(f"interval {delay}")

    def clock(self) -> DataFrame:
        spark = self.store.spark
        if not self.store.exists("clock"):
            return spark.createDataFrame([], CLOCK)
        return spark.read.option("recursiveFileLookup", "true").schema(CLOCK).parquet(self.store.path("clock"))

    def watermark(self, batch: int) -> Column:
        """A batch has one line of the clock, so this is one small read on the driver."""
        latest = self.clock().where(F.col("batch") < batch).agg((F.max("latest") - self.delay).alias("mark")).first()["mark"]
        return F.lit(latest).cast("timestamp")

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.store.path(f"{name}/batch={batch}"))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        mark = self.watermark(batch)
        time = F.col(self.time).cast("timestamp")
        ok = time.isNotNull() & (mark.isNull() | (time >= mark))
        judged = rows.withColumn("ok", ok).withColumn("watermark", mark)
        judged.persist()
        try:
            self._put(judged.where("ok").drop("ok", "watermark"), "kept", batch)
            self._put(judged.where("not ok").drop("ok"), "refused", batch)
            latest = judged.where("ok").agg(F.lit(batch).cast("long").alias("batch"), F.max(time).alias("latest"))
            self._put(latest, "clock", batch)
        finally:
            judged.unpersist()

    def kept(self, like: DataFrame) -> DataFrame:
        return self._of("kept", like)

    def refused(self, like: DataFrame) -> DataFrame:
        return self._of("refused", like.withColumn("watermark", F.lit(None).cast("timestamp")))

    def _of(self, name: str, like: DataFrame) -> DataFrame:
        """The rows of a table with the number of their batch."""
        return self.store.spark.read.schema(like.withColumn("batch", F.lit(0).cast("long")).schema).parquet(self.store.path(name))


def gated(gate: Gate) -> Callable:
    """For ``replayed``: a stream whose batches go through the gate."""
    return lambda stream, store: stream.writeStream.foreachBatch(gate)
