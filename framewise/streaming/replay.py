"""Tables replayed as streams: one batch of files after the other, each run going on from the checkpoint of the last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from framewise.sources.shared import Store

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a whole stream for which a partition of its state is worth what opening and committing it costs each batch.
STATE_ROWS = 200_000


@contextmanager
def keyed_state(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Streams started within keep their state by key in RocksDB, which state variables and timers need. With ``rows``, how
    many will come in all, the state has a partition for ``STATE_ROWS`` of them, at least one a core, and no more than the
    session shuffles to."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if rows is not None:
        name = "spark.sql.shuffle.partitions"
        wanted[name] = str(min(int(spark.conf.get(name)), max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))))
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrivals(rows: DataFrame, batch: str, store: Store) -> Iterator[tuple[int, DataFrame]]:
    """The rows of each batch in turn, written once by batch, so that a batch's files are read alone."""
    kept = store.write(rows, "arrivals", batch)
    for (i,) in sorted(kept.select(batch).distinct().collect()):  # one number a batch
        yield i, kept.where(F.col(batch) == i)


def replayed(rows: DataFrame, batch: str, write: Callable[[DataFrame, Store], DataStreamWriter], store: Store, seen: Callable[[StreamingQuery, int], None] | None = None) -> None:
    """Sends ``rows`` batch by batch through the stream that ``write`` makes; ``seen`` is called after each batch."""
    spark = rows.sparkSession
    parts = list(arrivals(rows, batch, store))  # a lazy read a batch
    with keyed_state(spark, store.read(rows, "arrivals").count()):
        for i, part in parts:
            part.write.mode("append").parquet(store.path("in"))
            stream = spark.readStream.schema(rows.schema).parquet(store.path("in"))
            run = write(stream, store).option("checkpointLocation", store.path("state")).trigger(availableNow=True).start()
            run.awaitTermination()
            if seen:
                seen(run, i)


def to_table(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, Store], DataStreamWriter]:
    """A stream whose rows are appended to the table ``out`` of the store."""
    return lambda stream, store: make(stream).writeStream.format("parquet").option("path", store.path("out")).outputMode("append")
