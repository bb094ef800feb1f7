"""The provided tables as the engine's own ones: frames, keyframes, vectors, segments, packets, units, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    i = f"({ts} - timestamp_ntz'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {i}) * 86400000000L + extract(HOUR FROM {i}) * 3600000000L + extract(MINUTE FROM {i}) * 60000000L + cast(extract(SECOND FROM {i}) * 1000000 as bigint)").cast("long")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame: source_id, frame from 0, pts in microseconds, probability as FLOAT, flags."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"),
        (F.row_number().over(by) - 1).cast("long").alias("frame"),
        micros("ts").alias("pts"),
        (F.least("value", F.lit(100.0)) / 100).cast("float").alias("p"),
        (F.col("event_type") == "signup").alias("is_key"),
        (F.col("event_type") == "error").alias("error"),
        "event_type",
        "value",
        "props",
        "event_id",
    )


#: The same in DuckDB's SQL, as the beginning of a WITH list.
FRAMES_SQL = """frames as (select user_id as source_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
 epoch_us(ts) as pts, cast(least(value, 100.0) / 100 as float) as p, event_type = 'signup' as is_key, event_type = 'error' as error,
 event_type, value, props, event_id from events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> cast(x as double))").alias("v"))


VECTORS_SQL = "vectors as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"
