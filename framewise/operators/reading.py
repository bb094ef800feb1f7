"""Ranges of frames read from a keyframe and held against an index, from ever earlier keyframes where they are not its."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.sources.shared import Store


def _with_key(wants: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``_k``, the number of the last keyframe at or before ``first``, null where there is none: one order a source
    over keyframes and ranges together."""
    marks = keys.select("source_id", F.col("frame").alias("_at"), F.lit(0).alias("_kind"), F.col("k").alias("_k"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("end"))
    asked = wants.select("source_id", F.col("first").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_k"), "first", "end")
    by = Window.partitionBy("source_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("_k", F.max("_k").over(by)).where("_kind = 1").select("source_id", "first", "end", "_k")


def verified_ranges(frames: DataFrame, keyframes: DataFrame, index: DataFrame, wants: DataFrame, decoded: Callable[[Column], Column], store: Store) -> DataFrame:
    """(source_id, first, end, tries, start, found): for each of ``wants(source_id, first, end)`` the keyframe from which
    its frames, read in order, are those of ``index(source_id, frame, digest)``, and how many tries that took.

    The first try starts at the last keyframe before the range, the next ones one, two, four, ... keyframes before the one
    before, and the last at the first of all. ``decoded(start)`` is the digest of a row of ``frames(source_id, frame, ...)``
    as it comes out of a read from there. ``found`` is false where no try agrees or a frame is missing. Ranges are unlike one
    another and not empty. Each round reads only what the ranges that are still open ask for, so the rounds are as many as
    the number of keyframes has digits in binary, however many ranges there are."""
    keys = store.stage(keyframes.select("source_id", "frame").distinct().withColumn("k", (F.row_number().over(Window.partitionBy("source_id").orderBy("frame")) - 1).cast("long")), "keys")
    open_ = store.stage(_with_key(wants, keys).withColumns({"_step": F.lit(1).cast("long"), "tries": F.lit(1)}), "open")
    done = [open_.where("_k is null").select("source_id", "first", "end", F.lit(0).alias("tries"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("found"))]
    open_ = open_.where("_k is not null")
    of, told = ["source_id", "first", "end"], index.select("source_id", "frame", F.col("digest").alias("_told"))
    while not open_.isEmpty():
        placed = open_.join(keys.select("source_id", F.col("k").alias("_k"), F.col("frame").alias("start")), ["source_id", "_k"])
        read = placed.withColumn("frame", F.explode(F.sequence("first", F.col("end") - 1))).hint("merge").join(frames, ["source_id", "frame"])  # larger than Spark takes it for
        same = read.withColumn("_seen", decoded(F.col("start"))).join(told, ["source_id", "frame"], "left").groupBy(*of).agg(F.count_if(F.col("_seen").eqNullSafe(F.col("_told"))).alias("_same"))
        judged = store.stage(placed.join(same, of, "left").withColumn("found", F.coalesce("_same", F.lit(0)) == F.col("end") - F.col("first")), "judged")
        over = F.col("found") | (F.col("_k") == 0)
        done.append(judged.where(over).select(*of, "tries", "start", "found"))
        back = F.greatest(F.col("_k") - F.col("_step"), F.lit(0).cast("long"))
        open_ = judged.where(~over).select(*of, back.alias("_k"), (F.col("_step") * 2).alias("_step"), (F.col("tries") + 1).alias("tries"))
    return reduce(DataFrame.unionByName, done)
