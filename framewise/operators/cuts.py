"""Shots from detector scores: runs over a threshold, their peaks, cuts and the spans between them.

All functions take one row a frame with ``source_id, frame, p`` and work within a source, so one shuffle by source
serves the whole chain. p is FLOAT and compared as its exact double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_source() -> WindowSpec:
    return Window.partitionBy("source_id").orderBy("frame")


def detections(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Frames that reach the threshold."""
    return frames.where(F.col("p").cast("double") >= F.lit(threshold))


def runs(frames: DataFrame, flag: Column, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Adds ``island``: equal for frames in a row whose flag holds; other frames are dropped."""
    by = Window.partitionBy(*keys).orderBy("frame")
    return frames.where(flag).withColumn("island", F.col("frame") - F.row_number().over(by))


def peaks(frames: DataFrame, threshold: float) -> DataFrame:
    """(source_id, first, last, frame, p): of each run over the threshold its bounds and its highest frame, the first of
    equals."""
    best = F.min(F.struct((-F.col("p")).alias("m"), F.col("frame").alias("frame"), F.col("p").alias("p")))
    found = runs(frames, F.col("p").cast("double") >= F.lit(threshold)).groupBy("source_id", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), best.alias("b"))
    return found.select("source_id", "first", "last", F.col("b.frame").alias("frame"), F.col("b.p").alias("p"))


def possible(frames: DataFrame, threshold: float = 0.3, floor: float = 0.1) -> DataFrame:
    """Peaks of runs over the floor that stay below the threshold."""
    return peaks(frames, floor).where(F.col("p").cast("double") < F.lit(threshold))


def cuts(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(source_id, cut, p): a cut is the frame after a peak; a peak on a source's last frame gives none."""
    lasts = frames.groupBy("source_id").agg(F.max("frame").alias("end"))
    found = peaks(frames, threshold).select("source_id", (F.col("frame") + 1).alias("cut"), "p")
    return found.join(lasts, "source_id").where(F.col("cut") <= F.col("end")).drop("end")


def shots(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(source_id, shot, start, end), half open, from 0 to the number of frames."""
    counts = frames.groupBy("source_id").agg((F.max("frame") + 1).alias("n"))
    starts = cuts(frames, threshold).select("source_id", F.col("cut").alias("start")).unionByName(counts.select("source_id", F.lit(0).cast("long").alias("start")))
    by = Window.partitionBy("source_id").orderBy("start")
    out = starts.join(counts, "source_id").select("source_id", (F.row_number().over(by) - 1).cast("long").alias("shot"), "start", F.coalesce(F.lead("start").over(by), F.col("n")).alias("end"))
    return out


def with_shot(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds ``shot`` to every frame, without a range join: cuts are joined on the frame and counted up to it."""
    marked = frames.join(cuts(frames, threshold).select("source_id", F.col("cut").alias("frame"), F.lit(1).alias("is_cut")), ["source_id", "frame"], "left")
    return marked.withColumn("shot", F.count("is_cut").over(by_source().rowsBetween(Window.unboundedPreceding, 0)))


def local_maxima(frames: DataFrame, floor: float = 0.1) -> DataFrame:
    """Frames above the frame before, not below the one after, and over the floor."""
    near = frames.withColumn("before", F.lag("p").over(by_source())).withColumn("after", F.lead("p").over(by_source()))
    p = F.col("p")
    return near.where((p.cast("double") > floor) & (F.col("before").isNull() | (p > F.col("before"))) & (F.col("after").isNull() | (p >= F.col("after")))).drop("before", "after")


def neighbour_ratio(frames: DataFrame, value: str) -> DataFrame:
    """Adds ``ratio``: a value over the mean of its two neighbours on each side, at most 255; null near the ends and
    where the neighbours are all zero."""
    five = by_source().rowsBetween(-2, 2)
    around = (F.sum(value).over(five) - F.col(value)) / 4
    return frames.withColumn("ratio", F.when((F.count(value).over(five) == 5) & (around != 0), F.least(F.col(value) / around, F.lit(255.0))))


def truncated(p: Column, places: int = 3) -> Column:
    """A probability as text, cut off after some places, never rounded up."""
    exact = p.cast("double").cast("decimal(38,18)")
    return F.format_string(f"%.{places}f", (F.floor(exact * 10**places) / 10**places).cast("double"))


def timecode(millis: Column) -> Column:
    """H:MM:SS.mmm"""
    return F.format_string("%d:%02d:%02d.%03d", F.floor(millis / 3600000), F.floor(millis / 60000) % 60, F.floor(millis / 1000) % 60, millis % 1000)


def playlist(marks: DataFrame, before: int = 1000, after: int = 3000) -> DataFrame:
    """Adds start and stop in milliseconds around ``at``, within 0 and ``last``."""
    return marks.withColumn("start_ms", F.greatest(F.col("at") - before, F.lit(0))).withColumn("stop_ms", F.least(F.col("at") + after, F.col("last")))


def reach(frames: DataFrame, bad: Column, calm: int = 3) -> DataFrame:
    """(source_id, shot, reach): frames from a shot's start until ``calm`` frames in a row are not bad; null if never."""
    by = Window.partitionBy("source_id", "shot").orderBy("frame")
    seen = frames.withColumn("d", F.row_number().over(by) - 1).withColumn("b", F.count_if(bad).over(by.rowsBetween(0, calm - 1))).withColumn("n", F.count("*").over(by.rowsBetween(0, calm - 1)))
    return seen.groupBy("source_id", "shot").agg(F.min(F.when((F.col("b") == 0) & (F.col("n") == calm), F.col("d"))).cast("long").alias("reach"))


def moving_mean(frames: DataFrame, value: str, low: int = 2, high: int = 2) -> DataFrame:
    """Adds ``mean``: over a centred window that never crosses a cut; NaN values don't count."""
    by = Window.partitionBy("source_id", "shot").orderBy("frame").rowsBetween(-low, high)
    return frames.withColumn("mean", F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).over(by))


def slid(frames: DataFrame, window: int = 100, step: int = 50, pad: int = 25) -> DataFrame:
    """(source_id, window, position, frame): windows of ``window`` frames of which the middle ``step`` are scored, edges
    clamped, every frame scored once."""
    counts = frames.groupBy("source_id").agg((F.max("frame") + 1).alias("n"))
    wins = counts.select("source_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / step).cast("int") - 1)).alias("window"))
    each = wins.select("source_id", "n", F.col("window").cast("long").alias("window"), F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("position"))
    at = F.col("window") * step - pad + F.col("position")
    return each.select("source_id", "window", F.col("position").cast("long").alias("position"), F.least(F.greatest(at, F.lit(0).cast("long")), F.col("n") - 1).alias("frame"))
