"""Times and grids: as-of lookups, exact rounding to a rational grid, steps, holes, densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_source() -> WindowSpec:
    return Window.partitionBy("source_id").orderBy("frame")


def from_end() -> WindowSpec:
    """A frame and all after it: a window from the first row on in falling order, which is a running one."""
    return Window.partitionBy("source_id").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)


def exact(x: Column | int) -> Column:
    """An integer wide enough for products of 64-bit numbers."""
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")


def floor_div(a: Column, b: Column) -> Column:
    """Exact floor of a / b for b > 0."""
    return ((exact(a) - F.pmod(exact(a), exact(b))) / exact(b)).cast("decimal(38,0)")


def rescaled(value: Column, num: int, den: int) -> Column:
    """value * num / den, rounded half away from zero, exact."""
    v = F.abs(exact(value)) * exact(2 * num) + exact(den)
    return (F.signum(value.cast("double")).cast("long") * floor_div(v, F.lit(2 * den)).cast("long")).cast("long")


def asof_keyframe(frames: DataFrame) -> DataFrame:
    """(source_id, frame, key_pts): the last keyframe at or before each frame's time, -1 where there is none. One sort by
    source and time serves both sides; no range join."""
    by = Window.partitionBy("source_id").orderBy("pts").rangeBetween(Window.unboundedPreceding, 0)
    return frames.select("source_id", "frame", F.coalesce(F.max(F.when(F.col("is_key"), F.col("pts"))).over(by), F.lit(-1).cast("long")).alias("key_pts"))


def first_from_keyframe(frames: DataFrame) -> DataFrame:
    """(source_id, key_pts, frame): for each keyframe time the first frame at or after it. What follows is read from the
    end, so that each window is a running one."""
    by = Window.partitionBy("source_id").orderBy(F.desc("pts")).rangeBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("first", F.min("frame").over(by)).where("is_key").select("source_id", F.col("pts").alias("key_pts"), F.col("first").alias("frame")).distinct()


def steps(frames: DataFrame) -> DataFrame:
    """(source_id, n, least, most) of the steps between consecutive times; a missing time breaks the chain."""
    near = frames.withColumn("step", F.col("pts") - F.lag("pts").over(by_source()))
    return near.groupBy("source_id").agg(F.count("step").alias("n"), F.min("step").alias("least"), F.max("step").alias("most"))


def discontinuity(frames: DataFrame, forward: int, back: int, tolerance: int = 1000) -> DataFrame:
    """(source_id, frame, step): the first step back by more than ``back``, or forward by more than ``forward`` and than
    the source's shortest step and the tolerance."""
    near = frames.withColumn("step", F.col("pts") - F.lag("pts").over(by_source()))
    near = near.withColumn("least", F.min("step").over(Window.partitionBy("source_id")))
    bad = near.where((F.col("step") < -back) | ((F.col("step") > forward) & (F.col("step") > F.col("least") + tolerance)))
    first = bad.groupBy("source_id").agg(F.min(F.struct("frame", "step")).alias("f"))
    return first.select("source_id", "f.frame", "f.step")


def selects(frames: DataFrame) -> DataFrame:
    """(source_id, frame, exact): whether times from the frame's own on select exactly it and those after."""
    before = by_source().rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.max("pts").over(before) < F.col("pts"), F.lit(True)) & (F.min("pts").over(from_end()) == F.col("pts"))
    return frames.select("source_id", "frame", ok.alias("exact"))


def places(frames: DataFrame, period: int) -> DataFrame:
    """Adds ``place`` and ``off``: the nearest place of a grid that starts with the source, the earlier on a tie, and how
    far the time lies behind it. Integers only."""
    start = F.min("pts").over(Window.partitionBy("source_id"))
    after = F.col("pts") - start
    place = (-floor_div(F.lit(period) - 2 * after, F.lit(2 * period))).cast("long")
    return frames.withColumn("place", place).withColumn("off", F.col("pts") - start - place * period)


def summary(placed: DataFrame, allowed: int) -> DataFrame:
    """(source_id, first_place, last_place, most_off, n_off, first_off): of places and their deviations."""
    off = F.abs(F.col("off")) > allowed
    return placed.groupBy("source_id").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.max(F.abs("off")).alias("most_off"), F.count_if(off).alias("n_off"), F.min(F.when(off, F.col("frame"))).alias("first_off"))


def shown(placed: DataFrame) -> DataFrame:
    """One frame a place, the first."""
    by = Window.partitionBy("source_id", "place").orderBy("frame")
    return placed.withColumn("i", F.row_number().over(by)).where("i = 1").drop("i")


def densified(placed: DataFrame) -> DataFrame:
    """(source_id, place, frame, copy): every place from a source's first to its last shows the last frame at or before
    it; ``copy`` counts from 0. Grows by the number of places, which the caller's grid bounds."""
    by = Window.partitionBy("source_id").orderBy("place")
    one = shown(placed).withColumn("next", F.coalesce(F.lead("place").over(by), F.col("place") + 1))
    out = one.select("source_id", "frame", F.col("place").alias("own"), F.explode(F.sequence(F.col("place"), F.col("next") - 1)).alias("place"))
    return out.select("source_id", "place", "frame", (F.col("place") - F.col("own")).alias("copy"))


def spread(placed: DataFrame) -> DataFrame:
    """(source_id, place, p): a frame's value stands on its last copy; the others get the smaller of it and the value
    before."""
    by = Window.partitionBy("source_id").orderBy("place")
    one = shown(placed).withColumn("next", F.coalesce(F.lead("place").over(by), F.col("place") + 1)).withColumn("before", F.lag("p", 1, 0.0).over(by))
    each = one.select("source_id", "p", "before", "next", F.explode(F.sequence(F.col("place"), F.col("next") - 1)).alias("place"))
    return each.select("source_id", "place", F.when(F.col("place") == F.col("next") - 1, F.col("p")).otherwise(F.least("p", "before")).alias("p"))


def holes(placed: DataFrame) -> DataFrame:
    """(source_id, n_runs, first, longest, missing, places): runs of places without a frame of their own."""
    by = Window.partitionBy("source_id").orderBy("place")
    gaps = shown(placed).withColumn("gap", F.lead("place").over(by) - F.col("place") - 1)
    return gaps.groupBy("source_id").agg(F.count_if(F.col("gap") > 0).alias("n_runs"), F.min(F.when(F.col("gap") > 0, F.col("place") + 1)).alias("first"), F.coalesce(F.max("gap"), F.lit(0).cast("long")).alias("longest"), F.coalesce(F.sum("gap"), F.lit(0).cast("long")).alias("missing"), (F.max("place") - F.min("place") + 1).alias("places"))


def running(frames: DataFrame) -> DataFrame:
    """(source_id, frame, highest, lowest_after, error_after)."""
    rest = from_end()
    return frames.select("source_id", "frame", F.max("pts").over(by_source().rowsBetween(Window.unboundedPreceding, 0)).alias("highest"), F.min("pts").over(rest).alias("lowest_after"), F.bool_or("error").over(rest).alias("error_after"))


def constant_rate(frames: DataFrame, allowed: int = 1000) -> DataFrame:
    """Sources whose steps differ by at most ``allowed``."""
    return steps(frames).where(F.col("most") - F.col("least") <= allowed)


def slices(frames: DataFrame, keys: list[str], at: str = "i", first: int = 5, then: int = 4) -> DataFrame:
    """Adds slice, and the rows that pad each shot to ``first`` or that and a multiple of ``then`` frames (one frame
    stays alone): its last frame again. ``at`` counts the frames of a shot from 0."""
    by = Window.partitionBy(*keys)
    n = F.max(at).over(by) + 1
    whole = F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(first), first + F.ceil((n - first) / then) * then))
    last = F.col(at) == F.col("_n") - 1
    places = F.when(last, F.sequence(F.col(at), F.col("_whole") - 1)).otherwise(F.array(F.col(at)))
    out = frames.withColumn("_n", n).withColumn("_whole", whole.cast("long")).withColumn("_place", F.explode(places))
    out = out.withColumn("padded", F.col("_place") >= F.col("_n")).withColumn(at, F.col("_place"))
    return out.withColumn("slice", F.when(F.col(at) < first, F.lit(0)).otherwise(F.floor((F.col(at) - first) / then) + 1).cast("long")).drop("_n", "_whole", "_place")


def causal(sliced: DataFrame, keys: list[str], value: str, reach: int = 2, at: str = "i") -> DataFrame:
    """Adds causal: the mean of a frame and up to ``reach`` before it in its shot, across slices; a shot begins without
    a memory. ``framewise.streaming.detector.causal_slices`` gives the same slice by slice."""
    by = Window.partitionBy(*keys).orderBy(at).rowsBetween(-reach, 0)
    return sliced.withColumn("causal", F.avg(value).over(by))
