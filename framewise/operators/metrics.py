"""Scores and statistics: weighted rates, intervals, histograms, quality between vectors, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import exact, floor_div


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's interval; null for none of none."""
    p, zz = k / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, (centre - spread) / (1 + zz / n)), F.when(n > 0, (centre + spread) / (1 + zz / n))


def rates(labelled: DataFrame, groups: list, hit: Column, true: Column, weight: Column) -> DataFrame:
    """Weighted precision and recall per group; null where there is nothing to divide by."""
    w = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    return labelled.groupBy(*groups).agg(F.try_divide(w(hit & true), w(hit)).alias("precision"), F.try_divide(w(hit & true), w(true)).alias("recall"), F.count("*").alias("n"))


def histogram(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Cumulated counts for fixed bounds, then the total."""
    return [*[F.count_if(value <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds], F.count(value).alias("count")]


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_square(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def psnr(mse: Column, peak: float = 1.0) -> Column:
    """Decibels; at most 100, which equal pictures have."""
    return F.when(mse <= peak * peak * 1e-10, F.lit(100.0)).otherwise(10 * F.log10(peak * peak / mse))


def allocated(strata: DataFrame, size: str, total: int) -> DataFrame:
    """Adds take: ``total`` shared out by size, whole shares first, then one each by the largest remainder, at least one
    each while a stratum has rows. ``strata`` has one row a stratum, so the one-partition window is bounded by them."""
    one = strata.withColumn("_one", F.lit(1))
    whole = F.sum(size).over(Window.partitionBy("_one"))
    one = one.withColumn("_share", floor_div(F.col(size) * total, whole).cast("long")).withColumn("_rest", (exact(F.col(size) * total) % exact(whole)).cast("long"))
    one = one.withColumn("_given", F.sum("_share").over(Window.partitionBy("_one")))
    place = F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("_rest"), *[c for c in strata.columns if c != size]))
    take = F.col("_share") + (place <= total - F.col("_given")).cast("long")
    return one.withColumn("take", F.least(F.greatest(take, F.lit(1).cast("long")), F.col(size))).drop("_one", "_share", "_rest", "_given")


def column_sums(vectors: DataFrame) -> DataFrame:
    """(pos, sum2, count) over all vectors: partial sums in each task, then their sum, so the shuffle carries a row for
    each column and task."""
    return vectors.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x") * F.col("x")).alias("sum2"), F.count("*").alias("count"))
