"""Fitting work into memory: needs by phase, the first setting that fits, the largest one, the fewest parts moved away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worst_need(needs: DataFrame, keys: list[str], need: str = "need") -> DataFrame:
    """(keys, need): the most that any row of ``needs`` asks for."""
    return needs.groupBy(*keys).agg(F.max(need).alias("need"))


def first_fit(needs: DataFrame, free: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, tight): of the settings of ``needs(keys, rank, phase, need)``, tried by rising rank, the first whose
    every phase fits into ``free(phase, bytes)``; ``tight`` is the phase that has least left under it. Both are null where
    no setting fits. ``free`` is a table of phases, of which there are a few; one that it does not name has nothing free.
    """
    left = needs.join(F.broadcast(free), "phase", "left").withColumn("left", F.coalesce("bytes", F.lit(0).cast("long")) - F.col("need"))
    settings = left.groupBy(*keys, "rank").agg(F.min(F.struct("left", "phase")).alias("worst"))
    best = F.min(F.when(F.col("worst.left") >= 0, F.struct("rank", F.col("worst.phase").alias("tight"))))
    return settings.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.rank", "best.tight")


def first_fit_of(jobs: DataFrame, keys: list[str], settings: list, rank, needs: dict, free: dict[str, int]) -> DataFrame:
    """``first_fit`` for needs that are formulas: (keys, rank, tight) of ``jobs``, a row each. Of the plain ``settings``, tried
    by rising ``rank(setting)``, the first whose every phase of ``needs`` (name: need(setting), a column) fits into ``free``
    (name: bytes). A job looks at its settings in its own row, so none are exploded, sorted or shuffled."""
    out = F.lit(None)
    for setting in sorted(settings, key=rank, reverse=True):
        left = [F.struct((F.lit(free.get(name, 0)).cast("long") - need(setting)).alias("left"), F.lit(name).alias("phase")) for name, need in needs.items()]
        worst = F.array_min(F.array(*left))
        out = F.when(worst["left"] >= 0, F.struct(F.lit(rank(setting)).cast("long").alias("rank"), worst["phase"].alias("tight"))).otherwise(out)
    return jobs.select(*keys, out.alias("best")).select(*keys, "best.rank", "best.tight")


def largest_with_fewest(jobs: DataFrame, keys: list[str], caps: Column, most_away: int, need, budget: Column) -> DataFrame:
    """(keys, cap, away): the largest of ``caps`` (an array) that fits into ``budget`` with up to ``most_away`` parts moved
    away, and the fewest that it takes; ``need(cap, away)`` is a column that falls as ``away`` rises. So a cap fits if it does
    with all parts away, and a job looks at each cap and at each number of parts once, in its own row. Jobs that nothing fits
    are left out."""
    most = F.array_max(F.filter(caps, lambda cap: need(cap, F.lit(most_away)) <= budget))
    best = jobs.withColumn("cap", most).where("cap is not null")
    fewest = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(most_away)), lambda away: need(F.col("cap"), away) <= budget))
    return best.withColumn("away", fewest).select(*keys, "cap", "away")
