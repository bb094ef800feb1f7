"""Draws that a hash decides, so that every engine and every retry makes the same ones: bootstraps, samples, and rates at
every threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.sources.shared import Store

from .metrics import allocated

SPACE = 1 << 32


def lot(*parts: Column | str | int) -> Column:
    """A number below 2 ** 32 that the parts decide: the first eight hex digits of the MD5 of them, joined by colons."""
    texts = [(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 8), 16, 10).cast("long")


def poisson_bounds(most: int = 12) -> list[int]:
    """A lot below the k-th bound is a count of at most k, Poisson with mean one; counts above ``most`` have a chance below
    one in 10 ** 10 and are ``most`` + 1."""
    total, out = 0.0, []
    for k in range(most + 1):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * SPACE))
    return out


def times(number: Column) -> Column:
    """How often a row is drawn."""
    out = F.lit(len(poisson_bounds()))
    for k, bound in reversed([*enumerate(poisson_bounds())]):
        out = F.when(number < bound, k).otherwise(out)
    return out


def stratified(labelled: DataFrame, sizes: DataFrame, stratum: list[str], row: list[str], truth: str, rules: list[str], reference: str, draws: int = 200, seed: int = 0, span: float = 0.9) -> DataFrame:
    """(rule, metric, point, low, high, difference, difference_low, difference_high): recall and precision of each boolean
    column ``rules`` against ``truth``, over rows that were labelled within strata of ``sizes(<stratum>, size)``, with
    bootstrap intervals of ``span``, also for the difference to the rule ``reference`` in the same draws.

    A draw takes each row a number of times that its lot says, independently of all others, and then scales each stratum to
    its size; so draws are partial sums, with one row a stratum and draw left to shuffle, and no stratum has to meet in one
    task. Draw 0 is the rows as they are. A metric is null where there is nothing to divide by, and such draws don't count
    for its interval."""
    drawn = labelled.select(*stratum, *row, truth, *rules, F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    w = F.when(F.col("draw") == 0, 1).otherwise(times(lot(seed, "draw", *row)))
    total = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0))
    sums = [F.sum("_w").alias("_all"), total(F.col(truth)).alias("_cuts")]
    sums += [x for r in rules for x in (total(F.col(r)).alias(f"_hits_{r}"), total(F.col(r) & F.col(truth)).alias(f"_both_{r}"))]
    cells = drawn.withColumn("_w", w).groupBy("draw", *stratum).agg(*sums).join(sizes, stratum)
    scaled = lambda c: F.sum(F.try_divide(F.col("size") * F.col(c), F.col("_all"))).alias(c)
    whole = cells.groupBy("draw").agg(*[scaled(c) for c in ("_cuts", *[f"_{k}_{r}" for r in rules for k in ("hits", "both")])])
    each = [F.struct(F.lit(r).alias("rule"), F.lit(m).alias("metric"), F.try_divide(F.col(f"_both_{r}"), F.col(of)).alias("value"), F.try_divide(F.col(f"_both_{reference}"), F.col(base)).alias("other")) for r in rules for m, of, base in (("recall", "_cuts", "_cuts"), ("precision", f"_hits_{r}", f"_hits_{reference}"))]
    long = whole.select("draw", F.explode(F.array(*each)).alias("m")).select("draw", "m.*").withColumn("gap", F.col("value") - F.col("other"))
    tails = [round((1 - span) / 2, 9), round((1 + span) / 2, 9)]
    real = F.col("draw") > 0
    point = lambda c: F.max(F.when(~real, F.col(c)))
    told = long.groupBy("rule", "metric").agg(point("value").alias("point"), F.percentile(F.when(real, F.col("value")), tails).alias("p"), point("gap").alias("difference"), F.percentile(F.when(real, F.col("gap")), tails).alias("g"))
    return told.select("rule", "metric", "point", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"), "difference", F.get("g", F.lit(0)).alias("difference_low"), F.get("g", F.lit(1)).alias("difference_high"))


def meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` joined with ``b`` on equal keys, nulls too."""
    other = b.withColumnsRenamed({k: f"_{k}_b" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_b"))
    return a.join(other, same).drop(*[f"_{k}_b" for k in keys])


def running(rows: DataFrame, groups: list[str], order: list, sums: dict[str, str], store: Store) -> DataFrame:
    """Adds, for each ``name: value`` of ``sums``, the sum of the value over the rows of the group up to and with this one.
    Ranges of rows are summed apart and a row a range and group is brought together, so no group meets in one task.
    ``order`` must leave no ties."""
    dealt = store.stage(rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_before_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, "_part", *[F.coalesce(F.sum(f"_before_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    return meet(own, parts, [*groups, "_part"]).withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_part", *[f"_before_{n}" for n in sums])


def blocks(series: DataFrame, group: str, at: str, value: str, block: int, store: Store, draws: int = 200, seed: int = 0, span: float = 0.95) -> DataFrame:
    """(<group>, mean, low, high): a moving-block bootstrap of the mean of each series, whose places count from 0. A draw
    takes as many blocks of ``block`` neighbours as the series has room for, the last one cut to its length; their sums are
    differences of running sums, found by place, so a series may be of any length."""
    sums = running(series.select(group, at, value), [group], [at], {"_sum": value}, store)
    points = store.stage(sums.select(group, (F.col(at) + 1).alias("_at"), "_sum"), "points")
    n = series.groupBy(group).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"))
    size = F.least(F.lit(block), F.col("_n"))
    drawn = n.select(group, "_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"), size.alias("_size"))
    # groups are few bytes, so they would be one task; a task a draw, and no group has all its draws in one
    drawn = drawn.repartition(draws, group, "_draw")
    drawn = drawn.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr("cast((_n + _size - 1) div _size as int) - 1"))))
    start = F.pmod(lot(seed, group, "_draw", "_block"), F.col("_n") - F.col("_size") + 1)
    length = F.least(F.col("_size"), F.col("_n") - F.col("_block") * F.col("_size"))
    ends = F.array(F.struct((start + length).alias("_at"), F.lit(1).alias("_sign")), F.struct(start.alias("_at"), F.lit(-1).alias("_sign")))
    cut = drawn.select(group, "_n", "_draw", F.explode(ends).alias("e")).select(group, "_n", "_draw", "e.*").where("_at > 0")
    # what is exploded is many times what Spark takes it for, so it must not be broadcast
    means = cut.hint("merge").join(points, [group, "_at"]).groupBy(group, "_n", "_draw").agg((F.sum(F.col("_sign") * F.col("_sum")) / F.first("_n")).alias("_mean"))
    tails = [round((1 - span) / 2, 9), round((1 + span) / 2, 9)]
    told = means.groupBy(group).agg(F.percentile("_mean", tails).alias("_p"))
    return n.join(told, group).select(group, "mean", F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def thresholds(scored: DataFrame, groups: list[str], score: str, truth: str, weight: str, hours: DataFrame, store: Store) -> DataFrame:
    """(groups, threshold, found, recall, precision, missed_per_hour, false_per_hour) at every score that a group has, for
    rows of at least that score taken as found. ``hours(groups, hours)``. One row a group and score is sorted, once; null
    scores are found at no threshold but count among what there is to find."""
    right = F.sum(F.when(F.col(truth), F.col(weight)).otherwise(0.0))
    each = scored.groupBy(*groups, score).agg(right.alias("_right"), (F.sum(weight) - right).alias("_wrong"))
    there = each.groupBy(*groups).agg(F.sum("_right").alias("_there"))
    sums = running(each.where(F.col(score).isNotNull()), groups, [F.desc(score)], {"right": "_right", "wrong": "_wrong"}, store)
    out = meet(meet(sums, there, groups), hours, groups)
    per_hour = lambda c: F.try_divide(c, F.col("hours"))
    return out.select(*groups, F.col(score).alias("threshold"), (F.col("right") + F.col("wrong")).alias("found"), F.try_divide(F.col("right"), F.col("_there")).alias("recall"), F.try_divide(F.col("right"), F.col("right") + F.col("wrong")).alias("precision"), per_hour(F.col("_there") - F.col("right")).alias("missed_per_hour"), per_hour(F.col("wrong")).alias("false_per_hour"))


def errors_by_label(labelled: DataFrame, rules: list[str], label: str, right: str, weight: str) -> DataFrame:
    """(rule, label, found, missed): for each boolean column ``rules`` and label, the weight of the rows found, and of those
    of the label ``right`` that were not. Of other labels nothing is missed."""
    each = labelled.select(label, weight, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(False)).alias("hit")) for r in rules])).alias("r"))
    w = lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0.0))
    return each.groupBy(F.col("r.rule").alias("rule"), F.col(label).alias("label")).agg(w(F.col("r.hit")).alias("found"), w(~F.col("r.hit") & (F.col(label) == right)).alias("missed"))


def sampled(rows: DataFrame, strata: list[str], row: list[str], total: int, seed: int = 0) -> DataFrame:
    """``total`` rows shared out over the strata by size, at least one each, with ``stratum_size`` and ``weight`` (rows that
    one sampled row stands for). In a stratum those of the smallest lots are taken, ties by ``row``. As no stratum gives
    more than ``total``, each task lets only so many rows of a stratum pass before they are shuffled."""
    sizes = allocated(rows.groupBy(*strata).agg(F.count("*").alias("stratum_size")), "stratum_size", total)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_lot", *row))
    first = rows.withColumn("_lot", lot(seed, *row)).withColumn("_place", place).where(F.col("_place") <= total)
    same = [F.col(f"_s.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in strata]
    out = first.alias("_r").join(sizes.alias("_s"), same).where(F.col("_place") <= F.col("take"))
    return out.select("_r.*", "stratum_size", (F.col("stratum_size") / F.col("take")).alias("weight")).drop("_lot", "_place")
