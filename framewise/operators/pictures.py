"""Pictures as arrays, row by row: filters, similarity, colour spaces and differences, pooled histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard colour matrices and whites. sRGB to XYZ (D65) and its white; linear sRGB to the cones of OKLab,
#: and those, as cube roots, to OKLab.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def gaussian(size: int, sigma: float) -> tuple[float, ...]:
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return tuple(x / sum(raw) for x in raw)


def mean(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def block_means(name: str, width: int, height: int, block: int) -> Column:
    """Means of squares of ``block`` places, row by row; sides are multiples of it."""
    across = width // block
    place = lambda k, j: (F.floor(k / across).cast("int") * block + j // block) * width + (k % across) * block + j % block
    v = F.col(name)

    def one(k: Column) -> Column:
        total = F.get(v, place(k, 0).cast("int"))
        for j in range(1, block * block):
            total = total + F.get(v, place(k, j).cast("int"))
        return total / (block * block)

    return F.transform(F.sequence(F.lit(0), F.lit(across * (height // block) - 1)), one)


def linear(c: Column) -> Column:
    """A unit-range sRGB sample as linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [m[0] * v[0] + m[1] * v[1] + m[2] * v[2] for m in matrix]


def with_lab(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Adds CIELAB (D65) of unit-range sRGB samples. Steps that are used more than once are columns of their own."""
    for i, c in enumerate(rgb):
        df = df.withColumn(f"_l{i}", linear(F.col(c)))
    for i, x in enumerate(_times(XYZ, [F.col(f"_l{i}") for i in range(3)])):
        df = df.withColumn(f"_x{i}", x / WHITE[i])
    for i in range(3):
        x = F.col(f"_x{i}")
        df = df.withColumn(f"_f{i}", F.when(x > 216.0 / 24389, F.pow(x, F.lit(1.0 / 3))).otherwise((24389.0 / 27 * x + 16) / 116))
    f0, f1, f2 = (F.col(f"_f{i}") for i in range(3))
    df = df.withColumn(out[0], 116 * f1 - 16).withColumn(out[1], 500 * (f0 - f1)).withColumn(out[2], 200 * (f1 - f2))
    return df.drop(*[f"_{k}{i}" for k in "lxf" for i in range(3)])


def with_oklab(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Adds OKLab of unit-range sRGB samples."""
    for i, c in enumerate(rgb):
        df = df.withColumn(f"_l{i}", linear(F.col(c)))
    for i, x in enumerate(_times(CONES, [F.col(f"_l{i}") for i in range(3)])):
        df = df.withColumn(f"_c{i}", F.cbrt(x))
    for name, x in zip(out, _times(OKLAB, [F.col(f"_c{i}") for i in range(3)]), strict=True):
        df = df.withColumn(name, x)
    return df.drop(*[f"_{k}{i}" for k in "lc" for i in range(3)])


def with_ciede2000(df: DataFrame, one: tuple[str, str, str], other: tuple[str, str, str], out: str = "de2000") -> DataFrame:
    """Adds the CIEDE2000 difference of two CIELAB colours, all weights one, angles in degrees. A grey colour has no hue:
    its hue counts as the other's."""
    names, made = df.columns, []

    def keep(name: str, value: Column) -> Column:
        nonlocal df
        df = df.withColumn(f"_d_{name}", value)
        made.append(f"_d_{name}")
        return F.col(f"_d_{name}")

    # the published formula, step by step and by its symbols; `keep` makes a column of what is used more than once
    (lightness1, a1, b1), (lightness2, a2, b2) = ([F.col(c) for c in x] for x in (one, other))
    length = lambda x, y: F.sqrt(x * x + y * y)
    root7 = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + F.lit(25.0**7)))
    g = keep("g", 0.5 * (1 - root7((length(a1, b1) + length(a2, b2)) / 2)))
    a1p, a2p = keep("a1p", (1 + g) * a1), keep("a2p", (1 + g) * a2)
    c1p, c2p = keep("c1p", length(a1p, b1)), keep("c2p", length(a2p, b2))
    angle = lambda y, x: F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)))
    h1p, h2p = keep("h1p", angle(b1, a1p)), keep("h2p", angle(b2, a2p))
    no_hue, apart = (c1p == 0) | (c2p == 0), F.abs(h1p - h2p) > 180
    delta_h = keep("delta_h", F.when(no_hue, 0.0).when(~apart, h2p - h1p).when(h2p <= h1p, h2p - h1p + 360).otherwise(h2p - h1p - 360))
    delta_lp, delta_cp = lightness2 - lightness1, c2p - c1p
    delta_hp = keep("delta_hp", 2 * F.sqrt(c1p * c2p) * F.sin(F.radians(delta_h) / 2))
    sum_h = h1p + h2p
    mean_h = keep("mean_h", F.when(no_hue, sum_h).when(~apart, sum_h / 2).when(sum_h < 360, sum_h / 2 + 180).otherwise(sum_h / 2 - 180))
    mean_l, mean_c = keep("mean_l", (lightness1 + lightness2) / 2), keep("mean_c", (c1p + c2p) / 2)
    cosine = lambda degrees: F.cos(F.radians(degrees))
    t = 1 - 0.17 * cosine(mean_h - 30) + 0.24 * cosine(2 * mean_h) + 0.32 * cosine(3 * mean_h + 6) - 0.20 * cosine(4 * mean_h - 63)
    delta_theta = 30 * F.exp(-F.pow((mean_h - 275) / 25, F.lit(2.0)))
    r_t = -F.sin(F.radians(2 * delta_theta)) * 2 * root7(mean_c)
    from_50 = F.pow(mean_l - 50, F.lit(2.0))
    s_l, s_c, s_h = 1 + 0.015 * from_50 / F.sqrt(20 + from_50), 1 + 0.045 * mean_c, 1 + 0.015 * mean_c * t
    lightness, chroma, hue = keep("lightness", delta_lp / s_l), keep("chroma", delta_cp / s_c), keep("hue", delta_hp / s_h)
    square = lightness * lightness + chroma * chroma + hue * hue + r_t * chroma * hue
    return df.withColumn(out, F.sqrt(F.greatest(square, F.lit(0.0)))).select(*names, out)


def histograms(values: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """(keys, bin, n) of values in ``bins`` equal bins from ``low`` to ``high``; what lies outside counts in the last."""
    at = F.floor((F.col(value) - low) / (high - low) * bins)
    return values.groupBy(*keys, F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(bins - 1).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def first_reaching(asked: DataFrame, table: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``asked`` with the columns of the first row of ``table``, in order of ``at``, that is not before it; null without
    one. Both are sorted together from the end, and a running window carries the last row of ``table`` that was seen."""
    mine, theirs = [c for c in asked.columns if c not in (*keys, at)], [c for c in table.columns if c not in (*keys, at)]
    found = F.struct(*theirs)
    both = asked.select(*keys, at, F.struct(*mine).alias("_a"), F.lit(None).cast(table.select(found.alias("f")).schema["f"].dataType).alias("_t"))
    both = both.unionByName(table.select(*keys, at, F.lit(None).cast(both.schema["_a"].dataType).alias("_a"), found.alias("_t")))
    by = Window.partitionBy(*keys).orderBy(F.desc(at), F.col("_t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_t", F.last("_t", ignorenulls=True).over(by)).where("_a is not null").select(*keys, at, "_a.*", *[F.col(f"_t.{c}").alias(c) for c in theirs])


def matched(content: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n, matched) of two pooled histograms (keys, bin, n): where, in bins of the reference, the middle of
    each bin of the content lies at the same share of all values, linear within a bin. Exact integers decide which bin;
    a window has the bins of one histogram."""
    by = Window.partitionBy(*keys)
    running = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = content.withColumn("to", F.sum("n").over(running)).withColumn("all", F.sum("n").over(by))
    r = reference.withColumn("rto", F.sum("n").over(running)).withColumn("rall", F.sum("n").over(by)).withColumnsRenamed({"bin": "rbin", "n": "rn"})
    totals = c.select(*keys, "all").distinct().join(r.select(*keys, "rall").distinct(), keys)
    asked = c.join(totals.select(*keys, "rall"), keys).select(*keys, ((2 * F.col("to") - F.col("n")) * F.col("rall")).cast("decimal(38,0)").alias("at"), "bin", "n", "all")
    table = r.join(totals.select(*keys, "all"), keys).select(*keys, (2 * F.col("rto") * F.col("all")).cast("decimal(38,0)").alias("at"), "rbin", "rn", "rto")
    out = first_reaching(asked, table, keys, "at")
    part = F.col("at").cast("double") / (2 * F.col("all")) - (F.col("rto") - F.col("rn"))
    return out.select(*keys, "bin", "n", (F.col("rbin") + part / F.col("rn")).alias("matched"))
