"""Queries over pictures and colours, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewise.operators import metrics as M
from framewise.operators import pictures as P
from framewise.operators import rasters as R
from framewise.plans.analytics import PAIR, pairs
from framewise.plans.frames import SAMPLES, samples

QUERIES, ORACLES = {}, {}
SIDE = 8


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def mirrored(p: str) -> str:
    return f"(case when abs({p}) > 7 then 14 - abs({p}) else abs({p}) end)"


def filtered_sql(v: str, kernel: tuple[float, ...]) -> str:
    """Both passes of a kernel over the list ``v``, in DuckDB's SQL."""
    k, reach = "[" + ", ".join(f"{x!r}::double" for x in kernel) + "]", len(kernel) // 2
    terms = f"range({-reach}, {reach + 1})"
    across = f"list_transform(range(0, 64), lambda i: list_sum(list_transform({terms}, lambda k: {k}[k + {reach + 1}] * {v}[i // 8 * 8 + {mirrored('i % 8 + k')} + 1])))"
    return f"list_transform([{across}], lambda w: list_transform(range(0, 64), lambda i: list_sum(list_transform({terms}, lambda k: {k}[k + {reach + 1}] * w[{mirrored('i // 8 + k')} * 8 + i % 8 + 1]))))[1]"


G11, BOX = P.gaussian(11, 1.5), (1.0 / 9,) * 9
QUALITY = (
    PAIR
    + f""", y as (select vec_id, list_transform(a, lambda x: x * 100 + 128) as a, list_transform(b, lambda x: x * 100 + 128) as b from pair),
q as (select *, list_transform(list_zip(a, a), lambda x: x[1] * x[2]) as aa, list_transform(list_zip(b, b), lambda x: x[1] * x[2]) as bb, list_transform(list_zip(a, b), lambda x: x[1] * x[2]) as ab from y),
m as (select *, {filtered_sql("a", G11)} as ma, {filtered_sql("b", G11)} as mb, {filtered_sql("aa", G11)} as maa, {filtered_sql("bb", G11)} as mbb, {filtered_sql("ab", G11)} as mab,
 {filtered_sql("a", BOX)} as xa, {filtered_sql("aa", BOX)} as xaa,
 list_transform(range(0, 64), lambda i: a[i // 8 * 8 + {mirrored("i % 8 - 1")} + 1] + a[i // 8 * 8 + {mirrored("i % 8 + 1")} + 1] + a[{mirrored("i // 8 - 1")} * 8 + i % 8 + 1] + a[{mirrored("i // 8 + 1")} * 8 + i % 8 + 1] - 4 * a[i + 1]) as lap from q),
e as (select *, list_transform(range(1, 65), lambda i: (2 * ma[i] * mb[i] + 6.5025) * (2 * (mab[i] - ma[i] * mb[i]) + 58.5225) / ((ma[i] * ma[i] + mb[i] * mb[i] + 6.5025) * (maa[i] - ma[i] * ma[i] + mbb[i] - mb[i] * mb[i] + 58.5225))) as each from m)
select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 64, 4) as mse, round(list_sum(each) / 64, 4) + 0.0 as ssim,
 round(list_sum(list_transform(lap, lambda x: x * x)) / 64 - pow(list_sum(lap) / 64, 2), 3) as laplacian, round(list_sum(list_transform(range(1, 65), lambda i: sqrt(greatest(xaa[i] - xa[i] * xa[i], 0)))) / 64, 4) as deviation,
 round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) / 64, 4) as temporal, {", ".join(f"round(list_sum(list_transform(range(0, 16), lambda j: a[({k // 2 * 4} + j // 4) * 8 + {k % 2 * 4} + j % 4 + 1])) / 16, 4) as block_{k}" for k in range(4))} from e"""
)


@query("ag18_quality", QUALITY)
def ag18_quality(spark, d):
    """Pictures of eight by eight against the next one: error, structure, sharpness, local deviation, change, blocks."""
    p = pairs(spark, d).select("vec_id", *[F.transform(c, lambda x: x * 100 + 128).alias(c) for c in "ab"])
    p = R.quality(p, "a", "b", (SIDE, SIDE), G11)
    change = P.mean(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    p = p.withColumn("blocks", P.block_means("a", SIDE, SIDE, 4))
    blocks = [F.round(F.col("blocks")[k], 4).alias(f"block_{k}") for k in range(4)]
    return p.select("vec_id", F.round(M.mean_square("a", "b"), 4).alias("mse"), (F.round("ssim", 4) + 0.0).alias("ssim"), F.round("laplacian", 3).alias("laplacian"), F.round("deviation", 4).alias("deviation"), F.round(change, 4).alias("temporal"), *blocks)


def dot_sql(row: tuple, names: tuple[str, str, str]) -> str:
    return " + ".join(f"{x!r}::double * {n}" for x, n in zip(row, names, strict=True))


def lab_sql(source: str, rgb: tuple[str, str, str], out: tuple[str, str, str]) -> str:
    """A subquery that adds CIELAB of three columns."""
    light = ", ".join(f"case when {c} <= 0.04045 then {c} / 12.92::double else pow(({c} + 0.055::double) / 1.055::double, 2.4) end as l{i}" for i, c in enumerate(rgb))
    xyz = ", ".join(f"({dot_sql(P.XYZ[i], ('l0', 'l1', 'l2'))}) / {P.WHITE[i]!r}::double as x{i}" for i in range(3))
    roots = ", ".join(f"case when x{i} > 216.0::double / 24389 then pow(x{i}, 1.0::double / 3) else (24389.0::double / 27 * x{i} + 16) / 116 end as f{i}" for i in range(3))
    return f"(select * exclude (l0, l1, l2, x0, x1, x2, f0, f1, f2), 116 * f1 - 16 as {out[0]}, 500 * (f0 - f1) as {out[1]}, 200 * (f1 - f2) as {out[2]} from (select *, {roots} from (select *, {xyz} from (select *, {light} from {source}))))"


COLOURS = f"""with {SAMPLES}, o as (select *, {", ".join(f"case when {c} <= 0.04045 then {c} / 12.92::double else pow(({c} + 0.055::double) / 1.055::double, 2.4) end as l{i}" for i, c in enumerate("rgb"))} from s),
k as (select * exclude (l0, l1, l2), {", ".join(f"cbrt({dot_sql(P.CONES[i], ('l0', 'l1', 'l2'))}) as k{i}" for i in range(3))} from o),
t as (select * exclude (k0, k1, k2), {", ".join(f"{dot_sql(P.OKLAB[i], ('k0', 'k1', 'k2'))} as ok_{n}" for i, n in enumerate("lab"))} from k),
l as (select * from {lab_sql(lab_sql("t", ("r", "g", "b"), ("lab_l", "lab_a", "lab_b")), ("g", "b", "r"), ("o_l", "o_a", "o_b"))}),
d1 as (select *, (sqrt(lab_a * lab_a + lab_b * lab_b) + sqrt(o_a * o_a + o_b * o_b)) / 2 as half from l),
d2 as (select *, 1.5 - 0.5 * sqrt(pow(half, 7) / (pow(half, 7) + pow(25.0::double, 7))) as grow from d1), d3 as (select *, lab_a * grow as p1, o_a * grow as p2 from d2),
d4 as (select *, sqrt(p1 * p1 + lab_b * lab_b) as c1, sqrt(p2 * p2 + o_b * o_b) as c2, case when p1 = 0 and lab_b = 0 then 0 else degrees(atan2(lab_b, p1)) end as g1, case when p2 = 0 and o_b = 0 then 0 else degrees(atan2(o_b, p2)) end as g2 from d3),
d5 as (select *, case when g1 < 0 then g1 + 360 else g1 end as h1, case when g2 < 0 then g2 + 360 else g2 end as h2 from d4),
d6 as (select *, case when c1 * c2 = 0 then 0 when h2 - h1 > 180 then h2 - h1 - 360 when h2 - h1 < -180 then h2 - h1 + 360 else h2 - h1 end as turn, case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as h from d5),
d7 as (select *, 1 - 0.17 * cos(radians(h - 30)) + 0.24 * cos(radians(2 * h)) + 0.32 * cos(radians(3 * h + 6)) - 0.20 * cos(radians(4 * h - 63)) as t, (lab_l + o_l) / 2 - 50 as light, (c1 + c2) / 2 as chroma from d6),
d8 as (select *, (o_l - lab_l) / (1 + 0.015 * light * light / sqrt(20 + light * light)) as tl, (c2 - c1) / (1 + 0.045 * chroma) as tc, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * chroma * t) as th, 2 * sqrt(pow(chroma, 7) / (pow(chroma, 7) + pow(25.0::double, 7))) * sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) as turned from d7)
select l_orderkey, l_linenumber, l_partkey, {", ".join(f"round({c}, 4) + 0.0 as {c}" for c in ("lab_l", "lab_a", "lab_b", "ok_l", "ok_a", "ok_b"))}, round(sqrt(greatest(tl * tl + tc * tc + th * th - turned * tc * th, 0)), 4) as de2000 from d8"""


@query("ag19_colours", COLOURS)
def ag19_colours(spark, d):
    """CIELAB and OKLab of samples, and how far each is from itself with its channels turned round."""
    s = P.with_oklab(samples(spark, d), ("r", "g", "b"), ("ok_l", "ok_a", "ok_b"))
    s = P.with_lab(P.with_lab(s, ("r", "g", "b"), ("lab_l", "lab_a", "lab_b")), ("g", "b", "r"), ("o_l", "o_a", "o_b"))
    s = P.with_ciede2000(s, ("lab_l", "lab_a", "lab_b"), ("o_l", "o_a", "o_b"))
    rounded = [(F.round(c, 4) + 0.0).alias(c) for c in ("lab_l", "lab_a", "lab_b", "ok_l", "ok_a", "ok_b")]
    return s.select("l_orderkey", "l_linenumber", "l_partkey", *rounded, F.round("de2000", 4).alias("de2000"))


HISTOGRAMS = f"""with {SAMPLES}, l as (select *, l_linenumber % 3 as shot from {lab_sql("s", ("r", "g", "b"), ("lab_l", "lab_a", "lab_b"))}),
v as (select shot, l_orderkey % 2 as side, unnest(['l', 'a', 'b']) as channel, unnest([round(lab_l, 6) / 100, (round(lab_a, 6) + 128) / 256, (round(lab_b, 6) + 128) / 256]) as x from l),
h as (select shot, channel, side, cast(least(greatest(floor(x * 256), 0), 255) as bigint) as bin, count(*) as n from v group by all),
c as (select *, sum(n) over (partition by shot, channel, side order by bin) as upto, sum(n) over (partition by shot, channel, side) as total from h),
j as (select a.shot, a.channel, a.bin, a.n, a.total, a.upto, r.total as rtotal, r.bin as rbin, r.n as rn, r.upto as rto, row_number() over (partition by a.shot, a.channel, a.bin order by r.bin) as k
 from c a join c r on a.shot = r.shot and a.channel = r.channel and a.side = 0 and r.side = 1 and 2 * r.upto * a.total >= (2 * a.upto - a.n) * r.total)
select shot, channel, bin, n, round(rbin + (cast((2 * upto - n) * rtotal as double) / (2 * total) - (rto - rn)) / rn, 4) as matched from j where k = 1"""


@query("ag28_pooled_histograms", HISTOGRAMS)
def ag28_pooled_histograms(spark, d):
    """CIELAB histograms of three channels pooled over each shot, one side matched to the other."""
    lab = P.with_lab(samples(spark, d), ("r", "g", "b"), ("lab_l", "lab_a", "lab_b")).withColumn("shot", F.col("l_linenumber") % 3)
    scaled = F.create_map(F.lit("l"), F.round("lab_l", 6) / 100, F.lit("a"), (F.round("lab_a", 6) + 128) / 256, F.lit("b"), (F.round("lab_b", 6) + 128) / 256)
    v = lab.select("shot", (F.col("l_orderkey") % 2).alias("side"), F.explode(scaled).alias("channel", "x"))
    h = P.histograms(v, ["shot", "channel", "side"], "x", 0.0, 1.0)
    out = P.matched(h.where("side = 0").drop("side"), h.where("side = 1").drop("side"), ["shot", "channel"])
    return out.select("shot", "channel", "bin", "n", F.round("matched", 4).alias("matched"))
