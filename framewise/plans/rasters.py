"""Queries over pictures and vectors in numpy batches, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import codecs as K
from framewise.operators import planes as P
from framewise.operators import rasters as R
from framewise.plans.analytics import PAIR, pairs
from framewise.sources.bindings import VECTORS_SQL, vectors
from framewise.sources.shared import Store

QUERIES, ORACLES = {}, {}
SIDE = (8, 8)


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def weights_sql(name: str, size: int, to: int) -> str:
    """A table (o, i, w) of resampling weights, from the kernel's formula."""
    ratio = f"({size}.0::double / {to})"
    return f"""{name}_c as (select o, i, {ratio} * (o + 0.5::double) as c, greatest({ratio}, 1.0::double) as wide from unnest(range(0, {to})) as a(o), unnest(range(0, {size})) as b(i)),
{name}_k as (select o, i, abs((i - c + 0.5::double) / wide) as u, i >= greatest(trunc(c - 2 * wide + 0.5::double), 0) and i < least(trunc(c + 2 * wide + 0.5::double), {size}) as seen from {name}_c),
{name}_f as (select o, i, case when not seen then 0.0::double when u < 1 then (1.5::double * u - 2.5::double) * u * u + 1 when u < 2 then ((-0.5::double * u + 2.5::double) * u - 4) * u + 2 else 0.0::double end as f from {name}_k),
{name} as (select o, i, f / sum(f) over (partition by o) as w from {name}_f)"""


@query("src06_shrunk", f"with {VECTORS_SQL}, {weights_sql('wx', 8, 5)}, {weights_sql('wy', 8, 3)}, p as (select vec_id, unnest(v) + 0.5::double as x, unnest(range(0, 64)) as i from vectors),\n"
       "r as (select vec_id, y.o * 5 + x.o as place, sum(p.x * x.w * y.w) as s from p join wx x on x.i = p.i % 8 join wy y on y.i = p.i // 8 group by 1, 2)\n"
       "select vec_id, place, cast(least(greatest(round_even(s * 255, 0), 0), 255) as int) as code from r")  # fmt: skip
def src06_shrunk(spark, d):
    v = vectors(spark, d).withColumn("v", F.transform("v", lambda x: x + 0.5))
    out = R.shrunk(v.select("vec_id", "v"), "v", "small", SIDE, (5, 3))
    return out.select("vec_id", F.posexplode("small").alias("place", "code")).withColumn("place", F.col("place").cast("long"))


def band_sql(v: str, gap: int) -> str:
    """One level of the cascade over a list of 64, along x and then y."""
    x = f"list_transform(range(0, 64), lambda i: ({v}[i // 8 * 8 + greatest(i % 8 - {gap}, 0) + 1] + 2 * {v}[i + 1] + {v}[i // 8 * 8 + least(i % 8 + {gap}, 7) + 1]) / 4)"
    return f"list_transform([{x}], lambda w: list_transform(range(0, 64), lambda i: (w[greatest(i // 8 - {gap}, 0) * 8 + i % 8 + 1] + 2 * w[i + 1] + w[least(i // 8 + {gap}, 7) * 8 + i % 8 + 1]) / 4))[1]"


@query("sc07_transfer", PAIR + f", l1 as (select *, {band_sql('a', 1)} as a1, {band_sql('b', 1)} as b1 from pair), l2 as (select *, {band_sql('a1', 2)} as a2, {band_sql('b1', 2)} as b2 from l1), l3 as (select *, {band_sql('a2', 4)} as a3, {band_sql('b2', 4)} as b3 from l2), e as (select vec_id, unnest(range(0, 64)) as i, unnest(a) as a, unnest(a3) as a3, unnest(b3) as b3 from l3) select vec_id, i, round(a - a3 + b3, 6) + 0.0 as x from e")
def sc07_transfer(spark, d):
    out = R.transferred(pairs(spark, d), "a", "b", "mixed", SIDE, 3).select("vec_id", F.posexplode("mixed").alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


CODED = f"{VECTORS_SQL}, s as (select vec_id, label, v, list_max(list_transform(v, lambda x: abs(x))) / 127 as scale from vectors), c as (select vec_id, label, unnest(range(0, 64)) as i, greatest(-127, least(127, round_even(unnest(v) / scale, 0))) as code from s)"


@query("sc09_product", f"with {CODED}, first as (select label, min(vec_id) as other from vectors group by 1), b as (select vec_id as other, i, code from c where vec_id in (select other from first)) select c.vec_id, b.other, cast(sum(c.code * b.code) as bigint) as value from c join b using (i) group by 1, 2")
def sc09_product(spark, d):
    """Every vector's codes by those of the first vector of each label."""
    v = vectors(spark, d).withColumn("scale", K.absmax("v") / 127)
    codes = v.select("vec_id", "label", K.int8_codes("v", "scale").alias("codes"))
    first = codes.groupBy("label").agg(F.min_by("codes", "vec_id").alias("codes"), F.min("vec_id").alias("other"))
    return R.product(codes.select("vec_id", "codes"), first.select("other", "codes"), "vec_id", "other", "codes", block=256, depth=24)


@query("sc11_unpacked", f"with {VECTORS_SQL}, e as (select vec_id, unnest([3, 4, 5, 6]) as bits, v from vectors), x as (select vec_id, bits, unnest(range(0, 64)) as i, unnest(v) as x from e), m as (select *, min(x) over q as least_, max(x) over q as most from x window q as (partition by vec_id, bits, i // 16)), s as (select *, (most - least_) / ((1 << bits) - 1) as scale from m),\n"
       "c as (select *, round_even((x - least_) / case when scale = 0 then 1 else scale end, 0) as code from s) select vec_id, cast(bits as int) as bits, i, cast(code as int) as code, round(code * scale + least_, 6) + 0.0 as x from c")  # fmt: skip
def sc11_unpacked(spark, d):
    """Vectors packed at three to six bits a value with a scale and a least value for every sixteen, and read back."""
    v, out = vectors(spark, d).select("vec_id", "v"), None
    for bits in (3, 4, 5, 6):
        back = R.unpacked(R.packed(v, "v", "p", bits, 16).drop("v"), "p", "x", bits, 16)
        part = back.select("vec_id", F.lit(bits).alias("bits"), F.posexplode(F.arrays_zip("x_codes", "x")).alias("i", "e"))
        out = part if out is None else out.unionByName(part)
    return out.select("vec_id", "bits", F.col("i").cast("long").alias("i"), F.col("e.x_codes").alias("code"), (F.round("e.x", 6) + 0.0).alias("x"))


E4M3 = "least(greatest(round_even({y} / pow(2.0::double, greatest(floor(log2(greatest(abs({y}), 0.00000095367431640625::double))), -6) - 3), 0) * pow(2.0::double, greatest(floor(log2(greatest(abs({y}), 0.00000095367431640625::double))), -6) - 3), -448), 448)"
E2M1 = "sign(y) * case when abs(y) <= 0.25 then 0.0 when abs(y) <= 0.75 then 0.5 when abs(y) <= 1.25 then 1.0 when abs(y) <= 1.75 then 1.5 when abs(y) <= 2.5 then 2.0 when abs(y) <= 3.5 then 3.0 when abs(y) <= 5 then 4.0 else 6.0 end"


@query("sc12_block_scales", f"with {VECTORS_SQL}, x as (select vec_id, unnest(range(0, 64)) as i, unnest(v) as x from vectors), m as (select *, max(abs(x)) over (partition by vec_id, i // 16) / 6 as raw from x), s as (select *, {E4M3.format(y='raw * 256')} / 256 as scale from m), c as (select *, case when scale = 0 then 0 else x / scale end as y from s) select vec_id, i, round(scale, 9) as scale, round({E2M1} * scale, 9) + 0.0 as x from c")
def sc12_block_scales(spark, d):
    """Four-bit values with an eight-bit scale for every sixteen, and back."""
    x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("i", "x"))
    block = Window.partitionBy("vec_id", F.floor(F.col("i") / 16))
    s = x.withColumn("scale", K.e4m3(F.max(F.abs("x")).over(block) / 6 * 256) / 256)
    y = F.when(F.col("scale") == 0, 0.0).otherwise(F.col("x") / F.col("scale"))
    return s.select("vec_id", F.col("i").cast("long").alias("i"), F.round("scale", 9).alias("scale"), (F.round(K.e2m1(y) * F.col("scale"), 9) + 0.0).alias("x"))


#: Greedy picks one by one, a step of the recursion for each map and rank.
PICKS = f"""with recursive {VECTORS_SQL}, g as (select vec_id, x, y, v from vectors, unnest(range(0, 6)) as a(x), unnest(range(0, 7)) as b(y)),
w as (select vec_id, x, y, round(list_sum(list_transform(range(0, 6), lambda k: v[(y + k // 3) * 8 + x + k % 3 + 1])) / 6, 9) as score from g),
o as (select vec_id, x, y, score, row_number() over (partition by vec_id order by score desc, y, x) as n from w), l as (select vec_id, list(x order by n) as xs, list(y order by n) as ys, list(score order by n) as ss from o group by 1),
r as (select vec_id, cast(1 as bigint) as n, xs, ys, ss, cast([] as bigint[]) as px, cast([] as bigint[]) as py, cast([] as double[]) as ps from l union all
 select vec_id, n + 1, xs, ys, ss, case when ok then list_append(px, xs[n]) else px end, case when ok then list_append(py, ys[n]) else py end, case when ok then list_append(ps, ss[n]) else ps end
 from (select *, len(list_filter(range(1, len(px) + 1), lambda k: abs(px[k] - xs[n]) < 3 and abs(py[k] - ys[n]) < 2)) = 0 as ok from r where n <= len(xs))),
e as (select vec_id, unnest(px) as x, unnest(py) as y, unnest(ps) as score, unnest(range(1, len(px) + 1)) as place from r where n = len(xs) + 1) select vec_id, x, y, score, cast(place as bigint) as place from e where place <= 5"""


@query("st11_windows_apart", PICKS)
def st11_windows_apart(spark, d):
    """The five best windows of three by two in each map that do not overlap."""
    w = R.window_scores(vectors(spark, d), "vec_id", "v", SIDE, (3, 2), 1).withColumn("score", F.round("score", 9))
    picks = R.apart(w, "vec_id", (3, 2), Store(spark, "apart"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "y", "x")).cast("long")
    return picks.withColumn("place", place).where("place <= 5").select("vec_id", "x", "y", "score", "place")


BYTES = f"{VECTORS_SQL}, y8 as (select vec_id, list_transform(v, lambda x: cast(least(greatest(floor((x + 0.5) * 255), 0), 255) as bigint)) as y from vectors)"


def bytes_of(spark, d):
    code = lambda x: F.least(F.greatest(F.floor((x + 0.5) * 255), F.lit(0).cast("long")), F.lit(255).cast("long"))
    return vectors(spark, d).select("vec_id", F.transform("v", code).alias("y"))


def chroma_sql(c: str) -> str:
    """Four by four samples, sited left and between two rows, at each of the 64 places."""
    at = f"(({c}[greatest(least(cast(floor((j - 0.5::double) / 2) as bigint) {{0}}, 3), 0) * 4 + least(i // 2 {{1}}, 3) + 1] - 128) / 224.0::double)"
    wx, wy = "(i % 2) * 0.5::double", "((j - 0.5::double) / 2 - floor((j - 0.5::double) / 2))"
    return f"((1 - {wy}) * ((1 - {wx}) * {at.format('', '')} + {wx} * {at.format('', '+ 1')}) + {wy} * ((1 - {wx}) * {at.format('+ 1', '')} + {wx} * {at.format('+ 1', '+ 1')}))"


@query("prj01_colours_of_planes", f"with {BYTES}, p as (select vec_id, y, list_transform(range(0, 16), lambda k: y[k * 4 + 2]) as u, list_transform(range(0, 16), lambda k: y[k * 4 + 3]) as v, unnest(range(0, 64)) as place from y8), s as (select vec_id, place, (y[place + 1] - 16) / 219.0::double as l, u, v, place % 8 as i, place // 8 as j from p),\n"
       f"c as (select vec_id, place, l, {chroma_sql('u')} as u, {chroma_sql('v')} as v from s), t as (select vec_id, place, l, l + 1.5748::double * v as r, l + 1.8556::double * u as b from c), g as (select *, (l - 0.2126::double * r - 0.0722::double * b) / 0.7152::double as g from t)\n"
       "select vec_id, place, " + ", ".join(f"cast(round_even(least(greatest({c}, 0), 1) * 65535, 0) as int) as {c}" for c in "rgb") + " from g")  # fmt: skip
def prj01_colours_of_planes(spark, d):
    """Luma of eight by eight and colour differences of four by four, in limited range, as 16-bit colours."""
    third = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("y", i * 4 + k))
    p = bytes_of(spark, d).withColumn("u", third(1)).withColumn("v", third(2))
    out = P.colours(p, ("y", "u", "v"), "rgb", SIDE, (2, 2), site=(0.5, 1.0))
    each = out.select("vec_id", "rgb", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return each.select("vec_id", F.col("p").cast("long").alias("place"), *[F.get("rgb", F.col("p") * 3 + k).alias(c) for k, c in enumerate("rgb")])


@query("prj02_stored_planes", f"with {VECTORS_SQL}, e as (select vec_id, unnest(range(0, 64)) as place, v from vectors), c as (select vec_id, place, least(greatest(v[place + 1] + 0.5::double, 0), 1) as r, least(greatest(v[64 - place] + 0.5::double, 0), 1) as g, least(greatest(v[place * 7 % 64 + 1] + 0.5::double, 0), 1) as b from e), l as (select *, 0.2126::double * r + 0.7152::double * g + 0.0722::double * b as l from c)\n"
       "select vec_id, place, cast(round_even(4096 + 56064 * l, 0) as int) as y, cast(round_even(32768 + 57344 * (b - l) / 1.8556::double, 0) as int) as u, cast(round_even(32768 + 57344 * (r - l) / 1.5748::double, 0) as int) as v from l")  # fmt: skip
def prj02_stored_planes(spark, d):
    up = lambda pick: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("v", pick(i)) + 0.5)
    c = vectors(spark, d).select("vec_id", up(lambda i: i).alias("r"), up(lambda i: 63 - i).alias("g"), up(lambda i: i * 7 % 64).alias("b"))
    out = P.stored(c, ("r", "g", "b"), ("y", "u", "v")).select("vec_id", F.posexplode(F.arrays_zip("y", "u", "v")).alias("place", "e"))
    return out.select("vec_id", F.col("place").cast("long").alias("place"), "e.y", "e.u", "e.v")


@query("prj12_padded_pictures", f"with {VECTORS_SQL}, e as (select vec_id, v, unnest(range(0, 256)) as place from vectors), p as (select vec_id, place, v, place % 16 as x, place // 16 as y from e) select vec_id, place, case when y >= 14 or x >= 14 then 0.0 else v[case when y > 7 then 14 - y else y end * 8 + case when x > 7 then 14 - x else x end + 1] end + 0.0::double as x from p")
def prj12_padded_pictures(spark, d):
    """Eight by eight to a multiple of seven with five mirrored at least, and two rows and columns of nought."""
    out = P.padded(vectors(spark, d), "v", "p", SIDE, multiple=7, least=5, black=2)
    return out.select("vec_id", F.posexplode("p").alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), (F.col("x") + 0.0).alias("x"))


@query("prj12_in_fours", f"with {VECTORS_SQL}, c as (select vec_id, v[1:60 + vec_id % 4] as v from vectors), p as (select vec_id, v, len(v) as n, unnest(range(0, len(v) + (4 - (len(v) - 1) % 4) % 4)) as i from c) select vec_id, i, v[least(i, n - 1) + 1] as x from p")
def prj12_in_fours(spark, d):
    cut = vectors(spark, d).select("vec_id", F.slice("v", F.lit(1), (60 + F.col("vec_id") % 4).cast("int")).alias("v"))
    return cut.select("vec_id", F.posexplode(P.in_fours("v")).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("snk05_row_filters", f"with {BYTES}, e as (select vec_id, unnest(y) as x, unnest(range(0, 64)) as i from y8), n as (select vec_id, i // 8 as line, i, x, case when i % 8 = 0 then 0 else lag(x) over w end as a, coalesce(lag(x, 8) over w, 0) as b, case when i % 8 = 0 then 0 else coalesce(lag(x, 9) over w, 0) end as c from e window w as (partition by vec_id order by i)),\n"
       "q as (select *, case when abs(b - c) <= abs(a - c) and abs(b - c) <= abs(a + b - 2 * c) then a when abs(a - c) <= abs(a + b - 2 * c) then b else c end as p from n), f as (select vec_id, line, i, unnest([0, 1, 2, 3, 4]) as kind, unnest([x, (x - a + 256) % 256, (x - b + 256) % 256, (x - (a + b) // 2 + 256) % 256, (x - p + 256) % 256]) as y from q),\n"
       "s as (select vec_id, line, kind, sum(least(y, 256 - y)) as s from f group by 1, 2, 3), k as (select vec_id, line, arg_min(kind, s * 8 + kind) as kind from s group by 1, 2) select f.vec_id, f.i, cast(f.kind as int) as kind, cast(f.y as int) as code from f join k on k.vec_id = f.vec_id and k.line = f.line and k.kind = f.kind")  # fmt: skip
def snk05_row_filters(spark, d):
    """Each row by the filter that suits it, and the samples come back."""
    out = P.unfiltered_rows(P.filtered_rows(bytes_of(spark, d), "y", "f", SIDE), "f", "back", SIDE)
    same = F.transform("back", lambda x: x.cast("long")) == F.col("y")
    codes = F.when(same, F.col("f")).otherwise(F.raise_error(F.lit("filtered samples did not come back")))
    each = out.select("vec_id", "f_kind", F.posexplode(codes).alias("i", "code"))
    return each.select("vec_id", F.col("i").cast("long").alias("i"), F.get("f_kind", F.floor(F.col("i") / 8).cast("int")).alias("kind"), "code")
