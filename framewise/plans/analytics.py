"""Queries over labels, statistics and vectors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.operators import codecs as K
from framewise.operators import metrics as M
from framewise.operators import rasters as R
from framewise.sources.bindings import FRAMES_SQL, VECTORS_SQL, frames, table, vectors

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


LABELLED = "with l as (select d.doc_id, d.lang, d.source, d.n_chars, coalesce(quality, -1) as quality, toxic from documents d join labels using (doc_id)), w as (select *, n_chars > 1500 as hit, quality = 1 as truth, 1.0 + doc_id % 4 as wt from l)"


def labelled(spark, d):
    l = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return l.withColumn("hit", F.col("n_chars") > 1500).withColumn("truth", F.col("quality") == 1).withColumn("wt", (1 + F.col("doc_id") % 4).cast("double"))


@query("ag14_weighted_rates", LABELLED + " select lang, round(sum(case when hit and truth then wt else 0 end) / nullif(sum(case when hit then wt else 0 end), 0), 6) as precision, round(sum(case when hit and truth then wt else 0 end) / nullif(sum(case when truth then wt else 0 end), 0), 6) as recall, count(*) as n from w group by 1")
def ag14_weighted_rates(spark, d):
    r = M.rates(labelled(spark, d), ["lang"], F.col("hit"), F.col("truth"), F.col("wt"))
    return r.select("lang", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "n")


@query("ag15_rollup", LABELLED + " select lang, source, count(*) as n, round(avg(quality), 6) as quality, cast(sum(toxic) as bigint) as toxic from w group by rollup(lang, source)")
def ag15_rollup(spark, d):
    return labelled(spark, d).rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").alias("toxic"))


@query("ag16_wilson", LABELLED + ", c as (select source, cast(count(*) as double) as n, cast(sum(quality) as double) as k from w group by 1) select source, round((k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) as low, round((k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 6) as high from c")
def ag16_wilson(spark, d):
    c = labelled(spark, d).groupBy("source").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return c.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("jn08_labels_to_candidates", "select lang, cast(count(*) as bigint) as candidates, cast(count(l.doc_id) as bigint) as labelled from documents d left join labels l using (doc_id) group by 1")
def jn08_labels_to_candidates(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    return table(spark, d, "documents").select("doc_id", "lang").join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("candidates"), F.count("has").alias("labelled"))


@query("st03_allocation", """with s as (select lang, source, count(*) as size from documents group by 1, 2), a as (select *, cast(size * 100 // sum(size) over () as bigint) as share, cast(size * 100 % sum(size) over () as bigint) as rest from s), g as (select *, sum(share) over () as given, row_number() over (order by rest desc, lang, source) as i from a)
select lang, source, size, least(greatest(share + cast(i <= 100 - given as bigint), 1), size) as take from g""")
def st03_allocation(spark, d):
    strata = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("size"))
    return M.allocated(strata, "size", 100)


@query("ag10_histogram", f"with {FRAMES_SQL} select event_type, cast(count_if(value <= 10) as bigint) as le_10, cast(count_if(value <= 50) as bigint) as le_50, cast(count_if(value <= 100) as bigint) as le_100, cast(count_if(value <= 250) as bigint) as le_250, count(value) as \"count\" from frames group by 1")
def ag10_histogram(spark, d):
    return frames(spark, d).groupBy("event_type").agg(*M.histogram(F.col("value"), (10.0, 50.0, 100.0, 250.0)))


@query("snk14_exposition", f"""with {FRAMES_SQL} select 'events_total{{type="' || replace(replace(event_type, '\\', '\\\\'), '"', '\\"') || '"}} ' || cast(count(*) as varchar) as line from frames group by event_type""")
def snk14_exposition(spark, d):
    name = F.replace(F.replace("event_type", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return frames(spark, d).groupBy("event_type").count().select(F.concat(F.lit('events_total{type="'), name, F.lit('"} '), F.col("count").cast("string")).alias("line"))


@query("ag22_quantiles", "select l_suppkey, round(avg(l_quantity), 6) as mean, quantile_disc(l_quantity, 0.5) as median, quantile_disc(l_quantity, 0.9) as p90, max(l_quantity) as worst from lineitem group by 1")
def ag22_quantiles(spark, d):
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by l_quantity)")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), disc(0.5).alias("median"), disc(0.9).alias("p90"), F.max("l_quantity").alias("worst"))


@query("ag24_seed_spread", "with m as (select l_suppkey as clip, l_linenumber as seed, avg(l_quantity) as v from lineitem group by 1, 2) select clip, round(max(v) - min(v), 6) as spread, cast(count(*) as bigint) as seeds from m group by 1 having count(*) >= 2")
def ag24_seed_spread(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("clip"), "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return m.groupBy("clip").agg(F.round(F.max("v") - F.min("v"), 6).alias("spread"), F.count("*").alias("seeds")).where("seeds >= 2")


@query("ag25_value_counts", "with c as (select p_brand, p_type, count(*) as n from part group by 1, 2) select p_brand, string_agg(p_type || ' x' || cast(n as varchar), ', ' order by n desc, p_type) as listing from c group by 1")
def ag25_value_counts(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_type", "n")))
    return c.groupBy("p_brand").agg(F.array_join(F.transform(each, lambda x: F.concat(x["p_type"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("listing"))


@query("jn09_seed_pairs", f"""with {FRAMES_SQL}, s as (select event_type as clip, source_id as seed, frame, cast(floor(value) as bigint) as v from frames)
select a.clip, a.seed as a, b.seed as b, count(*) as n, cast(sum(abs(a.v - b.v)) as bigint) as difference from s a join s b on a.clip = b.clip and a.frame = b.frame and a.seed < b.seed and b.seed <= a.seed + 5 group by 1, 2, 3""")
def jn09_seed_pairs(spark, d):
    """All pairs of the seeds of a study, which are those within five of each other, on each clip and frame: seeds lie in
    strips of five, and each is dealt to its own and the one before, so the band is an equality."""
    s = frames(spark, d).select(F.col("event_type").alias("clip"), F.floor(F.col("source_id") / 5).alias("strip"), F.col("source_id").alias("a"), "frame", F.floor("value").alias("v"))
    other = s.select("clip", F.explode(F.array(F.col("strip"), F.col("strip") - 1)).alias("strip"), "frame", F.col("a").alias("b"), F.col("v").alias("w"))
    j = s.join(other, ["clip", "strip", "frame"]).where("a < b and b <= a + 5")
    return j.groupBy("clip", "a", "b").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("w") - F.col("v"))).alias("difference"))


@query("jn10_paired_difference", "with c as (select l_suppkey, l_returnflag, avg(l_quantity) as q from lineitem group by 1, 2) select a.l_suppkey, a.l_returnflag as variant, round(a.q - b.q, 6) as difference from c a join c b on a.l_suppkey = b.l_suppkey where b.l_returnflag = 'N' and a.l_returnflag <> 'N'")
def jn10_paired_difference(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("q"))
    base = c.where("l_returnflag = 'N'").select("l_suppkey", F.col("q").alias("base"))
    return c.where("l_returnflag <> 'N'").join(base, "l_suppkey").select("l_suppkey", F.col("l_returnflag").alias("variant"), F.round(F.col("q") - F.col("base"), 6).alias("difference"))


@query("jn06_tolerance_merge", f"""with {FRAMES_SQL}, b as (select source_id, frame from frames where event_type = 'click'), a as (select source_id, frame, value from frames where event_type = 'view'),
j as (select b.source_id, b.frame, a.frame as met, row_number() over (partition by b.source_id, b.frame order by cast(a.frame <> b.frame as int), a.value desc, a.frame) as i from b join a on a.source_id = b.source_id and a.frame between b.frame - 1 and b.frame + 1) select source_id, frame, met from j where i = 1""")
def jn06_tolerance_merge(spark, d):
    f = frames(spark, d)
    b = f.where("event_type = 'click'").select("source_id", "frame")
    a = f.where("event_type = 'view'").select("source_id", F.col("frame").alias("met"), "value").withColumn("frame", F.explode(F.array(F.col("met") - 1, F.col("met"), F.col("met") + 1)))
    # the band join as an equality: each candidate is dealt to the three frames it may meet
    j = b.join(a, ["source_id", "frame"]).withColumn("i", F.row_number().over(Window.partitionBy("source_id", "frame").orderBy((F.col("met") != F.col("frame")).cast("int"), F.desc("value"), "met")))
    return j.where("i = 1").select("source_id", "frame", "met")


@query("jn07_peak_search", f"""with {FRAMES_SQL}, b as (select source_id, frame from frames where is_key), j as (select b.source_id, b.frame, a.frame as peak, a.p, row_number() over (partition by b.source_id, b.frame order by a.p desc, a.frame) as i from b join frames a on a.source_id = b.source_id and a.frame between b.frame - 2 and b.frame + 2)
select source_id, frame, case when cast(p as double) >= 0.3 then peak end as peak from j where i = 1""")
def jn07_peak_search(spark, d):
    w = Window.partitionBy("source_id").orderBy("frame").rowsBetween(-2, 2)
    f = frames(spark, d).select("source_id", "frame", "is_key", "p").withColumn("best", F.min(F.struct((-F.col("p")).alias("m"), F.col("frame").alias("frame"))).over(w))
    return f.where("is_key").select("source_id", "frame", F.when(-F.col("best.m").cast("double") >= 0.3, F.col("best.frame")).alias("peak"))


@query("ag08_affine_fit", f"""with {FRAMES_SQL}, e as (select source_id, min(event_id) as x0, max(event_id) as x1, arg_min(pts, event_id) as y0, arg_max(pts, event_id) as y1 from frames group by 1) select source_id, round(case when x1 = x0 then 0 else (y1 - y0) / cast(x1 - x0 as double) end, 3) as slope from e""")
def ag08_affine_fit(spark, d):
    e = frames(spark, d).groupBy("source_id").agg(F.min(F.struct("event_id", "pts")).alias("a"), F.max(F.struct("event_id", "pts")).alias("b"))
    dx, dy = F.col("b.event_id") - F.col("a.event_id"), F.col("b.pts") - F.col("a.pts")
    return e.select("source_id", F.round(F.when(dx == 0, 0.0).otherwise(dy / dx.cast("double")), 3).alias("slope"))


@query("ag03_counters", f"with {FRAMES_SQL} select source_id, cast(count_if(event_type = 'click') as bigint) as click, cast(count_if(event_type = 'view') as bigint) as \"view\", cast(count_if(event_type = 'error') as bigint) as error from frames group by 1")
def ag03_counters(spark, d):
    out = frames(spark, d).groupBy("source_id").pivot("event_type", ["click", "view", "error"]).agg(F.count("event_id"))
    return out.na.fill(0)


@query("ag26_kept_bytes", "select l_suppkey, cast(count_if(l_linenumber <> 1) * 1080 * 6 as bigint) as bytes from lineitem group by 1")
def ag26_kept_bytes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_linenumber") != 1) * 1080 * 6).alias("bytes"))


PAIR = f"with {VECTORS_SQL}, pair as (select a.vec_id, a.v as a, b.v as b from vectors a join vectors b on b.vec_id = a.vec_id + 1)"


def pairs(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", F.col("v").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


@query("ag18_psnr", PAIR + ", m as (select vec_id, list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 64 as mse from pair) select vec_id, round(mse, 6) as mse, round(10 * log10(1.0 / mse), 6) as psnr from m")
def ag18_psnr(spark, d):
    m = pairs(spark, d).select("vec_id", M.mean_square("a", "b").alias("mse"))
    return m.select("vec_id", F.round("mse", 6).alias("mse"), F.round(M.psnr(F.col("mse")), 6).alias("psnr"))


@query("ag27_projection", PAIR + " select vec_id, round(list_dot_product(a, b) / list_dot_product(b, b), 6) as alpha from pair")
def ag27_projection(spark, d):
    return pairs(spark, d).select("vec_id", F.round(M.dot("a", "b") / M.dot("b", "b"), 6).alias("alpha"))


@query("jn15_aligned_slices", PAIR + " select vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0 as cosine from pair")
def jn15_aligned_slices(spark, d):
    return pairs(spark, d).select("vec_id", (F.round(M.dot("a", "b") / (F.sqrt(M.dot("a", "a")) * F.sqrt(M.dot("b", "b"))), 6) + 0.0).alias("cosine"))


@query("ag20_column_sums", f"with {VECTORS_SQL}, x as (select unnest(v) as x, unnest(range(0, 64)) as pos from vectors) select cast(pos as int) as pos, round(sum(x * x), 6) as sum2, count(*) as \"count\" from x group by 1")
def ag20_column_sums(spark, d):
    return M.column_sums(vectors(spark, d)).select("pos", F.round("sum2", 6).alias("sum2"), "count")


@query("sc07_low_band", f"with {VECTORS_SQL}, x as (select vec_id, v, unnest(range(0, 64)) as i from vectors) select vec_id, i, round((v[greatest(i - 2, 0) + 1] + 2 * v[i + 1] + v[least(i + 2, 63) + 1]) / 4, 6) + 0.0 as x from x")
def sc07_low_band(spark, d):
    out = vectors(spark, d).select("vec_id", F.posexplode(K.low_band("v", 2, 64)).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@query("sc09_int8", f"with {VECTORS_SQL}, s as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 as scale from vectors), c as (select vec_id, scale, unnest(v) as x, unnest(range(0, 64)) as i from s) select vec_id, i, cast(greatest(-127, least(127, round_even(x / scale, 0))) as int) as code from c")
def sc09_int8(spark, d):
    s = vectors(spark, d).withColumn("scale", K.absmax("v") / 127)
    return s.select("vec_id", F.posexplode(K.int8_codes("v", "scale")).alias("i", "code")).select("vec_id", F.col("i").cast("long").alias("i"), "code")


@query("sc10_rotated", f"with {VECTORS_SQL}, x as (select vec_id, unnest(v) as x, unnest(range(0, 64)) as j from vectors), r as (select vec_id, x, j, unnest(range(0, 64)) as i from x) select vec_id, i, round(sum(case when bit_count(i & j) % 2 = 0 then x else -x end) / 8, 5) + 0.0 as x from r group by 1, 2")
def sc10_rotated(spark, d):
    out = R.rotated(vectors(spark, d), "v", "r").select("vec_id", F.posexplode("r").alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 5) + 0.0).alias("x"))


@query("sc12_e2m1", f"with {VECTORS_SQL}, s as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 6 as scale from vectors), c as (select vec_id, unnest(range(0, 64)) as i, unnest(v) / scale as y from s) select vec_id, i, sign(y) * case when abs(y) <= 0.25 then 0.0 when abs(y) <= 0.75 then 0.5 when abs(y) <= 1.25 then 1.0 when abs(y) <= 1.75 then 1.5 when abs(y) <= 2.5 then 2.0 when abs(y) <= 3.5 then 3.0 when abs(y) <= 5 then 4.0 else 6.0 end + cast(0 as double) as code from c")
def sc12_e2m1(spark, d):
    s = vectors(spark, d).withColumn("scale", K.absmax("v") / 6)
    out = s.select("vec_id", "scale", F.posexplode("v").alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), (K.e2m1(F.col("x") / F.col("scale")) + 0.0).alias("code"))


@query("prj04_colour_matrix", "with s as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 50 as r, l_discount as g, l_tax as b from lineitem), y as (select *, 0.2126 * r + 0.7152 * g + 0.0722 * b as y from s) select l_orderkey, l_linenumber, l_partkey, round(y, 6) as y, round((b - y) / 1.8556, 6) + 0.0 as cb, round((r - y) / 1.5748, 6) + 0.0 as cr from y")
def prj04_colour_matrix(spark, d):
    y, cb, cr = K.luma(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(y, 6).alias("y"), (F.round(cb, 6) + 0.0).alias("cb"), (F.round(cr, 6) + 0.0).alias("cr"))


@query("prj10_codes", "select l_orderkey, l_linenumber, l_partkey, cast(round_even(least(greatest(l_discount, 0), 1) * 65535, 0) as bigint) as code from lineitem")
def prj10_codes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.code16(F.col("l_discount")).alias("code"))


@query("flt04_finite", f"with {VECTORS_SQL} select vec_id, list_bool_and(list_transform(v, lambda x: isfinite(x))) as finite from vectors")
def flt04_finite(spark, d):
    return vectors(spark, d).select("vec_id", F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))).alias("finite"))


@query("prj12_padded", f"with {VECTORS_SQL}, p as (select vec_id, v || list_resize([]::double[], (4 - (60 + vec_id % 4 - 1) % 4) % 4, v[60 + vec_id % 4]) as w, 60 + vec_id % 4 as n from vectors) select vec_id, n + (4 - (n - 1) % 4) % 4 as length from p")
def prj12_padded(spark, d):
    n = 60 + F.col("vec_id") % 4
    k = (4 - (n - 1) % 4) % 4
    cut = F.slice("v", F.lit(1), n.cast("int"))
    return vectors(spark, d).select("vec_id", F.size(F.concat(cut, F.array_repeat(F.element_at(cut, -1), k.cast("int")))).cast("long").alias("length"))


@query("sc12_fp8_rows", f"""with {VECTORS_SQL}, s as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 448 as scale from vectors), c as (select vec_id, scale, unnest(range(0, 64)) as i, unnest(v) / scale as y from s),
p as (select *, pow(2.0::double, greatest(floor(log2(greatest(abs(y), 0.00000095367431640625::double))), -6) - 3) as step from c) select vec_id, i, round(least(greatest(round_even(y / step, 0) * step, -448), 448) * scale, 9) + 0.0 as x from p""")
def sc12_fp8_rows(spark, d):
    """Rows in eight bits by a scale each, and back."""
    s = vectors(spark, d).withColumn("scale", K.absmax("v") / 448)
    c = s.select("vec_id", "scale", F.posexplode("v").alias("i", "x"))
    return c.select("vec_id", F.col("i").cast("long").alias("i"), (F.round(K.e4m3(F.col("x") / F.col("scale")) * F.col("scale"), 9) + 0.0).alias("x"))
